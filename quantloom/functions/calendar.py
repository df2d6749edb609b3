"""Sessions, clocks and calendars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


def local(ts: Column, zone: str = NEW_YORK) -> Column:
    """Wall-clock time of a UTC instant."""
    return F.from_utc_timestamp(ts, zone)


def session_start(day: Column, roll_hour: int = 18, zone: str = NEW_YORK) -> Column:
    """The UTC instant at which the session of a trade date begins: roll_hour of the day before, wall-clock time."""
    return F.to_utc_timestamp(F.date_sub(day, 1).cast("timestamp") + F.make_interval(hours=F.lit(roll_hour)), zone)


def minute_of_day(ts: Column) -> Column:
    """Minutes since midnight."""
    return F.hour(ts) * 60 + F.minute(ts)


def trade_date(ts: Column, roll_hour: int = 18) -> Column:
    """Calendar date, from roll_hour on that of the next day."""
    return F.to_date(ts + F.make_interval(hours=F.lit(24 - roll_hour)))


def in_window(ts: Column, start: int, end: int, closed: bool = True) -> Column:
    """Within [start, end] minutes of the day, or [start, end) if not closed."""
    m = minute_of_day(ts)
    return (m >= start) & ((m <= end) if closed else (m < end))


def weekdays_between(first: Column, last: Column) -> Column:
    """Number of weekdays from first to last, both included."""
    days = F.datediff(last, first) + 1
    rest = days % 7
    start = F.weekday(first)
    # Of the days left over, those that fall on Saturday (5) or Sunday (6).
    saturday = F.when((start <= 5) & (start + rest > 5), 1).otherwise(0)
    sunday = F.when((start <= 6) & (start + rest > 6), 1).otherwise(0)
    return F.floor(days / 7) * 5 + rest - saturday - sunday


def nth_weekday(year: Column, month: Column, weekday: int, n: int) -> Column:
    """Date of the n-th weekday (0: Monday) of a month."""
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def clock(minutes: Column) -> Column:
    """HH:MM of a minute of the day."""
    return F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60)


def snapshot_clocks(start: int, end: int, step: int) -> list[str]:
    """Clock labels from start to end (minutes of the day), past midnight if end is earlier."""
    span = (end - start) % 1440
    return [f"{(start + k) % 1440 // 60:02d}:{(start + k) % 60:02d}" for k in range(step, span + 1, step)]
