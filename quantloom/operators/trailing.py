"""Totals and averages over trailing periods, days without activity included.

Event-contribution deltas: the amount of a day adds to a window's total on its
own day and is subtracted again once the window has passed it. The running sum
of these deltas is the total, constant between two delta days, so idle days
cost nothing until they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = "decimal(38,9)"


def session_day(text: Column) -> Column:
    """DATE of a session day written year, month, day in any usual notation.

    Compact or separated, with or without a time; anything else gives null.
    """
    compact = F.regexp_extract(text, r"^\s*(\d{8})(?!\d)", 1)
    parts = [F.regexp_extract(text, r"^\s*(\d{4})\D(\d{1,2})\D(\d{1,2})(?!\d)", i) for i in (1, 2, 3)]
    iso = F.when(compact != "", F.concat_ws("-", F.substring(compact, 1, 4), F.substring(compact, 5, 2), F.substring(compact, 7, 2))).when(
        parts[0] != "", F.concat_ws("-", parts[0], parts[1], parts[2])
    )
    return iso.try_cast("date")


def latest_by(df: DataFrame, key: str, saved: str, columns: dict[str, Column]) -> DataFrame:
    """One row per key: the given columns of its copy saved last (ties: greatest content)."""
    pick = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.struct(F.col(saved).alias("saved_"), *[c.alias(n) for n, c in columns.items()]).alias("x"))
    return pick.groupBy("k").agg(F.max("x").alias("x")).select(F.col("k").alias(key), *[F.col(f"x.{n}").alias(n) for n in columns])


def _exact(amount: Column) -> Column:
    """An amount as an exact decimal; null, NaN and infinite ones give null, one too large for it is an error."""
    x = amount.cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite & (F.abs(x) >= 1e28), F.raise_error(F.lit("an amount of 1e28 or more is not added exactly")).cast(EXACT)).when(finite, amount.try_cast(EXACT))


def trailing_segments(df: DataFrame, entity: str, day: str, amount: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """entity, from_day, to_day, total_<n>...: spells of days with equal totals.

    df holds amounts, any number per entity and day. Spells run from the
    entity's first day with an amount to its last, without holes. Rows with a
    null entity or day and null, NaN or infinite amounts do not count. Amounts
    are added as exact decimals, so a total that is zero is zero.

    Amounts are first added by entity and day, before the shuffle, so what an
    entity brings is bounded by its days.
    """
    counted = (
        df.select(F.col(entity).alias("e"), F.col(day).alias("d"), _exact(F.col(amount)).alias("x"))
        .where("e IS NOT NULL AND d IS NOT NULL AND x IS NOT NULL")
        .groupBy("e", "d")
        .agg(F.sum("x").alias("x"))
    )
    zero = F.lit(0).cast(EXACT)
    x = F.col("x").cast(EXACT)
    changes = [F.struct(F.col("d").alias("d"), F.lit(True).alias("active"), *[x.alias(f"x{n}") for n in windows])]
    for n in windows:
        changes.append(F.struct(F.date_add("d", n).alias("d"), F.lit(False).alias("active"), *[(-x if m == n else zero).alias(f"x{m}") for m in windows]))
    deltas = (
        counted.select("e", F.explode(F.array(*changes)).alias("c"))
        .groupBy("e", "c.d")
        .agg(F.max("c.active").alias("active"), *[F.sum(f"c.x{n}").alias(f"x{n}") for n in windows])
    )
    run = Window.partitionBy("e").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    spells = deltas.withColumns(
        {f"total_{n}": F.sum(f"x{n}").over(run) for n in windows}
        | {"next": F.lead("d").over(Window.partitionBy("e").orderBy("d")), "last": F.max(F.when(F.col("active"), F.col("d"))).over(Window.partitionBy("e"))}
    ).where("d <= last")
    return spells.select(F.col("e").alias(entity), F.col("d").alias("from_day"), F.least(F.coalesce(F.date_sub("next", 1), F.col("last")), F.col("last")).alias("to_day"), *[f"total_{n}" for n in windows])


def by_day(segments: DataFrame, day: str = "day") -> DataFrame:
    """One row per calendar day of the spells."""
    return segments.withColumn(day, F.explode(F.sequence("from_day", "to_day"))).drop("from_day", "to_day")


def run_ticks(trades: DataFrame) -> DataFrame:
    """(run_id, day, ticks) of the counted trades: the last saved copy of each trade_id."""
    return latest_by(trades, "trade_id", "saved_at", {"run_id": F.col("run_id"), "day": session_day(F.col("date")), "ticks": F.col("ticks")}).where("day IS NOT NULL AND ticks IS NOT NULL AND NOT isnan(ticks)")
