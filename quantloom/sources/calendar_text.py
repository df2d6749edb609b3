"""Calendar pages as text: a date line, time lines, a currency line and an event line.

Each line is classified by its form; what holds for the lines after it (date,
time, currency) is carried forward by windows over the line number, so events
that share a time take the last one seen.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, year: int | None = None, currency: str = "USD") -> DataFrame:
    """date (DATE), time (HH:MM or "All Day"), event: one row per event of a currency, repeats once.

    The year of a file is the first 20xx in its name, else in its first 500
    characters, else the argument or this year.

    Times are 12-hour (8:30am) or words such as "All Day". Lines before the
    first date are left out. Several files are kept apart by their names.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    named, told = (F.nullif(F.regexp_extract(c, r"(20\d{2})", 1), F.lit("")) for c in (F.col("file"), F.substring("value", 1, 500)))
    raw = raw.withColumn("year", F.coalesce(named.cast("int"), told.cast("int"), F.lit(year or date.today().year))).drop("value")
    lines = raw.withColumn("line", F.trim("line")).where("line <> ''")
    month = r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)\w*\s+)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+(\d{1,2})$"
    clock = r"(?i)^(\d{1,2}):(\d{2})\s*(am|pm)$"
    names = F.array(*[F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")])
    is_date, is_clock = F.regexp_like("line", F.lit(month)), F.regexp_like("line", F.lit(clock))
    is_allday, is_code = F.regexp_like("line", F.lit(r"(?i)^(all day|tentative)$")), F.regexp_like("line", F.lit(r"^[A-Z]{3}$"))
    is_weekday = F.regexp_like("line", F.lit(r"(?i)^(mon|tue|wed|thu|fri|sat|sun)\w*$"))
    day = F.when(is_date, F.make_date(F.col("year"), F.array_position(names, F.lower(F.regexp_extract("line", month, 1))).cast("int"), F.regexp_extract("line", month, 2).try_cast("int")))
    hour = F.regexp_extract("line", clock, 1).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract("line", clock, 3)) == "pm", 12).otherwise(0)
    time = F.when(is_clock, F.format_string("%02d:%s", hour, F.regexp_extract("line", clock, 2))).when(is_allday, F.lit(""))
    upto = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumns({"date": F.last(day, True).over(upto), "time": F.last(F.when(is_date, F.lit("")).otherwise(time), True).over(upto), "code": F.last(F.when(is_code, F.col("line")), True).over(upto), "plain": ~(is_date | is_clock | is_allday | is_code | is_weekday)})
    before = F.lag("plain").over(Window.partitionBy("file").orderBy("n"))
    x = x.withColumn("event", F.when(F.col("plain") & ~F.coalesce(before, F.lit(False)), F.col("line")))
    return x.where(F.col("event").isNotNull() & F.col("date").isNotNull() & (F.col("code") == currency)).select("date", F.when(F.col("time") != "", F.col("time")).otherwise("All Day").alias("time"), "event").distinct()


# Words of events that close markets and of those that do not concern them.
HOLIDAY = ["bank holiday", "holiday"]
BLOCKED = ["daylight saving time", "daylight savings time", "dst", "clocks change", "clock change"]


def impact(event: Column | str) -> Column:
    """grey for holidays, null for changes of the clock, red for all else: the pages hold no other events."""
    t = F.lower(F.trim(event))
    says = lambda words: F.greatest(*[t.contains(w) for w in words])
    return F.when(says(BLOCKED), F.lit(None).cast("string")).when(says(HOLIDAY), "grey").when(t.isNotNull(), "red")
