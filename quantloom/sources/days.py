"""Tables partitioned by day: scans, sinks, catalogs and small stores."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators.joins import asof


def read_days(spark: SparkSession, path: str, start: date | None = None, end: date | None = None, columns: list[str] | None = None, day: str = "dt") -> DataFrame:
    """The days of a table within [start, end], only the columns asked for that there are; missing ones come as null.

    The bounds are on the partition column, so other days are not even listed
    for reading; the columns reach the scan.
    """
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if start is not None:
        df = df.where(F.col(day) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(day) <= F.lit(end))
    if columns is None:
        return df
    have = set(df.columns)
    return df.select(day, *[F.col(c) if c in have else F.lit(None).alias(c) for c in columns])


def write_days(df: DataFrame, path: str, day: str = "dt", keys: list[str] | None = None, replace: bool = True) -> None:
    """Writes a table by (keys, day); days that come again are replaced whole, others stay.

    Rows are shuffled by partition first, so each partition gets few files.
    """
    parts = [*(keys or []), day]
    writer = df.repartition(*[F.col(c) for c in parts]).write.partitionBy(*parts)
    if replace:
        writer = writer.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    else:
        writer = writer.mode("append")
    writer.parquet(path)


def days_of(spark: SparkSession, path: str, day: str = "dt") -> list[date]:
    """The days a table has, ascending (as many values as there are calendar days)."""
    return [r[0] for r in spark.read.parquet(path).select(day).distinct().orderBy(day).collect()]


def days_left(have: list[date], done: list[date], again: int = 0) -> list[date]:
    """Days still to compute: those not done and the last `again` that are, which late data may change."""
    redo = set(sorted(done)[-again:]) if again else set()
    return [x for x in have if x not in set(done) or x in redo]


def file_day(df: DataFrame) -> DataFrame:
    """Adds day: the date in the name of the file a row was read from."""
    return df.withColumn("day", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date"))


def read_range(spark: SparkSession, path: str, key: str, value, at: str, start, end, day: str = "dt") -> DataFrame:
    """The rows of one key with start <= at <= end, in order of time; only the days of the range are read (and those around it)."""
    df = spark.read.parquet(path)
    near = F.col(day).between(F.date_sub(F.lit(start).cast("date"), 1), F.date_add(F.lit(end).cast("date"), 1))
    return df.where(near & (F.col(key) == F.lit(value)) & F.col(at).between(F.lit(start), F.lit(end))).orderBy(at)


def around(rows: DataFrame, keys: list[str], at: str, marks: DataFrame, mark: str, start: str, end: str, before: int, after: int) -> DataFrame:
    """mark and rows: those from `before` rows ahead of the last one at or before start to `after` rows behind the first at or after end.

    marks: mark, keys, start, end. Rows of a key are numbered in order of time
    and a mark's span is a range of numbers, unfolded and met by equality.
    """
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(at)))
    place = numbered.select(*keys, F.col(at).alias("_at"), "_n")
    m = asof(marks, place, keys, start, "_at", ["_n"]).withColumnRenamed("_n", "_a")
    back = place.select(*keys, F.timestamp_micros(-F.unix_micros("_at")).alias("_neg"), F.col("_n").alias("_b"))
    m = asof(m.withColumn("_end", F.timestamp_micros(-F.unix_micros(end))), back, keys, "_end", "_neg", ["_b"])
    lo, hi = F.greatest(F.coalesce("_a", F.lit(1)) - before, F.lit(1)), F.coalesce(F.col("_b"), F.lit(2**31 - 2 - after)) + after
    last = numbered.groupBy(*keys).agg(F.max("_n").alias("_last"))
    m = m.join(last, keys).withColumn("_n", F.explode(F.sequence(lo, F.least(F.greatest(lo, hi), "_last"))))
    return m.select(mark, *keys, "_n").join(numbered, [*keys, "_n"]).drop("_n")


def save_filtered(df: DataFrame, provenance: dict | None, path: str) -> None:
    """A table of trades with the filters it went through; None says that it went through none."""
    save_run(df, {"filters": provenance, "rows": df.count(), "bits": fingerprint(df).first()["bits"]}, path)


def provenance(spark: SparkSession, path: str) -> dict | None:
    """The filters of a saved table, None if it was not filtered."""
    return load_run(spark, path)[1]["filters"]


def save_run(df: DataFrame, meta: dict, path: str) -> None:
    """A run: its rows as a table and its description beside them, as one-row tables of one folder."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "meta string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")


def load_run(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows and description of a saved run."""
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free hash of their content, to tell whether two tables are equal."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("bits"), F.coalesce(F.sum(F.pmod(h, F.lit(1_000_003))), F.lit(0)).alias("sum"))
