"""As-of, temporal, interval and exploding joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, columns: list[str], tolerance_seconds: int | None = None, strict: bool = False, cell_seconds: int = 86_400) -> DataFrame:
    """left with columns of the latest right row at or before (strict: before) left_ts, null if none.

    A union swept in time order: no pairs. Work is spread by (by, time cell);
    the row that reaches into a cell is carried in from a summary of the cells.
    Of right rows of equal time the greatest in content holds. Rows of left
    keep their number; those with a null key or time match nothing. Clashing
    column names: those of left hold, so name the right ones apart.
    """
    cell = lambda c: F.floor(F.unix_micros(c) / (cell_seconds * 1_000_000)).cast("int")
    r = right.select(*by, F.col(right_ts).alias("_t"), F.struct(F.col(right_ts).alias("_t"), *columns).alias("_x")).where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, "_t"])).withColumn("_cell", cell(F.col("_t")))
    left_x = left.withColumns({"_t": F.col(left_ts), "_cell": cell(F.col(left_ts))})
    none = F.lit(None).cast(r.schema["_x"].dataType)
    tops = r.groupBy(*by, "_cell").agg(F.max("_x").alias("_x")).withColumn("_asked", F.lit(False))
    asked = left_x.where("_cell IS NOT NULL").select(*by, "_cell").distinct().select(*by, "_cell", none.alias("_x"), F.lit(True).alias("_asked"))
    earlier = Window.partitionBy(*by).orderBy("_cell").rangeBetween(Window.unboundedPreceding, -1)
    carried = tops.unionByName(asked).withColumn("_x", F.max("_x").over(earlier)).where("_asked AND _x IS NOT NULL").select(*by, "_cell", F.col("_x._t").alias("_t"), "_x")
    first = 1 if strict else 0
    sweep = left_x.withColumns({"_x": none, "_side": F.lit(1 - first)}).unionByName(r.unionByName(carried.select(*r.columns)).withColumn("_side", F.lit(first)), allowMissingColumns=True)
    upto = Window.partitionBy(*by, "_cell").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = sweep.withColumn("_x", F.max("_x").over(upto)).where(F.col("_side") == 1 - first)
    ok = F.lit(True)
    for c in by:
        ok = ok & F.col(c).isNotNull()
    if tolerance_seconds is not None:
        ok = ok & (F.unix_micros("_t") - F.unix_micros("_x._t") <= tolerance_seconds * 1_000_000)
    return out.select(*left.columns, *[F.when(ok, F.col(f"_x.{c}")).alias(c) for c in columns])


def regime_labels(trades: DataFrame, snapshots: DataFrame, mode: str, entry: str = "entry_time", date: str = "date", asset: list[str] | None = None, label: str = "state", minutes: int = 30, at: Column | None = None) -> DataFrame:
    """trades with a column regime: the label known at entry (asof), at a clock (exact) or in the end (final); 'unknown' if none.

    snapshots has (asset.., date, ts, label). asof: the latest snapshot at or
    before entry, at most `minutes` old and of the trade's own date. exact: the
    latest of the date at or before the instant `at` (a column of snapshots).
    final: the date's last.
    """
    keys = [*(asset or [])]
    if mode == "asof":
        s = snapshots.select(*keys, F.col("ts").alias("_ts"), F.col(date).alias("_date"), F.col(label).alias("_label"))
        out = asof(trades, s, keys, entry, "_ts", ["_date", "_label"], minutes * 60)
        return out.withColumn("regime", F.coalesce(F.when(F.col("_date") == F.col(date), F.col("_label")), F.lit("unknown"))).drop("_date", "_label")
    rows = snapshots if mode == "final" else snapshots.where(F.col("ts") <= at)
    per_day = rows.groupBy(*keys, date).agg(F.max_by(label, "ts").alias("_label"))
    return trades.join(per_day, [*keys, date], "left").withColumn("regime", F.coalesce("_label", F.lit("unknown"))).drop("_label")


def temporal(facts: DataFrame, versions: DataFrame, key: str, fact_day: str, active_from: str, columns: list[str]) -> DataFrame:
    """facts with columns of the newest version active on the fact's day, else of the newest version overall."""
    current = asof(facts.withColumn("_at", F.col(fact_day).cast("timestamp")), versions.withColumn("_from", F.col(active_from).cast("timestamp")).select(key, "_from", *[F.col(c).alias(f"_v_{c}") for c in columns]), [key], "_at", "_from", [f"_v_{c}" for c in columns]).drop("_at")
    newest = versions.groupBy(key).agg(F.max(F.struct(active_from, *columns)).alias("_n"))
    out = current.join(newest, key, "left")
    found = F.coalesce(*[F.col(f"_v_{c}").isNotNull() for c in columns[:1]])
    return out.select(*facts.columns, *[F.when(found, F.col(f"_v_{c}")).otherwise(F.col(f"_n.{c}")).alias(c) for c in columns])


def interval(facts: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, columns: list[str], disjoint: bool = True) -> DataFrame:
    """facts within a span [start, end) of their key, with its columns; facts in no span are dropped.

    disjoint: the spans of a key do not overlap, so a fact can only lie in the
    last one that began: an as-of sweep, and no fact meets a span it does not
    lie in. Overlapping spans are then an error; without disjoint a fact gives
    a row for each span it lies in, by an equi-join on the key with a range
    condition. Spans without a key, start or end and empty ones hold nothing.
    """
    s = spans.where(F.col(key).isNotNull() & (F.col(start) < F.col(end))).select(key, F.col(start).alias("_lo"), F.col(end).alias("_hi"), *[F.col(c).alias(f"_s_{c}") for c in columns]).distinct()
    back = [F.col(f"_s_{c}").alias(c) for c in columns]
    if not disjoint:
        return facts.join(s.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col(at) >= F.col("_lo")) & (F.col(at) < F.col("_hi"))).select(*facts.columns, *back)
    clash = F.lead("_lo").over(Window.partitionBy(key).orderBy("_lo")) < F.col("_hi")
    sure = F.when(clash, F.raise_error(F.lit("spans of a key overlap")).cast("boolean")).otherwise(True)
    found = asof(facts, s.withColumn("_sure", sure).where("_sure").drop("_sure"), [key], at, "_lo", ["_hi", *[f"_s_{c}" for c in columns]])
    return found.where(F.col(at) < F.col("_hi")).select(*facts.columns, *back)


def legs(trades: DataFrame, parts: DataFrame, key: str, size: str, sign: str) -> DataFrame:
    """One row per trade and leg: size times the leg's ratio, sign times its side."""
    return trades.join(parts, key).withColumns({size: F.col(size) * F.col("ratio"), sign: F.col(sign) * F.col("leg_sign")})


def with_default(facts: DataFrame, lookup: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """facts with a looked-up column, the default where there is none."""
    return facts.join(lookup.select(key, F.col(column).alias("_v")), key, "left").withColumn(column, F.coalesce("_v", F.lit(default))).drop("_v")
