"""Pools of strategy variants: identity, filters, in-sample split, floors and joint evaluation.

All of it by columns over the trades of all runs; sets of variants are rows of
a table (set, variant), so any number of sets is evaluated in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import folds

YEAR_ROOT = 252.0**0.5


def filtered(trades: DataFrame, stages: list[tuple[str, list]], keys: list[str], order: list[str], amount: str = "ticks", total: str = "cumulative_ticks") -> DataFrame:
    """The trades that pass every stage (column, allowed values), with their running total over what is left.

    A null passes no stage. No allowed value leaves no trade. Stages may be in
    any order; the total is that of the last.
    """
    out = trades
    for column, allowed in stages:
        out = out.where(F.col(column).isin(allowed) if allowed else F.lit(False))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(total, F.sum(amount).over(w))


def at_point(rows: DataFrame, point: dict) -> DataFrame:
    """The rows of one cell of a sweep: every parameter equal to the point's, null to null."""
    for column, value in point.items():
        rows = rows.where(F.col(column).isNull() if value is None else F.col(column) == F.lit(value))
    return rows


def variants(trades: DataFrame, run: str, kind: str, params: list[str], allowed: dict[str, list] | None = None, day: str = "day", start=None, end=None) -> DataFrame:
    """trades with vid, their variant: run, kind ('unknown' if null) and swept parameters as text; null parameters are a value of their own.

    Trades outside the allowed values, or outside [start, end], are dropped
    before anything is counted.
    """
    out = trades.where(F.col(run).isNotNull())
    for column, values in (allowed or {}).items():
        out = out.where(F.col(column).isin(values))
    if start is not None:
        out = out.where(F.col(day) >= F.lit(start))
    if end is not None:
        out = out.where(F.col(day) <= F.lit(end))
    shown = [F.concat(F.lit(f"{p}="), F.coalesce(F.regexp_replace(F.col(p).cast("string"), r"\.0$", ""), F.lit("none"))) for p in params]
    parts = [F.col(run).cast("string"), F.coalesce(F.col(kind).cast("string"), F.lit("unknown")), *([F.concat_ws(", ", *shown)] if shown else [])]
    return out.withColumn("vid", F.concat_ws(" · ", *parts))


def in_sample(pool: DataFrame, day: str, fraction: float) -> DataFrame:
    """pool with in_sample: whether the day is among the first `fraction` of all distinct days (at least one on either side)."""
    days = pool.select(day).where(F.col(day).isNotNull()).distinct()
    n = days.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = F.greatest(F.least(F.floor(n * fraction), n - 1), F.lit(1))
    ranked = days.withColumn("in_sample", F.row_number().over(Window.orderBy(day)) <= cut)  # one row per calendar day
    return pool.join(ranked, day)


def floored(pool: DataFrame, kind: str, floors: dict[str, int], default: int = 0) -> DataFrame:
    """The variants with at least their kind's number of in-sample trades."""
    least: Column = F.lit(default)
    for k, n in floors.items():
        least = F.when(F.coalesce(F.col(kind), F.lit("unknown")) == k, n).otherwise(least)
    counted = pool.withColumn("_n", F.count_if("in_sample").over(Window.partitionBy("vid")))
    return counted.where(F.col("_n") >= least).drop("_n")


def merged(pool: DataFrame, sets: DataFrame, set_id: str, entry: str, exit_: str, tie: list[str]) -> DataFrame:
    """The full rows of each set's trades that the walk without overlap keeps, in order of (entry, exit, vid, tie)."""
    rows = pool.join(sets.select(set_id, "vid").distinct(), "vid")
    return folds.no_overlap(rows, [set_id], entry, exit_, ["vid", *tie])


def evaluate(pool: DataFrame, sets: DataFrame, set_id: str, entry: str, exit_: str, tie: list[str], day: str = "day", ticks: str = "ticks") -> DataFrame:
    """set_id, total_ticks, sharpe_daily, max_dd_ticks, max_dd_pct, n_trades, n_days of each set's merged trades.

    The Sharpe ratio is over traded days, null for fewer than two or without
    spread. Drawdowns are of the daily sums' running total; the percentage is
    of the peak at the time, null if no peak is above zero. A set without
    trades has no row.
    """
    daily = merged(pool, sets, set_id, entry, exit_, tie).groupBy(set_id, day).agg(F.sum(ticks).alias("_d"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(set_id).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("_e", F.sum("_d").over(w)).withColumn("_p", F.max("_e").over(w)).withColumn("_dd", F.col("_e") - F.col("_p"))
    g = curve.groupBy(set_id).agg(
        F.sum("_d").alias("total_ticks"), F.avg("_d").alias("_m"), F.stddev_samp("_d").alias("_s"), F.min("_dd").alias("max_dd_ticks"),
        (F.min(F.when(F.col("_p") > 0, F.col("_dd") / F.when(F.col("_p") > 0, F.col("_p")))) * 100.0).alias("max_dd_pct"), F.sum("_n").alias("n_trades"), F.count(F.lit(1)).alias("n_days"),
    )
    sharpe = F.when((F.col("n_days") >= 2) & (F.col("_s") > 0), F.col("_m") / F.when(F.col("_s") > 0, F.col("_s")) * YEAR_ROOT)
    return g.select(set_id, "total_ticks", sharpe.alias("sharpe_daily"), "max_dd_ticks", "max_dd_pct", "n_trades", "n_days")
