"""Bars, volume at price, front contracts, sessions and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars(tape: DataFrame, keys: list[str], bucket: Column, price: str, size: str, order: list[str], side: str | None = None) -> DataFrame:
    """Tumbling OHLCV bars: keys, bucket, open, high, low, close, volume (and buy, sell by side B, A).

    First and last are by the order columns, never by row order. Partial
    aggregation runs before the one shuffle by (keys, bucket).
    """
    at = F.struct(*order)
    aggs = [
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(size).alias("volume"),
    ]
    if side:
        aggs += [F.sum(F.when(F.upper(side) == s, F.col(size)).otherwise(0)).alias(n) for s, n in (("B", "buy_volume"), ("A", "sell_volume"))]
    return tape.where(F.col(price).isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(*aggs)


def clean_bars(df: DataFrame) -> DataFrame:
    """symbol, minute, OHLCV: one bar per symbol and minute.

    Stamps off the minute go to the nearest one; bars without time or close
    are left out; of several bars of a minute the one with the smallest id holds.
    """
    minute = F.date_trunc("minute", F.col("ts") + F.expr("INTERVAL 30 SECONDS"))
    rows = df.where("ts IS NOT NULL AND symbol IS NOT NULL AND close IS NOT NULL AND NOT isnan(close)")
    fields = F.struct("candle_id", "open", "high", "low", "close", "volume")
    return rows.groupBy("symbol", minute.alias("minute")).agg(F.min(fields).alias("x")).select("symbol", "minute", "x.open", "x.high", "x.low", "x.close", "x.volume")


def volume_at_price(tape: DataFrame, keys: list[str], price: str, size: str, side: str) -> DataFrame:
    """keys, price, buy, sell: volume by aggressor at each price (long form)."""
    return tape.groupBy(*keys, price).agg(*[F.sum(F.when(F.upper(side) == s, F.col(size)).otherwise(0)).cast("long").alias(n) for s, n in (("B", "buy"), ("A", "sell"))])


def price_map(levels: DataFrame, keys: list[str], price: str) -> DataFrame:
    """keys, levels: the levels of each group as an array sorted by price (bounded by the tick grid of a bar)."""
    return levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(price).alias("price"), "buy", "sell"))).alias("levels"))


def first_per_level(tape: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each group."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return tape.withColumn("_n", n).where("_n = 1").drop("_n")


def front_and_roll(tape: DataFrame, group: list[str], symbol: str, size: str, threshold: float = 0.2) -> DataFrame:
    """group, front, front_volume, second_volume, is_roll_day: the most traded symbol; a roll day if the second has more than threshold of its volume."""
    totals = tape.groupBy(*group, symbol).agg(F.sum(size).alias("v"))
    order = Window.partitionBy(*group).orderBy(F.desc("v"), symbol)
    ranked = totals.withColumn("n", F.row_number().over(order)).where("n <= 2")
    out = ranked.groupBy(*group).agg(F.max(F.when(F.col("n") == 1, F.col(symbol))).alias("front"), F.max(F.when(F.col("n") == 1, F.col("v"))).alias("front_volume"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("v"))), F.lit(0)).alias("second_volume"))
    return out.withColumn("is_roll_day", F.col("second_volume") > threshold * F.col("front_volume"))


def dense_bars(df: DataFrame, keys: list[str], minute: str = "minute", step: str = "1 minute") -> DataFrame:
    """Bars on every step between a group's first and last: close carried forward, open, high and low at it, volume zero.

    The spine is exploded by group; groups are sessions, so a group's rows are
    bounded by its length.
    """
    spine = df.groupBy(*keys).agg(F.min(minute).alias("lo"), F.max(minute).alias("hi")).select(*keys, F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias(minute))
    upto = Window.partitionBy(*keys).orderBy(minute).rowsBetween(Window.unboundedPreceding, 0)
    out = spine.join(df, [*keys, minute], "left").withColumn("filled", F.col("close").isNull()).withColumn("close", F.last("close", True).over(upto))
    return out.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")} | {"volume": F.coalesce("volume", F.lit(0))})


def session_grid(df: DataFrame, keys: list[str], start: str, minute: str = "minute", minutes: int = 1380) -> DataFrame:
    """keys, slot, minute, OHLC, volume, filled: every session on a grid of so many minutes from its start (a column of df, one value a session).

    The close is carried forward, and backward before the first bar; open, high
    and low of a missing minute take it, its volume is zero. Bars off the grid
    are left out; a session without a bar on it has no rows.
    """
    slot = (F.unix_seconds(minute) - F.unix_seconds(start)) / 60
    on = df.withColumn("slot", F.when(slot == F.floor(slot), slot.cast("int"))).where(F.col("slot").between(0, minutes - 1))
    spine = on.groupBy(*keys).agg(F.min(start).alias("_start")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))))
    x = spine.join(on.select(*keys, "slot", "open", "high", "low", "close", "volume"), [*keys, "slot"], "left").withColumn("filled", F.col("close").isNull())
    by = Window.partitionBy(*keys).orderBy("slot")
    # Backward as forward in the other order: a frame to the end would be read anew for every row.
    back = Window.partitionBy(*keys).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    close = F.coalesce(F.last("close", True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.last("close", True).over(back))
    x = x.withColumn("close", close).withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")} | {"volume": F.coalesce("volume", F.lit(0)), minute: F.col("_start") + F.make_interval(mins=F.col("slot"))})
    return x.select(*keys, "slot", minute, "open", "high", "low", "close", "volume", "filled")


def session_statistics(df: DataFrame, keys: list[str], minute: str, in_rth: Column) -> DataFrame:
    """Open, high, low, close and volume of the whole session and of its regular hours, in one pass."""
    at = F.col(minute)
    aggs = []
    for name, cond in (("globex", F.lit(True)), ("rth", in_rth)):
        when = lambda c, cond=cond: F.when(cond, F.col(c))
        key = F.when(cond, at)
        aggs += [
            F.min_by(when("open"), key).alias(f"{name}_open"), F.max(when("high")).alias(f"{name}_high"), F.min(when("low")).alias(f"{name}_low"), F.max_by(when("close"), key).alias(f"{name}_close"), F.coalesce(F.sum(when("volume")), F.lit(0)).cast("long").alias(f"{name}_volume"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def valid_sessions(df: DataFrame, keys: list[str], in_rth: Column) -> DataFrame:
    """The rows of sessions that have at least one row in regular hours."""
    good = df.groupBy(*keys).agg(F.max(in_rth).alias("ok")).where("ok").select(*keys)
    return df.join(good, keys, "left_semi")


def large_prints(tape: DataFrame, size: str, in_rth: Column, rth_size: int, other_size: int) -> DataFrame:
    """Prints of at least rth_size in regular hours, other_size outside."""
    return tape.where(F.when(in_rth, F.col(size) >= rth_size).otherwise(F.col(size) >= other_size))


def price_window(df: DataFrame, keys: list[str], inside: Column, low: float, high: float) -> DataFrame:
    """keys, lo, hi, verdict: whether the range within a time window lies in a price band (CONTAINED), meets it (TOUCHED) or not (OUTSIDE)."""
    r = df.where(inside).groupBy(*keys).agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    return r.withColumn("verdict", F.when((F.col("lo") >= low) & (F.col("hi") <= high), "CONTAINED").when((F.col("hi") >= low) & (F.col("lo") <= high), "TOUCHED").otherwise("OUTSIDE"))
