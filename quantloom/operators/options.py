"""Option prints, open interest and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.market import aggressor, fine


def classified(prints: DataFrame) -> DataFrame:
    """One row per print_id with aggressor (1, -1, 0) and dealer flow (a bought print is -size); prints without time or price are left out.

    Repeats of a print are the same print; the copy received first holds.
    """
    names = [c for c in prints.columns if c not in ("print_id", "ts_recv")]
    one = prints.where("print_id IS NOT NULL").groupBy("print_id").agg(F.min(F.struct("ts_recv", *names)).alias("x")).select("print_id", *[f"x.{n}" for n in names])
    a = aggressor(F.col("price"), F.col("bid_px"), F.col("ask_px"), F.col("side"))
    out = one.where(F.col("ts_event").isNotNull() & fine(F.col("price")).isNotNull()).withColumn("aggressor", F.coalesce(a, F.lit(0)))
    return out.withColumn("flow", -F.col("aggressor") * F.col("size"))


def five_minute(prints: DataFrame, minutes: int = 5) -> DataFrame:
    """instrument_id, bucket, OHLC, volume, buy, sell, closing quote, flow and running flow of the session (UTC day from 22:00)."""
    order = F.struct("ts_event", "print_id")
    width = minutes * 60
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("ts_event") / width) * width)
    g = prints.groupBy("instrument_id", bucket.alias("bucket")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"),
        F.sum(F.when(F.col("aggressor") > 0, F.col("size")).otherwise(0)).alias("buy_volume"), F.sum(F.when(F.col("aggressor") < 0, F.col("size")).otherwise(0)).alias("sell_volume"),
        F.max_by("bid_px", order).alias("bid"), F.max_by("ask_px", order).alias("ask"), F.sum("flow").alias("flow"),
    )
    session = F.to_date(F.col("bucket") + F.expr("INTERVAL 2 HOURS"))
    w = Window.partitionBy("instrument_id", session).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("session_flow", F.sum("flow").over(w))


def latest_publication(pubs: DataFrame, by: list[str], order: Column, columns: list[str]) -> DataFrame:
    """by, columns: of each group the row with the greatest order."""
    return pubs.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("x")).select(*by, "x.*")


def open_interest_in_force(pubs: DataFrame) -> DataFrame:
    """instrument_id, day, evening, morning, in_force: a day's open interest by publication; the morning's replaces the evening's, and the day before's stays until one comes."""
    t = F.lower(F.trim("snapshot_type"))
    ok = pubs.where("open_interest IS NOT NULL AND snapshot_time IS NOT NULL").withColumns({"day": F.to_date("snapshot_time"), "kind": t}).where(F.col("kind").isin("evening", "morning"))
    best = latest_publication(ok, ["instrument_id", "day", "kind"], F.struct("snapshot_time", "snapshot_id"), ["open_interest"])
    p = best.groupBy("instrument_id", "day").agg(F.max(F.when(F.col("kind") == "evening", F.col("open_interest"))).alias("evening"), F.max(F.when(F.col("kind") == "morning", F.col("open_interest"))).alias("morning"))
    w = Window.partitionBy("instrument_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("in_force", F.last(F.coalesce("morning", "evening"), True).over(w))


def tombstones(seen: DataFrame, contracts: DataFrame) -> DataFrame:
    """instrument_id, expiry, open_interest -1: a last row for every contract seen whose expiry has passed in the data."""
    now = seen.agg(F.max("snapshot_time")).scalar()  # one row
    ids = seen.select("instrument_id").distinct()
    gone = contracts.where("expiry IS NOT NULL").groupBy("instrument_id").agg(F.max("expiry").alias("expiry")).join(ids, "instrument_id", "left_semi")
    return gone.where(F.col("expiry") <= now).select("instrument_id", "expiry", F.lit(-1).alias("open_interest"))


def front_expiry(contracts: DataFrame, day: str) -> DataFrame:
    """underlying, day, front, second: the nearest two expiries still to come on each day."""
    e = contracts.where("expiry IS NOT NULL AND underlying IS NOT NULL").select("underlying", F.col(day).alias("day"), F.to_date("expiry").alias("e")).distinct().where("e >= day")
    n = F.row_number().over(Window.partitionBy("underlying", "day").orderBy("e"))
    return e.withColumn("n", n).where("n <= 2").groupBy("underlying", "day").agg(F.max(F.when(F.col("n") == 1, F.col("e"))).alias("front"), F.max(F.when(F.col("n") == 2, F.col("e"))).alias("second"))


def modal_multiplier(pubs: DataFrame) -> DataFrame:
    """underlying, multiplier: the most frequent one that is not zero (the smaller on a tie)."""
    c = pubs.where("multiplier <> 0").groupBy("underlying", "multiplier").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("underlying").agg(F.max_by("multiplier", F.struct("n", -F.col("multiplier"))).alias("multiplier"))
