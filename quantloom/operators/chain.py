"""Option chain rows by five-minute bucket, with the state each contract carries across sessions.

A row exists where a contract traded, had open interest published, had a
spread leg traded, or expired. All of these are events by (contract, bucket);
they meet in one aggregate, so that a bucket with several has one row. What a
row carries (the last quotes, flows, open interest, last session's net) comes
from running windows by contract over buckets and publications: as many rows as
buckets with an event, not as prints, however busy the contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.options import five_minute, latest_publication

KINDS = ("traded", "interest", "spread", "expired")


def session_of(ts: Column | str) -> Column:
    """The session's day: it begins at 22:00 UTC of the day before."""
    return F.to_date((F.col(ts) if isinstance(ts, str) else ts) + F.expr("INTERVAL 2 HOURS"))


def _bucket(ts: Column, minutes: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / (minutes * 60)) * minutes * 60)


def publications(pubs: DataFrame) -> DataFrame:
    """instrument_id, session, kind, ts, oi: the latest evening and morning publication of each session."""
    kind = F.lower(F.trim("snapshot_type"))
    ok = pubs.where("instrument_id IS NOT NULL AND open_interest IS NOT NULL AND snapshot_time IS NOT NULL").withColumns({"kind": kind, "session": session_of("snapshot_time"), "ts": F.col("snapshot_time"), "oi": F.col("open_interest").cast("long")})
    return latest_publication(ok.where(F.col("kind").isin("evening", "morning")), ["instrument_id", "session", "kind"], F.struct("snapshot_time", "snapshot_id"), ["ts", "oi"])


def chain_rows(prints: DataFrame, pubs: DataFrame, contracts: DataFrame, legs: DataFrame | None = None, minutes: int = 5) -> DataFrame:
    """instrument_id, bucket, kind and the columns of a chain row.

    prints and legs: as of options.classified(), outright trades and legs of
    spreads. contracts: instrument_id, expiry. kind: traded; interest (a
    publication without a trade); spread (a leg without either); expired, one
    row of open interest -1 at the bucket of the expiry plus a second for a
    contract that had rows before, if the data reach so far. Trades and
    publications after the expiry are left out.

    bid, ask: the pair of the contract's last trade, stale if that is none of
    this bucket. dealer_oi_flow and dealer_oi_flow_spread run over all
    sessions. open_interest is the last publication before the bucket's end,
    null before any; is_morning_update if it is this session's morning one.
    daily_estimated_oi adds what was bought less sold in this session, and in
    the session before as long as this session's evening number has not come.
    """
    expiry = contracts.where("instrument_id IS NOT NULL AND expiry IS NOT NULL").groupBy("instrument_id").agg(F.max("expiry").alias("expiry"))
    alive = lambda df, ts: df.join(expiry, "instrument_id", "left").where(f"expiry IS NULL OR {ts} <= expiry")
    traded = five_minute(alive(prints, "ts_event").drop("expiry"), minutes)
    names = ["open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "bid", "ask", "flow"]
    events = traded.select("instrument_id", "bucket", F.lit(0).alias("rank"), F.struct(*names).alias("t"))
    published = alive(publications(pubs), "ts").drop("expiry")
    shown = published.join(expiry, "instrument_id", "left").withColumn("bucket", _bucket(F.col("ts"), minutes)).where("expiry IS NULL OR bucket < expiry")
    events = events.unionByName(shown.select("instrument_id", "bucket", F.lit(1).alias("rank")), allowMissingColumns=True)
    if legs is not None:
        a, n = F.col("aggressor"), F.col("size")
        spread = alive(legs, "ts_event").groupBy("instrument_id", _bucket(F.col("ts_event"), minutes).alias("bucket")).agg(F.sum(n).alias("volume"), F.sum(F.when(a > 0, n).otherwise(0)).alias("buy"), F.sum(F.when(a < 0, n).otherwise(0)).alias("sell"), F.sum("flow").alias("flow"))
        events = events.unionByName(spread.select("instrument_id", "bucket", F.lit(2).alias("rank"), F.struct("volume", "buy", "sell", "flow").alias("s")), allowMissingColumns=True)
    else:
        events = events.withColumn("s", F.lit(None).cast("struct<volume:bigint,buy:bigint,sell:bigint,flow:bigint>"))
    end = F.greatest(prints.agg(F.max("ts_event")).scalar(), pubs.agg(F.max("snapshot_time")).scalar())
    gone = expiry.where(F.col("expiry") <= end).select("instrument_id", _bucket(F.col("expiry") + F.expr("INTERVAL 1 SECOND"), minutes).alias("bucket"), F.lit(3).alias("rank"))
    events = events.unionByName(gone, allowMissingColumns=True)
    rows = events.groupBy("instrument_id", "bucket").agg(F.min("rank").alias("rank"), F.max("t").alias("t"), F.max("s").alias("s"))

    by = Window.partitionBy("instrument_id").orderBy("bucket")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    flow, spread_flow = F.coalesce("t.flow", F.lit(0)), F.coalesce("s.flow", F.lit(0))
    rows = rows.withColumn("before", F.lag("bucket").over(by)).where("rank < 3 OR before IS NOT NULL").drop("before")
    rows = rows.withColumns({"session": session_of("bucket"), "net": -flow - spread_flow})
    in_session = Window.partitionBy("instrument_id", "session").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "quotes": F.last(F.when(F.col("t").isNotNull(), F.struct("t.bid", "t.ask")), True).over(upto),
        "dealer_oi_flow": F.sum(flow).over(upto), "dealer_oi_flow_spread": F.sum(spread_flow).over(upto), "session_net": F.sum("net").over(in_session),
    })
    # The net of the session before, in the calendar of all sessions.
    sessions = rows.select("session").distinct().withColumn("nth", F.row_number().over(Window.orderBy("session")))  # one row per day
    totals = rows.groupBy("instrument_id", "session").agg(F.sum("net").alias("net")).join(sessions, "session")
    own = Window.partitionBy("instrument_id").orderBy("nth")
    totals = totals.select("instrument_id", "session", F.when(F.lag("nth").over(own) == F.col("nth") - 1, F.lag("net").over(own)).alias("net_before"))
    rows = rows.drop("net").join(totals, ["instrument_id", "session"])
    # Open interest as of the bucket's end: publications sort into the rows, a row before what comes at its very end.
    at_end = rows.withColumns({"at": F.col("bucket") + F.make_interval(mins=F.lit(minutes)), "is_pub": F.lit(False)})
    marks = published.select("instrument_id", "session", F.col("ts").alias("at"), F.lit(True).alias("is_pub"), F.struct("oi", "kind", "session").alias("p"))
    both = at_end.unionByName(marks, allowMissingColumns=True)
    seen = Window.partitionBy("instrument_id").orderBy("at", "is_pub", "p.kind").rowsBetween(Window.unboundedPreceding, 0)
    seen_now = Window.partitionBy("instrument_id", "session").orderBy("at", "is_pub").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"in_force": F.last("p", True).over(seen), "landed": F.max((F.col("p.kind") == "evening").cast("int")).over(seen_now)}).where("NOT is_pub")
    dead = F.col("rank") == 3
    oi = F.when(dead, -1).otherwise(F.col("in_force.oi"))
    estimate = F.col("in_force.oi") + F.col("session_net") + F.when(F.coalesce("landed", F.lit(0)) == 1, 0).otherwise(F.coalesce("net_before", F.lit(0)))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return both.select(
        "instrument_id", "bucket", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1).alias("kind"), "t.open", "t.high", "t.low", "t.close", zero("t.volume", "volume"), zero("t.buy_volume", "buy_volume"), zero("t.sell_volume", "sell_volume"), zero("s.volume", "spread_volume"), zero("s.buy", "spread_buy_volume"), zero("s.sell", "spread_sell_volume"),
        "quotes.bid", "quotes.ask", F.col("t").isNull().alias("is_stale_quote"), oi.alias("open_interest"), (~dead & F.coalesce((F.col("in_force.kind") == "morning") & (F.col("in_force.session") == F.col("session")), F.lit(False))).alias("is_morning_update"),
        F.when(dead, -1).otherwise(estimate).cast("long").alias("daily_estimated_oi"), F.col("dealer_oi_flow").cast("long"), F.col("dealer_oi_flow_spread").cast("long"),
    )
