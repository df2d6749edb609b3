"""Multi-step bar patterns as conditional first positions over a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breakout_retest(df: DataFrame, keys: list[str], high: Column, low: Column, start: Column, retest_high: Column, retest_low: Column, bars: int = 60) -> DataFrame:
    """keys, direction, breakout, retest (minutes): the first close beyond a range from `start` on and the first touch of a level within so many bars after it.

    The earlier side breaks out, long on a tie. A long retest touches
    retest_high from above, a short one retest_low from below. No row without a
    breakout; retest is null if none comes in time.
    """
    w = Window.partitionBy(*keys)
    x = df.withColumns({"_pos": F.row_number().over(w.orderBy("minute")), "_go": F.col("minute") >= start})
    x = x.withColumns({"_up": F.min(F.when(F.col("_go") & (F.col("close") > high), F.col("_pos"))).over(w), "_down": F.min(F.when(F.col("_go") & (F.col("close") < low), F.col("_pos"))).over(w)})
    long_ = F.col("_up").isNotNull() & (F.col("_down").isNull() | (F.col("_up") <= F.col("_down")))
    at = F.least("_up", "_down")
    touch = F.when(long_, F.col("low") <= retest_high).otherwise(F.col("high") >= retest_low)
    within = (F.col("_pos") > at) & (F.col("_pos") <= at + bars)
    return x.where(at.isNotNull()).groupBy(*keys, F.when(long_, "long").otherwise("short").alias("direction")).agg(F.min(F.when(F.col("_pos") == at, F.col("minute"))).alias("breakout"), F.min(F.when(within & touch, F.col("minute"))).alias("retest"))


def first_gap(df: DataFrame, keys: list[str], minutes: int = 15, search: int = 120) -> DataFrame:
    """keys, kind, gap_low, gap_high, confirmed: the first three-bar gap of the coarser bars within `search` minutes of the session's start, known at its third bar's end."""
    start = F.min("minute").over(Window.partitionBy(*keys))
    x = df.withColumn("_start", start).where(F.col("minute") <= F.col("_start") + F.make_interval(mins=F.lit(search)))
    c = x.groupBy(*keys, F.window("minute", f"{minutes} minutes")["start"].alias("t")).agg(F.max("high").alias("high"), F.min("low").alias("low"))
    w = Window.partitionBy(*keys).orderBy("t")
    h1, l1 = F.lag("high", 2).over(w), F.lag("low", 2).over(w)
    c = c.withColumns({"kind": F.when(F.col("low") > h1, "bullish").when(F.col("high") < l1, "bearish"), "gap_low": F.when(F.col("low") > h1, h1).otherwise(F.col("high")), "gap_high": F.when(F.col("low") > h1, F.col("low")).otherwise(l1)}).where("kind IS NOT NULL")
    first = c.groupBy(*keys).agg(F.min(F.struct("t", "kind", "gap_low", "gap_high")).alias("g"))
    return first.select(*keys, "g.kind", "g.gap_low", "g.gap_high", (F.col("g.t") + F.make_interval(mins=F.lit(minutes))).alias("confirmed"))


def inverse_gap_trades(df: DataFrame, keys: list[str], minutes: int = 15, search: int = 120, wait: int = 60, close_after: int = 360) -> DataFrame:
    """One trade per session at most: first gap of coarse bars, price enters it, then runs through the latest opposite gap of the fine bars.

    A body beyond the gap's far edge ends it. The stop is the extreme since the
    gap was confirmed, the target the session's extreme so far; no trade if the
    target is not ahead. The target wins a tie; else the last close ends it.
    """
    gap = first_gap(df, keys, minutes, search)
    w = Window.partitionBy(*keys).orderBy("minute")
    start = F.min("minute").over(Window.partitionBy(*keys))
    x = df.withColumn("_start", start).join(gap, keys)
    bull = F.col("kind") == "bullish"
    body_lo, body_hi = F.least("open", "close"), F.greatest("open", "close")
    # The extremes of the whole session so far and of the bars since confirmation.
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    since = F.col("minute") > F.col("confirmed")
    x = x.withColumns({
        "_top": F.max("high").over(upto), "_low": F.min("low").over(upto), "_since": since,
        "_slo": F.min(F.when(since, F.col("low"))).over(upto), "_shi": F.max(F.when(since, F.col("high"))).over(upto),
        "_broken": since & F.when(bull, body_lo < F.col("gap_low")).otherwise(body_hi > F.col("gap_high")),
        "_enters": since & F.when(bull, (F.col("low") <= F.col("gap_high")) & (F.col("close") > F.col("gap_low"))).otherwise((F.col("high") >= F.col("gap_low")) & (F.col("close") < F.col("gap_high"))),
    })
    # Fine gaps against the coarse one, among bars since confirmation; the last one seen.
    all3 = F.lag("_since", 2).over(w)
    h2, l2, o1, c1 = F.lag("high", 2).over(w), F.lag("low", 2).over(w), F.lag("open", 1).over(w), F.lag("close", 1).over(w)
    opposite = F.when(bull & (F.col("high") < l2) & (c1 < o1), l2).when(~bull & (F.col("low") > h2) & (c1 > o1), h2)
    x = x.withColumn("_edge", F.last(F.when(all3, opposite), True).over(upto))
    whole = Window.partitionBy(*keys)
    limit = F.col("confirmed") + F.make_interval(mins=F.lit(wait))
    x = x.withColumns({"_in": F.min(F.when(F.col("_enters") & ~F.col("_broken") & (F.col("minute") <= limit), F.col("minute"))).over(whole), "_out": F.min(F.when(F.col("_broken"), F.col("minute"))).over(whole)})
    runs = F.when(bull, (F.col("close") > F.col("open")) & (F.col("close") > F.col("_edge"))).otherwise((F.col("close") < F.col("open")) & (F.col("close") < F.col("_edge")))
    ok = (F.col("minute") > F.col("_in")) & (F.col("minute") <= F.col("_start") + F.make_interval(mins=F.lit(close_after))) & (F.col("_out").isNull() | ((F.col("_in") < F.col("_out")) & (F.col("minute") < F.col("_out"))))
    entry = F.min(F.when(ok & runs, F.struct("minute", "close", F.when(bull, F.col("_slo")).otherwise(F.col("_shi")).alias("sl"), F.when(bull, F.col("_top")).otherwise(F.col("_low")).alias("tp")))).over(whole)
    x = x.withColumn("e", entry).where(F.col("e").isNotNull() & F.when(bull, F.col("e.tp") > F.col("e.close")).otherwise(F.col("e.tp") < F.col("e.close")) & (F.col("minute") > F.col("e.minute")))
    hit_tp = F.when(bull, F.col("high") >= F.col("e.tp")).otherwise(F.col("low") <= F.col("e.tp"))
    hit_sl = F.when(bull, F.col("low") <= F.col("e.sl")).otherwise(F.col("high") >= F.col("e.sl"))
    t = x.groupBy(*keys, "kind").agg(F.first("e").alias("e"), F.min(F.when(hit_tp, F.col("minute"))).alias("a"), F.min(F.when(hit_sl, F.col("minute"))).alias("b"), F.max(F.struct("minute", "close")).alias("z"))
    won = F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a") <= F.col("b")))
    side = F.when(F.col("kind") == "bullish", 1.0).otherwise(-1.0)
    price = F.when(won, F.col("e.tp")).when(F.col("b").isNotNull(), F.col("e.sl")).otherwise(F.col("z.close"))
    return t.select(*keys, F.when(F.col("kind") == "bullish", "long").otherwise("short").alias("direction"), F.col("e.minute").alias("entry_minute"), F.coalesce(F.when(won, F.col("a")), F.col("b"), F.col("z.minute")).alias("exit_minute"), F.col("e.close").alias("entry_price"), price.alias("exit_price"), F.col("e.sl").alias("sl"), F.col("e.tp").alias("tp"), F.when(won, "tp").when(F.col("b").isNotNull(), "sl").otherwise("eod").alias("exit_reason"), (side * (price - F.col("e.close"))).alias("pnl_points"))
