"""Order-book depth by second from order events.

Depth is additive: every event is a signed change of the size at a (side,
price). What an event changes depends only on its own order's state before it,
so the changes come from windows by (book, order); the depth of a level at the
end of a second is a running sum by (book, side, price). No task replays a
whole book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.market import fixed_point

BOOK = ["symbol", "session_date"]


def _lives(changes: DataFrame, epoch_size: int = 4096) -> DataFrame:
    """changes with life, the number of resets up to each, and sec, the latest second seen up to it in its book.

    Both are running figures of a book in order of the sequence; they are
    summed up by epoch, then within the epoch, so that no book is gathered.
    """
    sec = F.floor(F.unix_micros("ts") / 1_000_000)
    x = changes.withColumns({"block": F.expr(f"(seq - pmod(seq, {epoch_size})) DIV {epoch_size}"), "reset": (F.col("action") == "R").cast("int"), "own_sec": sec})
    sums = x.groupBy(*BOOK, "block").agg(F.sum("reset").alias("resets"), F.max("own_sec").alias("latest"))
    before = Window.partitionBy(*BOOK).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*BOOK, "block", F.coalesce(F.sum("resets").over(before), F.lit(0)).alias("earlier"), F.max("latest").over(before).alias("latest"))
    within = Window.partitionBy(*BOOK, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"life": F.coalesce(F.sum("reset").over(within), F.lit(0)), "sec": F.max("own_sec").over(within)}).join(sums, [*BOOK, "block"])
    return x.withColumns({"life": F.col("life") + F.col("earlier"), "sec": F.greatest("sec", "latest")}).drop("block", "reset", "own_sec", "earlier", "latest")


def depth_changes(changes: DataFrame) -> DataFrame:
    """book, seq, sec, side, px, delta: how each change moves the depth.

    changes: one row per change (symbol, session_date, seq, ts, action, side,
    px, sz, order_id). sec is the latest second that the book's changes up to
    it have shown, as clocks may step back; the same for all its levels. A enters and M replaces an order; C and F take off what
    is there at most; R ends every order's life at its place in the sequence.
    """
    r = _lives(changes)
    by = Window.partitionBy(*BOOK, "life", "order_id").orderBy("seq")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    isset = F.col("action").isin("A", "M")
    x = r.where(F.col("action").isin("A", "M", "C", "F") & F.col("order_id").isNotNull()).withColumn("epoch", F.sum(isset.cast("int")).over(upto)).where("epoch > 0")
    own = Window.partitionBy(*BOOK, "life", "order_id", "epoch").orderBy("seq")
    x = x.withColumns({"o_side": F.first(F.upper("side")).over(own), "o_px": F.first("px").over(own), "o_sz": F.first("sz").over(own)})
    taken = F.coalesce(F.sum(F.when(~isset, F.col("sz")).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    x = x.withColumn("left", F.greatest(F.col("o_sz") - taken, F.lit(0)))
    before = F.coalesce(F.lag("left").over(own), F.lit(0))
    x = x.withColumn("delta", F.col("left") - before)
    # A replacement takes off what was left of the order it replaces, at that order's level.
    old = F.struct(F.lag("o_side").over(by).alias("side"), F.lag("o_px").over(by).alias("px"), F.lag("left").over(by).alias("left"))
    x = x.withColumn("old", F.when(isset & (F.lag("left").over(by) > 0), old))
    cols = [*BOOK, "life", "seq", "sec"]
    here = x.where("delta <> 0").select(*cols, F.col("o_side").alias("side"), F.col("o_px").alias("px"), "delta")
    gone = x.where("old IS NOT NULL").select(*cols, F.col("old.side").alias("side"), F.col("old.px").alias("px"), (-F.col("old.left")).alias("delta"))
    return here.unionByName(gone)


def depth_by_second(changes: DataFrame) -> DataFrame:
    """book, life, sec, side, px, size: size of each level after each second in which it changed (0: gone).

    Seconds are those of depth_changes(), which follow the book's sequence.
    """
    per = depth_changes(changes).groupBy(*BOOK, "life", "sec", "side", "px").agg(F.sum("delta").alias("delta"))
    run = Window.partitionBy(*BOOK, "life", "side", "px").orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("size", F.sum("delta").over(run).cast("long")).drop("delta")


def _active(changes: DataFrame) -> DataFrame:
    """book, sec, nth: the seconds in which a book had an event, numbered."""
    seconds = _lives(changes).where("sec IS NOT NULL").select(*BOOK, "sec").distinct()
    return seconds.withColumn("nth", F.row_number().over(Window.partitionBy(*BOOK).orderBy("sec")))


def ladders(changes: DataFrame) -> DataFrame:
    """book, sec, side, px, size: the whole depth at the end of every second with an event.

    A level stands from the second it changes in to the next that changes it,
    or to the second of the reset that ends its life. Active seconds are
    numbered by book, so a level's stand is a range of numbers that is
    unfolded where it lies; nothing is joined by ranges.
    """
    lives = _lives(changes).where("sec IS NOT NULL")
    ends = lives.groupBy(*BOOK, "life").agg(F.min("sec").alias("start")).withColumn("end", F.lead("start").over(Window.partitionBy(*BOOK).orderBy("life"))).drop("start")
    nth = _active(changes)
    by = Window.partitionBy(*BOOK, "life", "side", "px").orderBy("sec")
    d = depth_by_second(changes).withColumn("until", F.lead("sec").over(by)).join(ends, [*BOOK, "life"]).withColumn("until", F.coalesce("until", "end")).where("size > 0 AND (until IS NULL OR until > sec)")
    d = d.join(nth, [*BOOK, "sec"]).drop("sec").join(nth.select(*BOOK, F.col("sec").alias("until"), F.col("nth").alias("stop")), [*BOOK, "until"], "left")
    last = nth.groupBy(*BOOK).agg(F.max("nth").alias("last"))
    d = d.join(last, BOOK).withColumn("nth", F.explode(F.sequence("nth", F.coalesce(F.col("stop") - 1, F.col("last")))))
    return d.join(nth, [*BOOK, "nth"]).select(*BOOK, "sec", "side", "px", "size")


def touch_by_second(ladder: DataFrame) -> DataFrame:
    """book, sec, best_bid, best_ask, and levels and size by side of ladders()."""
    bid, ask = F.col("side") == "B", F.col("side") == "A"
    return ladder.groupBy(*BOOK, "sec").agg(
        F.max(F.when(bid, F.col("px"))).alias("best_bid"), F.min(F.when(ask, F.col("px"))).alias("best_ask"), F.count_if(bid).alias("bid_levels"), F.count_if(ask).alias("ask_levels"),
        F.coalesce(F.sum(F.when(bid, F.col("size"))), F.lit(0)).alias("bid_size"), F.coalesce(F.sum(F.when(ask, F.col("size"))), F.lit(0)).alias("ask_size"),
    )


def with_trade_range(seconds: DataFrame, tape: DataFrame) -> DataFrame:
    """seconds (book, sec) with lo and hi: the range of prices traded in that second, null without a trade. tape: book, sec, px."""
    return seconds.join(tape.groupBy(*BOOK, "sec").agg(F.min("px").alias("lo"), F.max("px").alias("hi")), [*BOOK, "sec"], "left")


def cropped_ladders(ladder: DataFrame, tape: DataFrame, ticks: int, tick: int, times: float, window: int = 300) -> DataFrame:
    """book, sec, side, px, size, near, baseline: ladders() cropped around the market of each second.

    Near are levels within `ticks` of the span of the second's touch and traded
    prices. A farther level stays if its size is at least `times` the side's
    baseline: the median, over the seconds of the last `window` before, of the
    median size of the near levels; no farther level stays without a baseline.
    """
    t = with_trade_range(touch_by_second(ladder), tape)
    lo = F.least(F.coalesce("best_bid", "best_ask"), F.coalesce("lo", "best_bid", "best_ask")) - ticks * tick
    hi = F.greatest(F.coalesce("best_ask", "best_bid"), F.coalesce("hi", "best_ask", "best_bid")) + ticks * tick
    x = ladder.join(t.select(*BOOK, "sec", lo.alias("lo"), hi.alias("hi")), [*BOOK, "sec"]).withColumn("near", F.col("px").between(F.col("lo"), F.col("hi")))
    each = x.where("near").groupBy(*BOOK, "side", "sec").agg(F.percentile("size", 0.5).alias("m"))
    seconds = x.select(*BOOK, "side", "sec").distinct().join(each, [*BOOK, "side", "sec"], "left")
    past = F.array_sort(F.collect_list("m").over(Window.partitionBy(*BOOK, "side").orderBy("sec").rangeBetween(-window + 1, -1)))
    base = seconds.withColumn("_p", past).withColumn("baseline", F.when(F.size("_p") > 0, (F.element_at("_p", F.floor((F.size("_p") + 1) / 2).cast("int")) + F.element_at("_p", F.floor(F.size("_p") / 2 + 1).cast("int"))) / 2))
    x = x.join(base.select(*BOOK, "side", "sec", "baseline"), [*BOOK, "side", "sec"])
    return x.where(F.col("near") | (F.col("size") >= times * F.col("baseline"))).select(*BOOK, "sec", "side", "px", "size", "near", "baseline")


def final_depth(state: DataFrame) -> DataFrame:
    """book, side, price, size, orders: depth of each level from the orders resting in it (as changes.current_state())."""
    return state.groupBy(*BOOK, "side", "px").agg(F.sum("sz").cast("long").alias("size"), F.count(F.lit(1)).alias("orders")).withColumn("price", fixed_point(F.col("px"))).drop("px")


def best_quotes(depth: DataFrame) -> DataFrame:
    """book, best_bid, best_ask of levels (side, price)."""
    return depth.groupBy(*BOOK).agg(F.max(F.when(F.col("side") == "B", F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == "A", F.col("price"))).alias("best_ask"))


def cropped(depth: DataFrame, ticks: int, tick: float, times: float) -> DataFrame:
    """Levels within `ticks` of the best quotes, and farther ones of at least `times` the median size within."""
    q = best_quotes(depth)
    x = depth.join(q, BOOK)
    near = (F.col("price") >= F.coalesce("best_bid", "best_ask") - ticks * tick) & (F.col("price") <= F.coalesce("best_ask", "best_bid") + ticks * tick)
    x = x.withColumn("near", near)
    base = x.where("near").groupBy(*BOOK, "side").agg((F.percentile("size", 0.5) * times).alias("least"))
    return x.join(base, [*BOOK, "side"], "left").where("near OR size >= least").drop("best_bid", "best_ask", "least")
