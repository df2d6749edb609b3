"""Rule-based strategies over session bars, as column expressions.

Bars come with keys (asset, session day), a time column `minute`, OHLC and
volume. All positional logic is windows over one session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.market import ratio


def _first(cond: Column, pos: str = "pos") -> Column:
    return F.min(F.when(cond, F.col(pos)))


def opening_range(df: DataFrame, keys: list[str], range_minutes: int | Column = 15, stop_factor: float | Column = 1.0, reward: float | Column = 2.0, timeout_minutes: int | Column = 120) -> DataFrame:
    """Opening-range breakout: one trade per session at most.

    The range is that of the first range_minutes. The first later bar (not the
    last) that closes beyond it in its own direction signals; entry is the next
    open. Up to the timeout the first of stop and target wins, the stop on a
    tie. From the timeout bar on: out at its close if in profit, else the
    target moves to the entry and the race goes on; the session's last close
    ends it.
    """
    w = Window.partitionBy(*keys).orderBy("minute")
    whole = Window.partitionBy(*keys)
    x = df.withColumns({"pos": F.row_number().over(w), "n": F.count(F.lit(1)).over(whole), "start": F.min("minute").over(whole), "next_open": F.lead("open").over(w), "next_minute": F.lead("minute").over(w)})
    early = F.col("minute") < F.col("start") + F.make_interval(mins=F.lit(range_minutes))
    x = x.withColumns({"hi": F.max(F.when(early, F.col("high"))).over(whole), "lo": F.min(F.when(early, F.col("low"))).over(whole), "early": early})
    x = x.withColumns({"go": ~F.col("early") & (F.col("pos") < F.col("n")) & (F.col("hi") > F.col("lo")), "up": (F.col("close") > F.col("hi")) & (F.col("close") > F.col("open")), "down": (F.col("close") < F.col("lo")) & (F.col("close") < F.col("open"))})
    sig = F.when(F.col("go") & (F.col("up") | F.col("down")), F.struct("pos", "up", "next_open", "next_minute"))
    x = x.withColumn("sig", F.min(sig).over(whole)).where("sig IS NOT NULL AND pos > sig.pos")
    entry, long_ = F.col("sig.next_open"), F.col("sig.up")
    dist = (F.col("hi") - F.col("lo")) * stop_factor
    side = F.when(long_, 1.0).otherwise(-1.0)
    x = x.withColumns({"entry_price": entry, "sl": entry - side * dist, "tp": entry + side * dist * reward, "late": F.col("minute") >= F.col("sig.next_minute") + F.make_interval(mins=F.lit(timeout_minutes))})
    hit = lambda level: F.when(long_, F.col("high") >= level).otherwise(F.col("low") <= level)
    stopped = F.when(long_, F.col("low") <= F.col("sl")).otherwise(F.col("high") >= F.col("sl"))
    x = x.withColumns({"stopped": stopped, "reached": hit(F.col("tp")), "even": hit(F.col("entry_price"))})
    bar = F.struct("pos", "minute", "close")
    g = x.groupBy(*keys).agg(
        F.first("sig").alias("sig"), F.max("entry_price").alias("entry_price"), F.max("sl").alias("sl"), F.max("tp").alias("tp"),
        F.min(F.when(F.col("stopped") & ~F.col("late"), bar)).alias("s1"), F.min(F.when(F.col("reached") & ~F.col("late"), bar)).alias("t1"),
        F.min(F.when(F.col("late"), bar)).alias("out"), F.min(F.when(F.col("stopped") & F.col("late"), bar)).alias("s2"), F.min(F.when(F.col("even") & F.col("late"), bar)).alias("t2"), F.max(bar).alias("end"),
    )
    up = F.col("sig.up")
    first = lambda a, b: F.col(f"{a}.pos").isNotNull() & (F.col(f"{b}.pos").isNull() | (F.col(f"{a}.pos") <= F.col(f"{b}.pos")))
    gain = F.col("out.close").isNotNull() & F.when(up, F.col("out.close") > F.col("entry_price")).otherwise(F.col("out.close") < F.col("entry_price"))
    reason = F.when(first("s1", "t1"), "sl").when(F.col("t1.pos").isNotNull(), "tp").when(F.col("out.pos").isNull(), "eod").when(gain, "timeout_profit").when(first("s2", "t2"), "sl_late").when(F.col("t2.pos").isNotNull(), "tp_even").otherwise("eod")
    g = g.withColumn("r", reason)
    pick = lambda f: F.when(F.col("r") == "sl", F.col(f"s1.{f}")).when(F.col("r") == "tp", F.col(f"t1.{f}")).when(F.col("r") == "timeout_profit", F.col(f"out.{f}")).when(F.col("r") == "sl_late", F.col(f"s2.{f}")).when(F.col("r") == "tp_even", F.col(f"t2.{f}")).otherwise(F.col(f"end.{f}"))
    price = F.when(F.col("r").isin("sl", "sl_late"), F.col("sl")).when(F.col("r") == "tp", F.col("tp")).when(F.col("r") == "tp_even", F.col("entry_price")).otherwise(pick("close"))
    g = g.withColumns({"exit_price": price, "exit_minute": pick("minute"), "tp": F.when(F.col("r").isin("sl_late", "tp_even") | ((F.col("r") == "eod") & F.col("out.pos").isNotNull()), F.col("entry_price")).otherwise(F.col("tp"))})
    return g.select(*keys, F.when(up, "long").otherwise("short").alias("direction"), F.col("sig.next_minute").alias("entry_minute"), "exit_minute", "entry_price", "exit_price", "sl", "tp", F.when(F.col("r") == "sl_late", "sl").when(F.col("r") == "tp_even", "tp").otherwise(F.col("r")).alias("exit_reason"), (F.when(up, 1.0).otherwise(-1.0) * (F.col("exit_price") - F.col("entry_price"))).alias("pnl_points"))


def vwap_trend(df: DataFrame, keys: list[str], vwap: str, band: float = 0.0, carry_forward: bool = True, skip_zero_volume: bool = True, excluded: Column | None = None) -> DataFrame:
    """Stop and reverse on the side of the average: one row per trade.

    A bar decides at its close, the position changes at the next open; a flip
    closes and opens at the same fill, the last bar's decision is discarded and
    an open position ends at its close. A null average or a bar without volume
    is no signal and carries the side; a close within the band carries too, or
    goes flat. Excluded bars are flat and nothing is carried across them.
    """
    excl = F.lit(False) if excluded is None else excluded
    w = Window.partitionBy(*keys).orderBy("minute")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    none = F.col(vwap).isNull()
    if skip_zero_volume:
        none = none | (F.col("volume") == 0)
    code = F.when(none, None).when(F.col("close") > F.col(vwap) + band, 1).when(F.col("close") < F.col(vwap) - band, -1)
    code = code if carry_forward else F.when(none, None).otherwise(F.coalesce(code, F.lit(0)))
    x = df.withColumns({"excl": excl, "code": code, "pos": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    x = x.withColumn("isle", F.sum(F.col("excl").cast("int")).over(upto))
    held = Window.partitionBy(*keys, "isle").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("side", F.when(F.col("excl"), 0).otherwise(F.coalesce(F.last(F.when(~F.col("excl"), F.col("code")), True).over(held), F.lit(0))))
    x = x.withColumn("during", F.when(F.col("excl") | (F.col("pos") == 1), 0).otherwise(F.coalesce(F.lag("side").over(w), F.lit(0))))
    x = x.withColumn("turn", (F.col("during") != F.coalesce(F.lag("during").over(w), F.lit(0))).cast("int"))
    x = x.withColumns({"trade": F.sum("turn").over(upto), "next_open": F.lead("open").over(w), "next_minute": F.lead("minute").over(w), "next_during": F.lead("during").over(w), "next_excl": F.lead("excl").over(w)}).where("n >= 2")
    bar = F.struct("pos", "minute", "open", "close", "next_open", "next_minute", "next_during", "next_excl")
    t = x.where("during <> 0").groupBy(*keys, "trade", "during").agg(F.min(bar).alias("a"), F.max(bar).alias("b"), F.count(F.lit(1)).alias("bars_held"))
    eod = F.col("b.next_minute").isNull()
    return t.select(
        *keys, F.when(F.col("during") > 0, "long").otherwise("short").alias("direction"), F.col("a.minute").alias("entry_minute"), F.when(eod, F.col("b.minute")).otherwise(F.col("b.next_minute")).alias("exit_minute"), F.col("a.open").alias("entry_price"),
        F.when(eod, F.col("b.close")).otherwise(F.col("b.next_open")).alias("exit_price"), F.when(eod, "eod").when(F.col("b.next_excl"), "exclusion").when(F.col("b.next_during") != 0, "vwap_flip").otherwise("band_flat").alias("exit_reason"), "bars_held",
        (F.col("during") * (F.when(eod, F.col("b.close")).otherwise(F.col("b.next_open")) - F.col("a.open"))).alias("pnl_points"),
    )


def sweep(bars: DataFrame, combos: list[dict], run, keys: list[str], name: str = "combo") -> DataFrame:
    """run(bars, keys, **parameters) for every combination in one plan: the bars are read once.

    The combinations are unfolded as columns, which become keys of the run, and
    run gets them as columns; so the work is spread by (keys, combination). The
    result leads with the combination's number and parameters. No combination
    gives no rows.
    """
    axes = list(combos[0]) if combos else []
    each = F.array(*[F.struct(F.lit(i).alias(name), *[F.lit(c[k]).alias(k) for k in axes]) for i, c in enumerate(combos)]) if combos else F.array().cast(f"array<struct<{name}:int>>")
    x = bars.withColumn("_c", F.explode(each)).select(*bars.columns, f"_c.{name}", *[f"_c.{k}" for k in axes])
    out = run(x, [name, *axes, *keys], **{k: F.col(k) for k in axes})
    return out.select(name, *axes, *[c for c in out.columns if c not in (name, *axes)])


def combinations(axes: dict[str, list]) -> list[dict]:
    """The Cartesian product of the axes, the first slowest."""
    out: list[dict] = [{}]
    for k, values in axes.items():
        out = [c | {k: v} for c in out for v in values]
    return out


def number_range(lo: float, hi: float, step: float) -> list[float]:
    """lo, lo + step, ... up to and with hi, without float dust."""
    n = int((hi - lo) / step + 1e-9)
    out = [round(lo + i * step, 10) for i in range(n + 1)]
    return out if abs(out[-1] - hi) < 1e-9 else [*out, hi]


def gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with gap: 'bull' where the low is above the high two bars before, 'bear' the other way, and the gap's edges."""
    w = Window.partitionBy(*keys).orderBy("minute")
    h2, l2 = F.lag("high", 2).over(w), F.lag("low", 2).over(w)
    return df.withColumns({"gap": F.when(F.col("low") > h2, "bull").when(F.col("high") < l2, "bear"), "gap_low": F.when(F.col("low") > h2, h2).when(F.col("high") < l2, F.col("high")), "gap_high": F.when(F.col("low") > h2, F.col("low")).when(F.col("high") < l2, l2)})


def candle_shape(df: DataFrame) -> DataFrame:
    """Adds body, upper, lower: their shares of the bar's range (null for a bar without one), and direction."""
    rng = F.col("high") - F.col("low")
    return df.withColumns({"body": ratio(F.abs(F.col("close") - F.col("open")), rng), "upper": ratio(F.col("high") - F.greatest("open", "close"), rng), "lower": ratio(F.least("open", "close") - F.col("low"), rng), "direction": F.signum(F.col("close") - F.col("open"))})
