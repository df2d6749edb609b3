"""Whole regime detectors: from bars to a labelled state at every snapshot of every session.

A session is boiled down to sums at its clock times; yardsticks are robust
centres and scales of the same clock over the sessions before (by session
number, so that a session without the clock takes its place); the label follows
from all scores of an asset in order of time, chained from session to session.
Everything is a window over the small rows of sessions and clocks; only the
first step reads bars, by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import folds, regimes

STATES = ("high", "normal", "low")


def numbered(df: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """df with nth: the number of its session among those of its keys, and window: how many sessions lie before it."""
    days = df.select(*keys, day).distinct().withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(day)))
    return df.join(days, [*keys, day])


def chained_states(z: DataFrame, keys: list[str], score: str, enter: tuple[float, float], leave: tuple[float, float], names: tuple[str, str, str] = STATES) -> DataFrame:
    """z with state and chain_reset: hysteresis over an asset's snapshots in order of (nth, clock).

    A session goes on from the last label of the session before; if that is
    unknown, or there is none, it begins at the middle state (chain_reset).
    """
    last = z.groupBy(*keys, "nth").agg(F.max_by(F.col(score).isNotNull(), "clock").alias("_ended"))
    own = Window.partitionBy(*keys).orderBy("nth")
    last = last.withColumn("chain_reset", ~F.coalesce(F.lag("_ended").over(own), F.lit(False)))
    last = last.withColumn("_chain", F.sum(F.col("chain_reset").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_ended")
    return folds.hysteresis(z.join(last, [*keys, "nth"]), [*keys, "_chain"], ["nth", "clock"], score, names, enter, leave).drop("_chain")


def volatility(
    bars: DataFrame,
    keys: list[str],
    clock: Column,
    open_clock: int,
    close_clock: int,
    minutes: int = 30,
    lookback: int = 120,
    horizons: tuple[int, ...] = (1, 5, 22),
    least_days: int = 60,
    overnight_bars: float = 60.0,
    blend_k: float = 30.0,
    enter: tuple[float, float] = (1.0, -1.0),
    leave: tuple[float, float] = (0.5, -0.5),
    drop_idle: bool = False,
) -> DataFrame:
    """keys, day, clock, n, vol_z, vol_z_obs, vol_z_fcst, vol_blend_w, vol_state, chain_reset: the realised-volatility regime.

    bars: keys, day, minute, close (volume if drop_idle). clock: a bar's minute
    of the session, of which the regular hours are [open_clock, close_clock).
    Before the regular
    open a snapshot is measured by the session's volatility so far; from then
    on by that of the regular hours so far (weight: its returns) and the
    overnight one, frozen at the open (weight: overnight_bars). Scores are
    against the same clock of the last `lookback` sessions. The forecast is the
    mean of the means of daily log volatility over the horizons; observed and
    forecast scores are blended by evidence / (evidence + blend_k). Sessions
    with fewer than least_days (or the longest horizon + 1) sessions before
    them have scores but no label ("unknown").
    """
    if lookback <= max(horizons):
        raise ValueError("lookback must exceed the longest horizon")
    sk = [*keys, "day"]
    r = regimes.returns(bars, sk, drop_idle=drop_idle).withColumns({"_rr": F.coalesce(F.col("r") * F.col("r"), F.lit(0.0)), "_n": F.col("valid").cast("long"), "_on": clock < open_clock, "_rth": (clock >= open_clock) & (clock < close_clock)})
    only = lambda c, name: F.sum(F.when(F.col(c), F.col(name)).otherwise(0))
    s = regimes.snapshots(r, sk, clock, minutes, {"ss": F.sum("_rr"), "n": F.sum("_n"), "rss": only("_rth", "_rr"), "rn": only("_rth", "_n"), "oss": only("_on", "_rr"), "on": only("_on", "_n")})
    post = F.col("clock") >= open_clock
    ln = lambda ss, n: F.when((F.col(n) > 0) & (F.col(ss) > 0), F.ln(F.sqrt(F.col(ss) / F.when(F.col(n) > 0, F.col(n)))))
    s = numbered(s.withColumns({"l_gbx": ln("ss", "n"), "l_rth": ln("rss", "rn"), "l_on": ln("oss", "on")}), keys)
    end = F.max(F.struct("clock", "l_rth", "l_on")).alias("x")
    daily = s.groupBy(*keys, "nth").agg(end).select(*keys, "nth", F.col("x.l_rth").alias("l_day"), F.col("x.l_on").alias("l_on"))
    own = Window.partitionBy(*keys).orderBy("nth")
    har = {f"har_{h}": F.avg("l_day").over(own.rangeBetween(-h, -1)) for h in horizons}
    daily = daily.withColumns(har).withColumn("forecast", sum((F.col(f"har_{h}") for h in horizons), F.lit(0.0)) / len(horizons))
    daily = regimes.robust_z(daily, keys, "nth", "l_day", lookback, numbered=True).withColumn("vol_z_fcst", (F.col("forecast") - F.col("center")) / F.col("scale")).drop("center", "scale", "hist_n", "z")
    daily = regimes.robust_z(daily, keys, "nth", "l_on", lookback, numbered=True).select(*keys, "nth", "vol_z_fcst", F.col("z").alias("z_on"))
    s = s.drop("l_on")
    for name in ("gbx", "rth"):
        s = regimes.robust_z(s, [*keys, "clock"], "nth", f"l_{name}", lookback, numbered=True).withColumnRenamed("z", f"z_{name}").drop("center", "scale", "hist_n")
    s = s.join(daily, [*keys, "nth"])
    w_on, w_rth = F.when(F.col("z_on").isNotNull(), overnight_bars).otherwise(0.0), F.when(F.col("z_rth").isNotNull(), F.col("rn").cast("double")).otherwise(0.0)
    weight = F.when(post, w_on + w_rth).otherwise(F.when(F.col("z_gbx").isNotNull(), F.col("n").cast("double")).otherwise(0.0))
    mixed = (F.coalesce("z_on", F.lit(0.0)) * w_on + F.coalesce("z_rth", F.lit(0.0)) * w_rth) / F.when(w_on + w_rth > 0, w_on + w_rth)
    s = s.withColumns({"vol_z_obs": F.when(post, mixed).otherwise(F.col("z_gbx")), "_w": weight / (weight + blend_k)})
    both = F.col("vol_z_obs").isNotNull() & F.col("vol_z_fcst").isNotNull()
    s = s.withColumns({
        "vol_z": F.when(both, F.col("_w") * F.col("vol_z_obs") + (1 - F.col("_w")) * F.col("vol_z_fcst")).otherwise(F.coalesce("vol_z_obs", "vol_z_fcst")),
        "vol_blend_w": F.when(both, F.col("_w")).when(F.col("vol_z_obs").isNotNull(), 1.0).when(F.col("vol_z_fcst").isNotNull(), 0.0).otherwise(F.col("_w")),
    })
    known = F.least(F.col("nth") - 1, F.lit(lookback)) >= max(least_days, max(horizons) + 1)
    out = chained_states(s.withColumn("_known", F.when(known, F.col("vol_z"))), keys, "_known", enter, leave)
    return out.select(*keys, "day", "clock", "n", "vol_z", "vol_z_obs", "vol_z_fcst", "vol_blend_w", F.col("state").alias("vol_state"), "chain_reset")


def reversion(measures: DataFrame, keys: list[str], signs: dict[str, float], lookback: int = 120, least_days: int = 20, enter: tuple[float, float] = (1.0, -1.0), leave: tuple[float, float] = (0.5, -0.5), names: tuple[str, str, str] = ("trending", "neutral", "reverting")) -> DataFrame:
    """keys, day, clock, z_<measure>.., score, measures, state, chain_reset: a regime from several measures of each session.

    measures: keys, day, clock and a column per name of signs (1: larger means
    more trend, -1: the other way). Each measure is scored against its own last
    `lookback` sessions at the same clock; the score is the mean of the signed
    scores there are. Sessions with fewer than least_days before them are
    unknown.
    """
    m = numbered(measures, keys)
    for name, sign in signs.items():
        m = regimes.robust_z(m, [*keys, "clock"], "nth", name, lookback, numbered=True).withColumn(f"z_{name}", F.col("z") * sign).drop("center", "scale", "hist_n", "z")
    zs = [F.col(f"z_{n}") for n in signs]
    count = sum((z.isNotNull().cast("int") for z in zs), F.lit(0))
    total = sum((F.coalesce(z, F.lit(0.0)) for z in zs), F.lit(0.0))
    m = m.withColumns({"measures": count, "score": total / F.when(count > 0, count)}).withColumn("_known", F.when(F.col("nth") > least_days, F.col("score")))
    out = chained_states(m, keys, "_known", enter, leave, names)
    return out.select(*keys, "day", "clock", *[f"z_{n}" for n in signs], "score", "measures", "state", "chain_reset")


def session_direction(bars: DataFrame, keys: list[str], clock: Column, minutes: int = 30, days: int = 20) -> DataFrame:
    """keys, day, clock, state (up, down, flat), up_ratio: the sign of the session's return so far, and the share of up sessions among the last `days`."""
    sk = [*keys, "day"]
    s = regimes.snapshots(bars, sk, clock, minutes, {"first": F.min_by("close", "minute"), "last": F.max_by("close", "minute")})
    s = numbered(s.withColumn("move", F.signum(F.col("last") - F.col("first"))), keys)
    ends = s.groupBy(*keys, "nth").agg((F.max_by("move", "clock") > 0).cast("int").alias("up"))
    ends = ends.withColumn("up_ratio", F.avg("up").over(Window.partitionBy(*keys).orderBy("nth").rangeBetween(-days, -1))).drop("up")
    return s.join(ends, [*keys, "nth"]).select(*keys, "day", "clock", F.when(F.col("move") > 0, "up").when(F.col("move") < 0, "down").when(F.col("move") == 0, "flat").otherwise("unknown").alias("state"), "up_ratio")
