"""Regime measures at clock snapshots of a session, and their yardsticks over earlier sessions.

Everything that is a sum is a running window over the session, read off at the
snapshot rows; sessions are the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.market import ratio


def returns(df: DataFrame, keys: list[str], ts: str = "minute", step_seconds: int = 60, drop_idle: bool = False) -> DataFrame:
    """Adds r (log return) and valid: no return over a gap, from a non-positive price or, if asked, into a bar without volume."""
    w = Window.partitionBy(*keys).orderBy(ts)
    prev, gap = F.lag("close").over(w), F.unix_seconds(ts) - F.unix_seconds(F.lag(ts).over(w))
    ok = (gap == step_seconds) & (F.col("close") > 0) & (prev > 0)
    if drop_idle:
        ok = ok & (F.col("volume") > 0)
    r = F.when(ok, F.ln(F.when(F.col("close") > 0, F.col("close")) / F.when(prev > 0, prev)))
    return df.withColumns({"r": r, "valid": F.coalesce(ok, F.lit(False))})


def snapshots(df: DataFrame, keys: list[str], clock: Column, minutes: int, aggregates: dict[str, Column], ts: str = "minute") -> DataFrame:
    """keys, clock, aggregates: running aggregates of the rows strictly before each clock boundary.

    clock is a row's minute of the session. Boundary T (a multiple of minutes)
    reads the last row of those before it; boundaries without a row since the
    one before repeat nothing.
    """
    upto = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumns({k: e.over(upto) for k, e in aggregates.items()}).withColumn("clock", ((F.floor(clock / minutes) + 1) * minutes).cast("int"))
    last = x.groupBy(*keys, "clock").agg(F.max(F.struct(ts, *aggregates)).alias("x"))
    return last.select(*keys, "clock", *[F.col(f"x.{k}").alias(k) for k in aggregates])


def realised(df: DataFrame, keys: list[str], clock: Column, minutes: int = 30) -> DataFrame:
    """keys, clock, n, vol, ln_vol: root mean square of the valid returns so far (null without movement)."""
    s = snapshots(df, keys, clock, minutes, {"ss": F.sum(F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))), "n": F.sum(F.col("valid").cast("long"))})
    vol = F.when((F.col("n") > 0) & (F.col("ss") > 0), F.sqrt(F.col("ss") / F.when(F.col("n") > 0, F.col("n"))))
    return s.withColumn("vol", vol).withColumn("ln_vol", F.ln("vol")).drop("ss")


def robust_z(df: DataFrame, keys: list[str], day: str, value: str, lookback: int = 120, least: int = 2, numbered: bool = False) -> DataFrame:
    """Adds center, scale, hist_n and z: against the same key's last `lookback` days, today not included.

    numbered: day is a running number of the asset's days, and the frame is by
    number, so days on which the key has no row take their place in it; else
    it is by rows.

    The center is the median, the scale the median absolute deviation from it
    x 1.4826; null for fewer than `least` days or no spread. The deviations
    are taken from the day's own center, so the window's values are kept as an
    array of at most lookback numbers.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    w = w.rangeBetween(-lookback, -1) if numbered else w.rowsBetween(-lookback, -1)
    x = df.withColumn("_past", F.filter(F.collect_list(value).over(w), lambda v: ~F.isnan(v)))
    mid = lambda a: F.when(F.size(a) > 0, (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2 + 1).cast("int"))) / 2)
    x = x.withColumn("_sorted", F.array_sort("_past")).withColumns({"hist_n": F.size("_past"), "center": mid(F.col("_sorted"))})
    x = x.withColumn("_dev", F.array_sort(F.transform("_past", lambda v: F.abs(v - F.col("center")))))
    mad = mid(F.col("_dev")) * 1.4826
    x = x.withColumn("scale", F.when((F.col("hist_n") >= least) & (mad > 0), mad))
    return x.withColumn("z", (F.col(value) - F.col("center")) / F.col("scale")).drop("_past", "_sorted", "_dev")


def trailing_means(df: DataFrame, keys: list[str], day: str, value: str, horizons: tuple[int, ...] = (1, 5, 22)) -> DataFrame:
    """Adds har_<h>: mean of the value over the last h days before today, and forecast: their mean, null unless all are there."""
    mean = {f"har_{h}": F.avg(value).over(Window.partitionBy(*keys).orderBy(day).rowsBetween(-h, -1)) for h in horizons}
    out = df.withColumns(mean)
    total = sum((F.col(f"har_{h}") for h in horizons), F.lit(0.0))
    return out.withColumn("forecast", total / len(horizons))


def blend(observed: Column, evidence: Column, forecast: Column, k: float) -> Column:
    """Observed and forecast z by weight evidence / (evidence + k); the other one where one is missing."""
    w = evidence / (evidence + k)
    return F.when(observed.isNotNull() & forecast.isNotNull(), w * observed + (1 - w) * forecast).otherwise(F.coalesce(observed, forecast))


def variance_ratio(df: DataFrame, keys: list[str], q: int, ts: str = "minute", least: int = 30) -> DataFrame:
    """keys, n, blocks, vr, lm_z: overlapping variance ratio of q-bar to one-bar returns and its robust significance.

    Blocks with an invalid return are left out. Null below max(least, 3q)
    valid or below `least` moving returns. lm_z uses products of squared
    deviations at lags below q.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    block = w.rowsBetween(1 - q, 0)
    x = df.withColumns({"b": F.sum("r").over(block), "bn": F.sum(F.col("valid").cast("int")).over(block)})
    m = x.groupBy(*keys).agg(F.sum(F.col("valid").cast("long")).alias("n"), F.avg("r").alias("mu"), F.count_if(F.col("valid") & (F.col("r") != 0)).alias("moves"))
    x = x.join(m, keys).withColumn("e2", F.when(F.col("valid"), (F.col("r") - F.col("mu")) * (F.col("r") - F.col("mu"))))
    x = x.withColumns({f"d{k}": F.col("e2") * F.lag("e2", k).over(w) for k in range(1, q)})
    whole = F.col("bn") == q
    a = x.groupBy(*keys, "n", "moves").agg(
        F.sum("e2").alias("ss1"), F.count_if(whole).alias("blocks"), F.sum(F.when(whole, (F.col("b") - q * F.col("mu")) * (F.col("b") - q * F.col("mu")))).alias("ssq"),
        sum(((2.0 * (q - k) / q) ** 2 * F.coalesce(F.sum(f"d{k}"), F.lit(0.0)) for k in range(1, q)), F.lit(0.0)).alias("dd"),
    )
    n = F.col("n").cast("double")
    good = (n >= max(least, 3 * q)) & (F.col("moves") >= least) & (F.col("blocks") >= 2) & (F.col("ss1") > 0)
    weight = q * F.col("blocks") * (1 - q / F.when(n > 0, n))
    vr = F.when(good & (weight > 0), ratio(ratio(F.col("ssq"), weight), ratio(F.col("ss1"), n - 1)))
    a = a.withColumn("vr", vr)
    theta = ratio(F.col("dd"), F.col("ss1") * F.col("ss1")) * n
    return a.select(*keys, "n", "blocks", "vr", F.when(theta > 0, F.sqrt(n) * (F.col("vr") - 1) / F.sqrt(F.when(theta > 0, theta))).alias("lm_z"))


def hurst_variance(df: DataFrame, keys: list[str], lags: tuple[int, ...] = (1, 2, 4, 8), ts: str = "minute", least: int = 30) -> DataFrame:
    """keys, hurst: half the slope of log variance of k-bar returns on log k."""
    w = Window.partitionBy(*keys).orderBy(ts)
    m = df.groupBy(*keys).agg(F.sum(F.col("valid").cast("long")).alias("n"), F.avg("r").alias("mu"), F.count_if(F.col("valid") & (F.col("r") != 0)).alias("moves"))
    x = df.withColumns({f"b{k}": F.when(F.sum(F.col("valid").cast("int")).over(w.rowsBetween(1 - k, 0)) == k, F.sum("r").over(w.rowsBetween(1 - k, 0))) for k in lags}).join(m, keys)
    a = x.groupBy(*keys, "n", "moves").agg(*[F.count(f"b{k}").alias(f"n{k}") for k in lags], *[F.sum((F.col(f"b{k}") - k * F.col("mu")) * (F.col(f"b{k}") - k * F.col("mu"))).alias(f"s{k}") for k in lags])
    n = F.col("n").cast("double")
    points = []
    for k in lags:
        mass = k * F.col(f"n{k}") * (1 - k / F.when(n > 0, n))
        var = F.when((F.col(f"n{k}") >= 4) & (mass > 0) & (F.col(f"s{k}") > 0), F.col(f"s{k}") / F.when(mass > 0, mass) * k)
        points.append(F.when(var > 0, F.struct(F.ln(F.lit(float(k))).alias("x"), F.ln(var).alias("y"))))
    p = F.filter(F.array(*points), lambda v: v.isNotNull())
    add = lambda f: F.aggregate(p, F.lit(0.0), lambda s, v: s + f(v))
    c, sx, sy = F.size(p).cast("double"), add(lambda v: v["x"]), add(lambda v: v["y"])
    slope = ratio(c * add(lambda v: v["x"] * v["y"]) - sx * sy, c * add(lambda v: v["x"] * v["x"]) - sx * sx)
    return a.select(*keys, F.when((c >= 3) & (n >= least) & (F.col("moves") >= least), slope / 2).alias("hurst"))


def hurst_rescaled(df: DataFrame, keys: list[str], ts: str = "minute", blocks: tuple[int, ...] = (8, 16, 32, 64, 128, 256)) -> DataFrame:
    """keys, hurst_rs: slope of log mean rescaled range on log block length; null for fewer than two lengths.

    The range of a cumulative sum is no moment, so a session's returns are
    folded in one arrow batch each.
    """
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        r = np.where(pdf["valid"], pdf["r"].fillna(0.0), 0.0)
        xs, ys = [], []
        for size in blocks:
            if size > len(r):
                break
            b = r[: len(r) // size * size].reshape(-1, size)
            walk = np.cumsum(b - b.mean(1, keepdims=True), 1)
            span, sd = np.ptp(walk, axis=1), b.std(1, ddof=1)
            ok = (span > 0) & (sd > 0)
            if ok.any():
                xs.append(np.log(size))
                ys.append(np.log((span[ok] / sd[ok]).mean()))
        h = float(np.polyfit(xs, ys, 1)[0]) if len(xs) >= 2 else None
        return pdf.iloc[:1][keys].assign(hurst_rs=h)

    types = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {types[k]}" for k in keys) + ", hurst_rs double")


def adf(df: DataFrame, keys: list[str], spread: Column, ts: str = "minute", least: int = 30) -> DataFrame:
    """keys, n, adf_t: t of the lagged level in a regression of its change on a constant, the level and the last change.

    Normal equations from sums; the 3 x 3 system is solved in closed form after
    centring. Null below `least` rows or where it is singular. Not sign-flipped.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    x = df.withColumn("s", spread)
    x = x.withColumns({"lv": F.lag("s").over(w), "y": F.when(F.col("valid"), F.col("s") - F.lag("s").over(w))})
    x = x.withColumn("d", F.lag("y").over(w)).where("y IS NOT NULL AND lv IS NOT NULL AND d IS NOT NULL")
    a = x.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.var_pop("lv").alias("vl"), F.var_pop("d").alias("vd"), F.covar_pop("lv", "d").alias("cld"), F.covar_pop("lv", "y").alias("cly"), F.covar_pop("d", "y").alias("cdy"), F.var_pop("y").alias("vy"), F.count_if(F.col("y") != 0).alias("moves"),
    )
    det = F.col("vl") * F.col("vd") - F.col("cld") * F.col("cld")
    bl, bd = ratio(F.col("vd") * F.col("cly") - F.col("cld") * F.col("cdy"), det), ratio(F.col("vl") * F.col("cdy") - F.col("cld") * F.col("cly"), det)
    rss = F.col("vy") - bl * F.col("cly") - bd * F.col("cdy")
    var = ratio(rss, F.col("n") - 3) * ratio(F.col("vd"), det)
    good = (F.col("n") >= least) & (F.col("moves") >= least) & (det > 1e-18) & (var > 0)
    return a.select(*keys, F.col("n").cast("long").alias("n"), F.when(good, bl / F.sqrt(F.when(var > 0, var))).alias("adf_t"))


def efficiency(df: DataFrame, keys: list[str], spread: Column, ts: str = "minute", least: int = 30) -> DataFrame:
    """keys, n, er: net displacement over the path's length; null below `least` rows or moves."""
    w = Window.partitionBy(*keys).orderBy(ts)
    x = df.withColumn("s", spread).where("s IS NOT NULL")
    x = x.withColumn("d", F.abs(F.col("s") - F.lag("s").over(w)))
    a = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by("s", ts).alias("a"), F.max_by("s", ts).alias("b"), F.sum(F.when(F.col("valid"), F.col("d"))).alias("path"), F.count_if(F.col("valid") & (F.col("d") > 0)).alias("moves"))
    return a.select(*keys, "n", F.when((F.col("n") >= least) & (F.col("moves") >= least), ratio(F.abs(F.col("b") - F.col("a")), F.col("path"))).alias("er"))


def day_frame_problems(df: DataFrame, keys: list[str], states: list[str], label: str = "state") -> DataFrame:
    """keys, problem: what a regime day breaks: not exactly one final row, unknown labels, unsorted or repeated times."""
    a = df.groupBy(*keys).agg(F.count_if("is_final").alias("finals"), F.count_if(~F.col(label).isin([*states, "unknown"])).alias("odd"), F.count(F.lit(1)).alias("n"), F.countDistinct("ts").alias("times"))
    each = F.array(F.when(F.col("finals") != 1, "not exactly one final row"), F.when(F.col("odd") > 0, "undeclared state"), F.when(F.col("n") != F.col("times"), "repeated time"))
    return a.select(*keys, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("problem"))
