"""Monte Carlo over trades: bootstrap, stopping rules, regime switching, path statistics.

Paths are numbered and drawn from counter-based random numbers (seed and path
number), so a path is the same however the work is spread or repeated. Paths
are the unit of parallelism: blocks of them run as arrow batches against the
trades, whose number is bounded by `most_trades` (checked) before they are sent
to the workers. The forms `*_by_run` simulate every run of a table of trades,
each by itself on a worker, with the run's id as a further key of the draws.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_TRADES = 1_000_000


def portable_draw(path: str, step: str, n: int, seed: int) -> F.Column:
    """A trade number below n from a linear congruential mix of path and step, the same in any SQL engine."""
    a = (F.col(path) * 7919 + F.col(step) * 104729 + seed) % 2147483647
    b = (a * 48271 + 11) % 2147483647
    return (b * 48271 + 7) % 2147483647 % n


def bootstrap_fixed(trades: DataFrame, number: str, pnl: str, paths: int, steps: int, n: int, seed: int, account: float) -> DataFrame:
    """path, step, equity of constant size: drawn with replacement, joined to the trades by number, summed by a window."""
    spark = trades.sparkSession
    grid = spark.range(paths).withColumnRenamed("id", "path").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    drawn = grid.withColumn(number, portable_draw("path", "step", n, seed).cast("long")).join(trades.select(number, pnl), number)
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return drawn.select("path", "step", (F.sum(pnl).over(w) + account).alias("equity"))


def bands(paths: DataFrame, percentiles: list[float]) -> DataFrame:
    """step, percentile, equity: exact percentiles over the paths at each step (linear between ranks)."""
    p = paths.groupBy("step").agg(F.percentile("equity", F.array(*[F.lit(x / 100) for x in percentiles])).alias("v"))
    return p.select("step", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in percentiles]).alias("percentile"), F.col("v").alias("equity"))).alias("x")).select("step", "x.percentile", "x.equity")


def path_statistics(paths: DataFrame, account: float, ruin: float | None = None) -> DataFrame:
    """One row over all paths: median, mean, tail drop below the start, share ever below, share ruined."""
    each = paths.groupBy("path").agg(F.max_by("equity", "step").alias("final"), F.min("equity").alias("low"), F.max("equity").alias("high"))
    return final_statistics(each, [], account, ruin)


def final_statistics(each: DataFrame, keys: list[str], account: float, ruin: float | None = None) -> DataFrame:
    """keys and the columns of path_statistics(), from one row (final, low, high) a path."""
    drop = F.greatest(F.lit(account) - F.col("low"), F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("paths"), F.percentile("final", 0.5).alias("median_final"), F.avg("final").alias("mean_final"), F.percentile(drop, 0.9985).alias("worst_drop"), F.percentile(drop, 0.5).alias("median_drop"), (F.avg((drop > 0).cast("double")) * 100).alias("p_below_start")]
    if ruin is not None:
        aggs.append((F.avg((F.col("low") <= account * ruin).cast("double")) * 100).alias("p_ruin"))
    return each.groupBy(*keys).agg(*aggs)


def featured(paths: DataFrame) -> DataFrame:
    """label, path: best final, best peak, worst final and lowest trough; a path is named once, by the first label."""
    each = paths.groupBy("path").agg(F.max_by("equity", "step").alias("final"), F.min("equity").alias("low"), F.max("equity").alias("high"))
    first = lambda v, up: F.max_by("path", F.struct(F.col(v) if up else -F.col(v), -F.col("path")))
    one = each.agg(first("final", True).alias("a"), first("high", True).alias("b"), first("final", False).alias("c"), first("low", False).alias("d"))
    labels = ["best final equity", "best peak equity", "worst final equity", "lowest trough"]
    rows = one.select(F.posexplode(F.array("a", "b", "c", "d")).alias("place", "path"))
    return rows.groupBy("path").agg(F.min("place").alias("place")).select(F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("place") + 1).alias("label"), "path")


def trade_arrays(trades: DataFrame, columns: list[str], order: list[str], most: int = MOST_TRADES) -> dict[str, np.ndarray]:
    """The trades of one simulation as arrays on the driver; more than `most` is an error."""
    pdf = trades.select(*columns, *[c for c in order if c not in columns]).limit(most + 1).toPandas()
    if len(pdf) > most:
        raise ValueError(f"more than {most} trades in a simulation")
    pdf = pdf.sort_values(order, kind="stable")
    return {c: pdf[c].to_numpy() for c in columns}


def _run(spark: SparkSession, paths: int, block: Callable[[np.ndarray], pd.DataFrame], schema: str, size: int = 256) -> DataFrame:
    ids = spark.range(0, paths, 1, max(1, -(-paths // size)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield block(pdf["id"].to_numpy())

    return ids.mapInPandas(run, schema)


def _draws(seed: int, ids: np.ndarray, shape: tuple[int, ...], run: int = 0) -> np.ndarray:
    at = [0, 0, 0, int(run) % 2**64]
    return np.stack([np.random.Generator(np.random.Philox(key=[seed, int(i)], counter=at)).random(shape) for i in ids])


def by_run(trades: DataFrame, keys: list[str], order: list[str], simulated: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str, most: int = MOST_TRADES) -> DataFrame:
    """keys and the columns of schema: simulated(run, its trades in order) of every run; keys[0] is the run's id."""
    kinds = dict(trades.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"more than {most} trades in a simulation")
        out = simulated(0 if pd.isna(key[0]) else int(key[0]), pdf.sort_values(order, kind="stable"))
        for place, (name, value) in enumerate(zip(keys, key)):
            out.insert(place, name, pd.Series([None if pd.isna(value) else value] * len(out), dtype=object, index=out.index))
        return out

    # A run is little data and much work: the number of tasks is given, so that they are not put together by their bytes.
    tasks = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return trades.repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + [schema]))


def band_rows(equity: np.ndarray, percentiles: list[float], first: int = 1) -> pd.DataFrame:
    """step, percentile, equity of an array (path, step), as in bands()."""
    v = np.percentile(equity, percentiles, axis=0)
    m, n = v.shape
    return pd.DataFrame({"step": np.repeat(np.arange(first, first + n, dtype=np.int32), m), "percentile": np.tile(percentiles, n), "equity": v.T.ravel()})


def fixed_by_run(trades: DataFrame, keys: list[str], order: list[str], pnl: str, paths: int, steps: int, seed: int, account: float, percentiles: list[float]) -> DataFrame:
    """keys, step, percentile, equity: the bands of bootstrap_fixed() for every run; its draws differ by the run's number of trades."""
    a = (np.arange(paths)[:, None] * 7919 + np.arange(1, steps + 1) * 104729 + seed) % 2147483647
    mixed = ((a * 48271 + 11) % 2147483647 * 48271 + 7) % 2147483647

    def simulated(run: int, pdf: pd.DataFrame) -> pd.DataFrame:
        return band_rows(pdf[pnl].to_numpy()[mixed % len(pdf)].cumsum(1) + account, percentiles)

    return by_run(trades, keys, order, simulated, "step int, percentile double, equity double")


def sized_by_run(trades: DataFrame, keys: list[str], order: list[str], ticks: str, size: Callable[[np.ndarray, np.ndarray], np.ndarray], paths: int, steps: int, account: float, dollars_per_tick: float, seed: int) -> DataFrame:
    """keys, path, final, low, high: the paths of sized_paths() for every run, one row a path."""

    def simulated(run: int, pdf: pd.DataFrame) -> pd.DataFrame:
        e = _sized(pdf[ticks].to_numpy(), np.arange(paths), run, size, steps, account, dollars_per_tick, seed, None)
        return pd.DataFrame({"path": np.arange(paths), "final": e[:, -1], "low": e.min(1), "high": e.max(1)})

    return by_run(trades, keys, order, simulated, "path bigint, final double, low double, high double")


def stopped_by_run(trades: DataFrame, keys: list[str], order: list[str], pnl: str, paths: int, *rules: float | int | None) -> DataFrame:
    """keys and the columns of stopped_paths() for every run; rules: what stopped_paths() takes from its horizon on."""

    def simulated(run: int, pdf: pd.DataFrame) -> pd.DataFrame:
        return _stopped(pdf[pnl].to_numpy(), np.arange(paths), run, *rules)

    return by_run(trades, keys, order, simulated, "path bigint, outcome string, stop_step int, final_equity double, held boolean")


def _sized(ticks: np.ndarray, ids: np.ndarray, run: int, size: Callable, steps: int, account: float, dollars_per_tick: float, seed: int, cost: Callable | None) -> np.ndarray:
    draw = (_draws(seed, ids, (steps,), run) * len(ticks)).astype(int)
    equity, out = np.full(len(ids), account), np.empty((len(ids), steps + 1))
    out[:, 0] = account
    for k in range(steps):
        s = np.maximum(size(equity, draw[:, k]), 0.0)
        gain = s * ticks[draw[:, k]] * dollars_per_tick
        equity = equity + gain - (cost(s, draw[:, k]) if cost else 0.0)
        out[:, k + 1] = equity
    return out


def sized_paths(spark: SparkSession, ticks: np.ndarray, size: Callable[[np.ndarray, np.ndarray], np.ndarray], paths: int, steps: int, account: float, dollars_per_tick: float, seed: int, cost: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """path, step, equity with sizes that depend on the equity: size(equity, trade numbers), cost(size, trade numbers)."""

    def block(ids: np.ndarray) -> pd.DataFrame:
        out = _sized(ticks, ids, 0, size, steps, account, dollars_per_tick, seed, cost)
        return pd.DataFrame({"path": np.repeat(ids, steps + 1), "step": np.tile(np.arange(steps + 1), len(ids)), "equity": out.ravel()})

    return _run(spark, paths, block, "path bigint, step int, equity double")


def _stopped(pnl: np.ndarray, ids: np.ndarray, run: int, horizon: int, start: float, seed: int, target: float | None = None, trailing: float | None = None, static: float | None = None, consistency: float | None = None) -> pd.DataFrame:
    m, n = len(ids), len(pnl)
    draw = (_draws(seed, ids, (horizon,), run) * n).astype(int)
    equity, peak, best = np.full(m, start), np.full(m, start), np.zeros(m)
    outcome, stop = np.full(m, "unresolved", dtype=object), np.full(m, horizon)
    live, held = np.ones(m, bool), np.zeros(m, bool)
    for k in range(horizon):
        peak = np.where(live, np.maximum(peak, equity), peak)
        gain = np.where(live, pnl[draw[:, k]], 0.0)
        equity, best = equity + gain, np.maximum(best, gain)
        low_t = np.minimum(peak - trailing, start) if trailing is not None else np.full(m, -np.inf)
        low_s = np.full(m, start - static if static is not None else -np.inf)
        hit = equity >= start + target if target is not None else np.zeros(m, bool)
        even = best <= consistency * np.maximum(equity - start, 1e-9) if consistency is not None else np.ones(m, bool)
        passed = live & hit & even
        held |= live & hit & ~even
        broke = live & ((equity <= low_t) | (equity <= low_s)) & ~passed
        by_static = broke & (equity <= low_s) & (low_s >= low_t)
        outcome[passed], outcome[broke & ~by_static], outcome[by_static] = "pass", "fail:trailing", "fail:static"
        stop[passed | broke] = k + 1
        live &= ~(passed | broke)
        if not live.any():
            break
    return pd.DataFrame({"path": ids, "outcome": outcome, "stop_step": stop, "final_equity": equity, "held": held})


def stopped_paths(spark: SparkSession, pnl: np.ndarray, paths: int, horizon: int, start: float, seed: int, target: float | None = None, trailing: float | None = None, static: float | None = None, consistency: float | None = None) -> DataFrame:
    """path, outcome, stop_step, final_equity, held: paths that end on a target or a floor.

    pnl: a day's gain by trade, drawn with replacement. The trailing floor
    follows the best close of earlier days and stops at the start; the static
    one is fixed. A close at or below a floor fails (the higher floor names the
    failure) unless the same close passes. With consistency, the best day may
    be at most that share of all profit, else the path is held and goes on.
    """

    def block(ids: np.ndarray) -> pd.DataFrame:
        return _stopped(pnl, ids, 0, horizon, start, seed, target, trailing, static, consistency)

    return _run(spark, paths, block, "path bigint, outcome string, stop_step int, final_equity double, held boolean")


def outcome_rates(paths: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, outcome, paths, share, p10, median and p90 of the stopping step."""
    from pyspark.sql import Window

    g = paths.groupBy(*(keys or []), "outcome").agg(F.count(F.lit(1)).alias("paths"), *[F.percentile("stop_step", p).alias(n) for p, n in ((0.1, "p10"), (0.5, "median"), (0.9, "p90"))])
    return g.withColumn("share", F.col("paths") / F.sum("paths").over(Window.partitionBy(*(keys or [F.lit(0)]))))


def _switching(ids: np.ndarray, run: int, start: np.ndarray, step: np.ndarray, p_trade: np.ndarray, pools: list[np.ndarray], days: int, account: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.where(step.sum(1, keepdims=True) > 0, step, np.eye(len(step)))
    cum, first = step.cumsum(1), (start / start.sum()).cumsum()
    u = _draws(seed, ids, (days, 3), run)
    m = len(ids)
    equity, out, states = np.full(m, account), np.empty((m, days)), np.empty((m, days), int)
    now = np.clip(np.searchsorted(first, u[:, 0, 0], "right"), 0, len(step) - 1)
    for k in range(days):
        if k:
            now = np.clip((u[:, k, 0][:, None] >= cum[now]).sum(1), 0, len(step) - 1)
        for s, pool in enumerate(pools):
            take = (now == s) & (u[:, k, 1] < p_trade[s])
            if len(pool):
                equity[take] += pool[(u[take, k, 2] * len(pool)).astype(int)]
        out[:, k], states[:, k] = equity, now
    return out, states


def switching_by_run(trades: DataFrame, keys: list[str], order: list[str], pnl: str, regime: str, states: list[str], paths: int, days: int, account: float, seed: int, percentiles: list[float]) -> DataFrame:
    """keys, step, percentile, equity: the bands of switching_paths() for every run.

    trades carry the chain of their own asset, the same in all rows of a run
    and nothing if there is none: start_s (days in state s) and step_s_t
    (probability from s to t), by numbers of states.
    """
    k = range(len(states))

    def simulated(run: int, pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        start = np.nan_to_num(np.array([one[f"start_{x}"] for x in k], dtype=float))
        step = np.nan_to_num(np.array([[one[f"step_{x}_{y}"] for y in k] for x in k], dtype=float))
        pools = [pdf.loc[pdf[regime] == x, pnl].to_numpy() for x in states]
        chance = np.array([min(1.0, len(p) / n) if n else 0.0 for p, n in zip(pools, start)])
        e, _ = _switching(np.arange(paths), run, start if start.sum() else np.ones(len(states)), step, chance, pools, days, account, seed)
        return band_rows(e, percentiles)

    return by_run(trades, keys, order, simulated, "step int, percentile double, equity double")


def switching_paths(spark: SparkSession, start: np.ndarray, step: np.ndarray, p_trade: np.ndarray, pools: list[np.ndarray], paths: int, days: int, account: float, seed: int) -> DataFrame:
    """path, step, state, equity: a Markov chain of states; each day trades with its state's chance, drawing from its state's gains.

    The first day has the drawn start state. States that are never left absorb.
    """

    def block(ids: np.ndarray) -> pd.DataFrame:
        out, states = _switching(ids, 0, start, step, p_trade, pools, days, account, seed)
        m = len(ids)
        return pd.DataFrame({"path": np.repeat(ids, days), "step": np.tile(np.arange(1, days + 1), m), "state": states.ravel(), "equity": out.ravel()})

    return _run(spark, paths, block, "path bigint, step int, state int, equity double")
