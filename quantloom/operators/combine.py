"""Greedy choice of a set of variants whose trades do not overlap.

The choice is a loop over sets to try, whose totals are asked for a step at a
time. Where the trades of the pool are few (MOST_ROWS, checked) they are walked
on the driver; beyond, each step's sets are one table and one pass over the
pool (spark_totals), and only a number a set comes back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.pool import merged

MOST_ROWS = 5_000_000


@dataclass
class Variant:
    """One candidate: its id, its entry kind and its trades (entry, exit, seq, pnl) in order."""

    vid: str
    entry: str
    trades: list[tuple[int, int, int, float]]


def walk(streams: list[list[tuple[int, int, int, float]]]) -> list[tuple[int, int, int, float]]:
    """The merged trades kept in order of (entry, exit, stream, seq), each entering at or after the last kept exit."""
    rows = sorted((e, x, i, s, p) for i, t in enumerate(streams) for e, x, s, p in t)
    kept, last = [], None
    for e, x, i, s, p in rows:
        if last is None or e >= last:
            kept.append((e, x, s, p))
            last = x
    return kept


def total(streams: list[list[tuple[int, int, int, float]]]) -> float:
    """Gain of the merged walk."""
    return float(sum(t[3] for t in walk(streams)))


def spark_totals(pool: DataFrame, ids: list[str], entry: str, exit_: str, tie: list[str], ticks: str) -> Callable[[list[list[int]]], list[float]]:
    """Totals of sets of variants (places in ids) by one pass over the pool (vid and trades) for all of them."""

    def totals(sets: list[list[int]]) -> list[float]:
        rows = [(n, ids[i]) for n, chosen in enumerate(sets) for i in chosen]
        trial = pool.sparkSession.createDataFrame(rows, "set_id int, vid string")
        got = {r.set_id: r.total for r in merged(pool, trial, "set_id", entry, exit_, tie).groupBy("set_id").agg(F.sum(ticks).alias("total")).collect()}
        return [float(got.get(n, 0.0)) for n in range(len(sets))]

    return totals


def choose(pool: list[Variant], corr: np.ndarray, weight: float = 0.0, most: int = 30, seeds: int = 1, swaps: int = 50, one_per_entry: bool = False, totals: Callable[[list[list[int]]], list[float]] | None = None) -> list[dict]:
    """The path of sets: forward selection by marginal gain less weight x largest correlation, then best swaps.

    Forward stops when the score is not positive or the gain negative; ties go
    to the larger gain, then the smaller id. Swaps use the mean correlation.
    With several seeds the first pick is forced in turn and the best end holds.
    totals gives the totals of the sets of a step; by default the variants'
    own trades are walked. An empty pool gives an empty path.
    """
    totals = totals or (lambda sets: [total([pool[i].trades for i in s]) for s in sets])
    if not pool:
        return []
    spread = lambda s: weight * float(np.mean([corr[a, b] for n, a in enumerate(s) for b in s[n + 1 :]])) if weight and len(s) > 1 else 0.0
    alone = totals([[i] for i in range(len(pool))])
    order = sorted(range(len(pool)), key=lambda i: (-alone[i], pool[i].vid))
    best: list[dict] = []
    for first in order[:seeds] if seeds > 1 else [None]:
        chosen, now, path = [], 0.0, []
        while len(chosen) < most:
            taken = {pool[j].entry for j in chosen} if one_per_entry else set()
            trials = [i for i in ([first] if first is not None and not chosen else range(len(pool))) if i not in chosen and not (one_per_entry and pool[i].entry in taken)]
            if not trials:
                break
            gains = [v - now for v in (totals([[*chosen, i] for i in trials]) if chosen else [alone[i] for i in trials])]
            scored = [(g - weight * max((corr[i, j] for j in chosen), default=0.0), g, i) for g, i in zip(gains, trials)]
            score, gain, i = min(scored, key=lambda o: (-o[0], -o[1], pool[o[2]].vid))
            if score <= 0 or gain < 0:
                break
            chosen.append(i)
            now += gain
            path.append({"k": len(chosen), "stage": "forward", "members": [pool[j].vid for j in chosen], "total": now})
        if path and (not best or path[-1]["total"] > best[-1]["total"]):
            best, picked = path, chosen
    if best:
        chosen, value, done = list(picked), best[-1]["total"] - spread(picked), 0
        while done < swaps:
            trials = [(at, c) for at in range(len(chosen)) for c in range(len(pool)) if c not in chosen and not (one_per_entry and pool[c].entry in {pool[j].entry for n, j in enumerate(chosen) if n != at})]
            sets = [[*chosen[:at], c, *chosen[at + 1 :]] for at, c in trials]
            values = [v - spread(s) for v, s in zip(totals(sets), sets)] if sets else []
            if not values or max(values) <= value + 1e-9:
                break
            top = values.index(max(values))
            value, done = values[top], done + 1
            chosen = sets[top]
        if set(chosen) != set(picked):
            best = [*best, {"k": len(chosen), "stage": "swap", "members": [pool[j].vid for j in chosen], "total": totals([chosen])[0]}]
    return best


def compatible(metas: list[dict]) -> dict:
    """The shared date range of runs; an error unless they agree in ticker, dataset and ticks per point and overlap."""
    for field in ("ticker", "dataset", "ticks_per_point"):
        if len({m[field] for m in metas}) != 1:
            raise ValueError(f"runs differ in {field}")
    start, end = max(m["start_date"] for m in metas), min(m["end_date"] for m in metas)
    if start > end:
        raise ValueError("runs do not overlap in time")
    return {"start_date": start, "end_date": end}
