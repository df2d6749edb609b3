"""Volume profile of a session: point of control and value area."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _area(volume: np.ndarray, at: int, share: float) -> tuple[int, int]:
    """Index range around `at` that holds the share of all volume, growing to the larger neighbour (up on a tie)."""
    lo = hi = at
    got, want = volume[at], volume.sum() * share
    while got < want:
        down = volume[lo - 1] if lo > 0 else 0
        up = volume[hi + 1] if hi < len(volume) - 1 else 0
        if not down and not up:
            break
        if up >= down:
            hi += 1
            got += up
        else:
            lo -= 1
            got += down
    return lo, hi


def _peaks(volume: np.ndarray, apart: int, most: int) -> list[int]:
    """Local maxima of the three-level mean, the highest of each cluster, highest first."""
    n = len(volume)
    padded = np.concatenate(([0.0], volume, [0.0]))
    smooth = (padded[:-2] + padded[1:-1] + padded[2:]) / np.array([2.0, *[3.0] * (n - 2), 2.0])
    edge = np.concatenate(([-np.inf], smooth, [-np.inf]))
    top = np.flatnonzero((smooth > edge[:-2]) & (smooth > edge[2:]))
    if not len(top):
        return [int(volume.argmax())]
    groups = np.split(top, np.flatnonzero(np.diff(top) > apart) + 1)
    best = [int(g[smooth[g].argmax()]) for g in groups]
    return sorted(best, key=lambda i: -smooth[i])[:most]


def value_area(price: np.ndarray, volume: np.ndarray, share: float = 0.7, apart: int = 4, reach: int = 3) -> tuple[float, float, float] | None:
    """(point of control, high, low): the tightest value area over the peaks of the profile; None without volume."""
    if not len(price) or volume.sum() <= 0:
        return None
    if len(price) < 3:
        at = int(volume.argmax())
        lo, hi = _area(volume, at, share)
        return float(price[at]), float(price[hi]), float(price[lo])
    best = None
    for p in _peaks(volume, apart, 5):
        a, b = max(0, p - reach), min(len(price), p + reach + 1)
        lo, hi = _area(volume, a + int(volume[a:b].argmax()), share)
        if best is None or price[hi] - price[lo] < price[best[1]] - price[best[0]]:
            best = lo, hi
    lo, hi = best
    at = lo + int(volume[lo : hi + 1].argmax())
    return float(price[at]), float(price[hi]), float(price[lo])


def profiles(levels: DataFrame, keys: list[str], price: str = "price", volume: str = "volume") -> DataFrame:
    """keys, poc, vah, val of each group of (price, volume) levels.

    Levels are summed by price before the shuffle; a group has as many rows as
    the session has price levels. Groups without volume give no row.
    """
    from pyspark.sql import functions as F

    g = levels.groupBy(*keys, price).agg(F.sum(volume).cast("double").alias(volume))
    types = dict(levels.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(price)
        v = value_area(pdf[price].to_numpy(float), pdf[volume].to_numpy(float))
        out = pdf.iloc[:1][keys]
        return out.assign(poc=v[0], vah=v[1], val=v[2]) if v else out.assign(poc=0.0, vah=0.0, val=0.0).iloc[:0]

    return g.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {types[k]}" for k in keys) + ", poc double, vah double, val double")
