"""Ordered folds: the next state depends on the last decision.

Where the past can be cut or summed up, windows do it (hysteresis, islands of
the walk). Sizing on running equity cannot be cut: a run is sized trade by
trade in one arrow batch, and runs are the unit of parallelism.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def with_columns(df: DataFrame, **added: str) -> StructType:
    """The schema of df with more columns."""
    out = StructType(list(df.schema.fields))
    for name, kind in added.items():
        out = out.add(name, kind)
    return out


def no_overlap(df: DataFrame, keys: list[str], entry: str, exit_: str, tie: list[str]) -> DataFrame:
    """Rows kept by the greedy walk in order of (entry, exit, tie): a row is kept if it enters at or after the last kept exit.

    A row that enters at or after every exit before it starts the walk anew,
    whatever was kept: a running maximum marks it. The walk itself is a fold
    over the sorted rows, a batch at a time, that holds one number. Rows
    without entry or exit are left out.
    """
    rows = df.withColumns({"_e": F.unix_micros(entry), "_x": F.unix_micros(exit_)}).where("_e IS NOT NULL AND _x IS NOT NULL")
    order = Window.partitionBy(*keys).orderBy("_e", "_x", *tie)
    before = F.max("_x").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # The window leaves its rows sorted by keys and order, and the walk takes them as they come.
    rows = rows.withColumn("_anew", ~F.coalesce(F.col("_e") < before, F.lit(False)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            keep = []
            for e, x, anew in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_e", "_x", "_anew"))):
                take = anew or e >= last
                keep.append(take)
                if take:
                    last = x
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(walk, rows.schema).drop("_e", "_x", "_anew")


def hysteresis(df: DataFrame, keys: list[str], order: list[str], z: str, names: tuple[str, str, str] = ("high", "normal", "low"), enter: tuple[float, float] = (1.0, -1.0), leave: tuple[float, float] = (0.5, -0.5)) -> DataFrame:
    """Adds state: three states with separate thresholds to enter and to leave the outer ones.

    A null or NaN z is 'unknown' and leaves the state as it was. One step may
    leave an extreme and enter the other. leave lies within enter.

    Beyond an enter threshold, and strictly between the leave ones, the state
    does not depend on the past; a value between the two thresholds of one side
    only ends the other side's state. So the state follows from the last
    decisive value and whether a value of the other side came since: windows,
    no loop.
    """
    high, normal, low = names
    v = F.when(~F.isnan(z), F.col(z))
    by = Window.partitionBy(*keys).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    decisive = F.when(v > enter[0], 1).when(v < enter[1], -1).when((v < leave[0]) & (v > leave[1]), 0)
    x = df.withColumns({"_pos": F.row_number().over(by), "_code": decisive, "_v": v})
    at = lambda cond: F.max(F.when(cond, F.col("_pos"))).over(upto)
    x = x.withColumns({"_last": F.last("_code", True).over(upto), "_at": at(F.col("_code").isNotNull()), "_up": at(F.col("_code").isNull() & (F.col("_v") >= leave[0])), "_down": at(F.col("_code").isNull() & (F.col("_v") <= leave[1]))})
    still = lambda c: F.col(c).isNull() | (F.col(c) < F.col("_at"))
    state = F.when(F.col("_v").isNull(), "unknown").when((F.col("_last") == 1) & still("_down"), high).when((F.col("_last") == -1) & still("_up"), low).otherwise(normal)
    return x.withColumn("state", state).drop("_pos", "_code", "_v", "_last", "_at", "_up", "_down")


def _floor_steps(raw: float, increment: float) -> float:
    return round(math.floor(raw / increment) * increment, 1)


def fixed_rule(contracts: float) -> Callable:
    """The same number of contracts for every trade."""
    return lambda pdf: lambda equity, row: round(contracts, 1)


def kelly_rule(fraction: float = 0.25, increment: float = 0.1, dollars_per_tick: float = 12.5) -> Callable:
    """Fractional Kelly from the group's own wins and losses; none if it has only one kind, never negative."""

    def prepare(pdf: pd.DataFrame) -> Callable:
        win, loss = pdf.loc[pdf["ticks"] > 0, "ticks"], pdf.loc[pdf["ticks"] < 0, "ticks"]
        if not len(win) or not len(loss):
            return lambda equity, row: 0.0
        p, risk = len(win) / len(pdf), -loss.mean()
        share = max(p - (1 - p) / (win.mean() / risk), 0.0) * fraction
        return lambda equity, row: max(_floor_steps(equity * share / (risk * dollars_per_tick), increment), 0.0)

    return prepare


def risk_rule(percent: float = 0.01, increment: float = 0.1, dollars_per_tick: float = 12.5) -> Callable:
    """A share of equity at the trade's stop; ticks per point come from the group's first trade that moved."""

    def prepare(pdf: pd.DataFrame) -> Callable:
        moved = pdf[pdf["pnl_points"] != 0]
        if moved.empty:
            return lambda equity, row: 0.0
        per_point = float(moved["ticks"].iloc[0] / moved["pnl_points"].iloc[0])

        def size(equity: float, row) -> float:
            stop = abs(row.entry_price - row.sl) * per_point * dollars_per_tick
            return _floor_steps(equity * percent / stop, increment) if stop > 0 else 0.0

        return size

    return prepare


def sized(df: DataFrame, keys: list[str], order: list[str], rule: Callable, account: float = 100_000.0, dollars_per_tick: float = 12.5) -> DataFrame:
    """Adds contracts, trade_pnl and equity: trades sized one after the other on the running equity."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        size, equity = rule(pdf), account
        contracts, pnl, curve = [], [], []
        for row in pdf.itertuples(index=False):
            c = float(size(equity, row))
            gain = row.ticks * dollars_per_tick * c
            equity += gain
            contracts.append(c)
            pnl.append(gain)
            curve.append(equity)
        return pdf.assign(contracts=contracts, trade_pnl=pnl, equity=curve)

    return df.groupBy(*keys).applyInPandas(run, with_columns(df, contracts="double", trade_pnl="double", equity="double"))
