"""Simulations give a result for every run, the same whatever other runs there are."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quantloom.operators import simulate
from quantloom.plans import market_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["mc_percentile_bands_by_run", "mc_kelly_paths", "mc_stopped_paths", "mc_regime_switching"])
def test_every_run_is_simulated(spark, name):
    keys = ["run_id", "asset"] if name == "mc_regime_switching" else ["run_id"]
    want = {tuple(r) for r in market_queries._trades(spark, SF).select(*keys).distinct().collect()}
    assert len(want) > 1
    assert {tuple(r) for r in entry.queries()[name](spark, SF).select(*keys).distinct().collect()} == want


def test_bands_of_the_first_run(spark):
    every = entry.queries()["mc_percentile_bands_by_run"](spark, SF).collect()
    first = min(r.run_id for r in every)
    got = {(r.step, r.percentile): r.equity for r in every if r.run_id == first}
    t = market_queries._trades(spark, SF).where(F.col("run_id") == first)
    t = t.withColumns({"k": (F.row_number().over(Window.partitionBy("run_id").orderBy("trade_id")) - 1).cast("long"), "p": F.col("ticks") * 12.5})
    paths = simulate.bootstrap_fixed(t, "k", "p", 400, 50, t.count(), 11, 100_000.0)
    want = {(r.step, r.percentile): r.equity for r in simulate.bands(paths, [5.0, 50.0, 95.0]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)


def test_run_is_a_key_of_the_draws(spark):
    rows = [(run, i, float(x)) for run in (1, 2) for i, x in enumerate([5, -4, 7, -9, 2])]
    t = spark.createDataFrame(rows, "run_id long, trade_id long, ticks double")
    f = lambda df: {(r.run_id, r.path): r.final for r in simulate.sized_by_run(df, ["run_id"], ["trade_id"], "ticks", lambda e, i: np.ones(len(e)), 8, 20, 100.0, 1.0, 7).collect()}
    both, one = f(t), f(t.where("run_id = 2"))
    assert one == {k: v for k, v in both.items() if k[0] == 2}
    assert [both[1, p] for p in range(8)] != [both[2, p] for p in range(8)]
