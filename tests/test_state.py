"""Settlements, chains, detectors, pools, ladders, catalogs and map functions on small fixtures."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import calendar, maps
from quantloom.operators import bars, book, chain, detectors, folds, joins, pool, report, settlement
from quantloom.sources import catalog, days, records

D = date(2026, 1, 5)
T0 = datetime(2026, 1, 5)


def at(hours, minutes=0, seconds=0):
    return T0 + timedelta(hours=hours, minutes=minutes, seconds=seconds)


STATS = "symbol string, ts_ref timestamp, ts_recv timestamp, price double, stat_type int, stat_flags int, update_action int, junk string"


def test_final_settlements(spark):
    ref = at(0)
    rows = [
        ("A", ref, at(20), 1.0, 3, 1, 1, ""), ("A", ref, at(30), 2.0, 3, 3, 1, ""), ("A", ref, at(40), 9.0, 3, 9, 1, ""), ("A", ref, at(50), 9.0, 3, 0, 1, ""), ("A", ref, at(60), 9.0, 3, 1, 2, ""), ("A", ref, at(70), 9.0, 9, 1, 1, ""),
        ("A", ref, at(80), float("nan"), 3, 1, 1, ""), ("A", ref, at(81), None, 3, 1, 1, ""), ("A-B", ref, at(20), 5.0, 3, 1, 1, ""), (None, ref, at(20), 5.0, 3, 1, 1, ""), ("B", None, at(20), 5.0, 3, 1, 1, ""), ("C", at(30), at(90), 4.0, 3, 1, 1, ""),
    ]
    df = spark.createDataFrame([*rows, rows[1]], STATS)
    got = sorted((r.symbol, r.date, r.settlement, r.is_actual) for r in settlement.final_settlements(df).collect())
    assert got == [("A", D, 2.0, True), ("C", D + timedelta(1), 4.0, False)]
    assert settlement.final_settlements(df.limit(0)).count() == 0


def test_one_to_one_and_reference_sessions(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, 5.0), (3, 6.0)], "k int, y double")
    assert sorted((r.x, r.y) for r in settlement.one_to_one(left, right, ["k"], ["y"]).collect()) == [("a", 5.0), ("b", None), ("c", None)]
    with pytest.raises(Exception, match="not unique"):
        settlement.one_to_one(left, right.union(right), ["k"], ["y"]).collect()
    pubs = spark.createDataFrame([(1, "U", D, None), (2, "U", D + timedelta(3), None), (3, "U", D, D), (4, "V", D, None)], "id int, u string, day date, ref date")
    settled = spark.createDataFrame([("U", D - timedelta(3)), ("U", D), ("U", D)], "u string, session date")
    got = {r.id: r.session for r in settlement.reference_sessions(pubs, settled, ["u"], "day", "ref").collect()}
    assert got == {1: D - timedelta(3), 2: D, 3: D, 4: None}


def test_chain_rows_by_hand(spark):
    prints = "instrument_id long, ts_event timestamp, print_id long, price double, size int, aggressor int, flow int, bid_px double, ask_px double"
    p = spark.createDataFrame([(1, at(10), 1, 5.0, 2, 1, -2, 4.5, 5.0), (1, at(10, 1), 2, 4.0, 3, -1, 3, 4.0, 4.5), (1, at(34), 3, 6.0, 4, 1, -4, 5.5, 6.0), (1, at(60), 4, 9.0, 1, 0, 0, 9.0, 9.5)], prints)
    legs = spark.createDataFrame([(1, at(10, 2), 5, 1.0, 7, 1, -7, None, None), (1, at(12), 6, 1.0, 5, -1, 5, None, None)], prints)
    pubs = spark.createDataFrame([(10, at(-1), " Evening", 1, 100), (11, at(11), "morning", 1, 110), (12, at(33), "evening", 1, 120), (13, at(11), "expired", 1, 7), (14, at(11), None, 1, 7), (15, at(11), "morning", None, 7), (16, at(11), "morning", 1, None)], "snapshot_id long, snapshot_time timestamp, snapshot_type string, instrument_id long, open_interest int")
    contracts = spark.createDataFrame([(1, at(50)), (1, None), (None, at(1)), (2, at(20))], "instrument_id long, expiry timestamp")
    rows = sorted(chain.chain_rows(p, pubs, contracts, legs).collect(), key=lambda r: r.bucket)
    assert [(r.bucket, r.kind) for r in rows] == [(at(-1), "interest"), (at(10), "traded"), (at(11), "interest"), (at(12), "spread"), (at(33), "interest"), (at(34), "traded"), (at(50), "expired")]
    by = {r.bucket: r for r in rows}
    assert (by[at(10)].open, by[at(10)].close, by[at(10)].volume, by[at(10)].spread_volume, by[at(10)].spread_buy_volume) == (5.0, 4.0, 5, 7, 7)
    assert (by[at(10)].dealer_oi_flow, by[at(10)].dealer_oi_flow_spread, by[at(12)].dealer_oi_flow_spread) == (1, -7, -2)
    assert (by[at(12)].bid, by[at(12)].ask, by[at(12)].is_stale_quote, by[at(10)].is_stale_quote) == (4.0, 4.5, True, False)
    assert [by[at(h)].open_interest for h in (-1, 10, 11, 33, 34, 50)] == [100, 100, 110, 120, 120, -1]
    assert [by[at(h)].is_morning_update for h in (10, 11, 12, 33)] == [False, True, True, False]
    # Session one: bought 2 less sold 3, and 7 less 5 in legs; session two has its evening number before its trade.
    assert [by[at(h)].daily_estimated_oi for h in (10, 12, 33, 34, 50)] == [100 + 6, 110 + 1, 120, 124, -1]
    assert chain.chain_rows(p.limit(0), pubs.limit(0), contracts.limit(0)).count() == 0


def test_states_are_chained_over_sessions(spark):
    z = [2.0, 0.7, 0.7, None, 0.7, 2.0, 0.7, 0.2]
    rows = [("s", n // 2 + 1, n % 2, v) for n, v in enumerate(z)]
    got = sorted(detectors.chained_states(spark.createDataFrame(rows, "symbol string, nth int, clock int, score double"), ["symbol"], "score", (1.0, -1.0), (0.5, -0.5)).collect(), key=lambda r: (r.nth, r.clock))
    assert [r.state for r in got] == ["high", "high", "high", "unknown", "normal", "high", "high", "normal"]
    assert [r.chain_reset for r in got] == [True, True, False, False, True, True, False, False]


def test_volatility_needs_sessions_before(spark):
    r = np.random.default_rng(3)
    rows = []
    for n in range(9):
        price = 100.0
        for m in range(120):
            price *= math.exp(r.normal(0, 0.0005 * (4 if n == 8 else 1)))
            rows.append(("s", D + timedelta(n), datetime(2026, 1, 5) + timedelta(days=n, minutes=m), price, 1))
    b = spark.createDataFrame(rows, "symbol string, day date, minute timestamp, close double, volume int")
    clock = F.hour("minute") * 60 + F.minute("minute")
    got = detectors.volatility(b, ["symbol"], clock, 60, 120, 30, 20, (1, 2, 3), 5)
    last = sorted((x for x in got.collect() if x.day == D + timedelta(8)), key=lambda x: x.clock)
    assert [x.clock for x in last] == [30, 60, 90, 120] and all(x.vol_z > 1 and x.vol_state == "high" for x in last)
    assert {x.vol_state for x in got.collect() if x.day < D + timedelta(5)} == {"unknown"}
    with pytest.raises(ValueError):
        detectors.volatility(b, ["symbol"], clock, 60, 120, 30, 20, (22,), 5)
    assert detectors.volatility(b.limit(0), ["symbol"], clock, 60, 120).count() == 0


def test_pool(spark):
    rows = [("r", "long", 1.0, D + timedelta(i), i, at(10 * i), at(10 * i + 12), 1.0 if i % 2 else -2.0) for i in range(6)] + [("r", None, None, D, 9, at(1), at(2), 5.0), (None, "long", 1.0, D, 10, at(1), at(2), 5.0)]
    t = spark.createDataFrame(rows, "run string, kind string, p double, day date, id int, entry timestamp, exit timestamp, ticks double")
    v = pool.variants(t, "run", "kind", ["p"])
    assert {x.vid for x in v.select("vid").collect()} == {"r · long · p=1", "r · unknown · p=none"}
    s = pool.in_sample(v, "day", 0.5)
    assert {x.id for x in s.where("in_sample").collect()} == {0, 1, 2, 9}
    assert {x.vid for x in pool.floored(s, "kind", {"long": 4}, 1).collect()} == {"r · unknown · p=none"}
    sets = spark.createDataFrame([(1, "r · long · p=1"), (2, "r · long · p=1"), (2, "r · unknown · p=none"), (3, "nobody")], "s int, vid string")
    e = {x.s: x for x in pool.evaluate(v, sets, "s", "entry", "exit", ["id"]).collect()}
    assert set(e) == {1, 2} and (e[1].n_trades, e[1].total_ticks, e[1].max_dd_ticks, e[1].max_dd_pct) == (3, -6.0, -4.0, None)
    assert (e[2].n_trades, e[2].total_ticks) == (3, -6.0)  # the other one enters before the first is out
    assert {x.id for x in pool.at_point(v, {"p": None, "kind": None}).collect()} == {9}
    f = pool.filtered(t.where("run IS NOT NULL"), [("kind", ["long"]), ("ticks", [1.0])], ["run"], ["id"])
    assert [x.cumulative_ticks for x in f.orderBy("id").collect()] == [1.0, 2.0, 3.0]
    assert pool.filtered(t, [("kind", [])], ["run"], ["id"]).count() == 0
    assert folds.no_overlap(t.limit(0), ["run"], "entry", "exit", ["id"]).count() == 0


def test_disjoint_spans(spark):
    facts = spark.createDataFrame([(1, "a", at(1)), (2, "a", at(5)), (3, "a", at(9)), (4, "b", at(1)), (5, None, at(1)), (6, "a", None)], "id int, k string, t timestamp")
    spans = spark.createDataFrame([("a", at(0), at(5), "x"), ("a", at(5), at(8), "y"), ("a", at(3), at(3), "z"), (None, at(0), at(9), "z"), ("a", None, at(9), "z")], "k string, lo timestamp, hi timestamp, name string")
    for disjoint in (True, False):
        assert {r.id: r.name for r in joins.interval(facts, spans, "k", "t", "lo", "hi", ["name"], disjoint).collect()} == {1: "x", 2: "y"}
    twice = spans.union(spark.createDataFrame([("a", at(4), at(6), "w")], spans.schema))
    with pytest.raises(Exception, match="overlap"):
        joins.interval(facts, twice, "k", "t", "lo", "hi", ["name"]).collect()
    assert joins.interval(facts, twice, "k", "t", "lo", "hi", ["name"], False).count() == 3


def test_ladders_by_hand(spark):
    e = lambda seq, s, action, side, px, sz, oid: ("S", D, seq, at(10, 0, s), action, side, px, sz, oid)
    rows = [e(1, 0, "A", "B", 100, 5, 1), e(2, 0, "A", "a", 102, 4, 2), e(3, 2, "A", "B", 99, 9, 3), e(4, 2, "C", "A", 102, 4, 2), e(5, 4, "T", "B", 104, 1, None), e(6, 5, "R", None, None, None, None), e(7, 7, "A", "B", 90, 1, 4)]
    df = spark.createDataFrame(rows, "symbol string, session_date date, seq long, ts timestamp, action string, side string, px long, sz long, order_id long")
    got = sorted((r.sec % 60, r.side, r.px, r.size) for r in book.ladders(df).collect())
    assert got == [(0, "A", 102, 4), (0, "B", 100, 5), (2, "B", 99, 9), (2, "B", 100, 5), (4, "B", 99, 9), (4, "B", 100, 5), (7, "B", 90, 1)]
    t = {r.sec % 60: (r.best_bid, r.best_ask, r.bid_size) for r in book.touch_by_second(book.ladders(df)).collect()}
    assert t == {0: (100, 102, 5), 2: (100, None, 14), 4: (100, None, 14), 7: (90, None, 1)}
    tape = spark.createDataFrame([("S", D, int((at(10, 0, 4) - datetime(1970, 1, 1)).total_seconds()), 99)], "symbol string, session_date date, sec long, px long")
    c = sorted((r.sec % 60, r.px, r.near) for r in book.cropped_ladders(book.ladders(df), tape, 0, 1, 1.5).where("side = 'B'").collect())
    assert c == [(0, 100, True), (2, 99, False), (2, 100, True), (4, 99, True), (4, 100, True), (7, 90, True)]
    assert book.ladders(df.limit(0)).count() == 0


def test_map_functions(spark):
    df = spark.createDataFrame([('{"5": 1, "3": 2}', '{"3": 4, "9": 1}'), (None, '{"3": 4}'), ("broken", None)], "a string, b string")
    got = df.select(maps.pairs(F.col("a")).alias("p"), maps.summed(maps.pairs(F.col("a")), maps.pairs(F.col("b"))).alias("s"), maps.merged_notes(F.col("a"), F.col("b")).alias("n")).collect()
    assert [(x.key, x.value) for x in got[0].p] == [("5", 1.0), ("3", 2.0)] and got[1].p is None
    assert [(x.key, x.value) for x in got[0].s] == [("5", 1.0), ("3", 6.0), ("9", 1.0)] and [(x.key, x.value) for x in got[1].s] == [("3", 4.0)]
    assert got[0].n == '{"5":"1","3":"4","9":"1"}' and got[2].n == "{}"
    lv = spark.createDataFrame([([(1.0, 5), (2.0, 9), (3.0, 9)],), ([],), (None,)], "l array<struct<price:double,n:int>>")
    first = [r.x for r in lv.select(maps.first_within(F.col("l"), "price", F.lit(1.5), F.lit(9.0), "n", 6).alias("x")).collect()]
    assert first[0].price == 2.0 and first[1:] == [None, None]
    assert maps.column_parts("rth_hist_vol_center") == {"scope": "rth", "history": True, "measure": "vol_center"} and maps.column_parts("vol_z")["scope"] == ""


def test_report_checks(spark):
    c = spark.createDataFrame([(1, 5, 2.0), (2, 9, 4.0), (3, 9, float("inf")), (4, None, None)], "k int, n int, x double")
    got = {r.k: (r.masked, r.shade) for r in report.color_scale(c, "x", "n", 6, 2.0).collect()}
    assert got == {1: (True, 0.0), 2: (False, 1.0), 3: (False, None), 4: (True, None)}
    a = report.agreement(spark.createDataFrame([("u", "u"), ("u", "d"), ("d", "d"), ("d", "d"), ("unknown", "u"), (None, "u")], "a string, b string"), "a", "b").first()
    assert (a.n, a.agree, a.chance, a.lift) == (4, 0.75, 0.5, 1.5)
    s = spark.createDataFrame([("x", i, i % 3, v) for i, v in enumerate(["u", "d", "unknown", "d", "d", "u"])], "k string, i int, clock int, s string")
    assert {r.clock: (r.n, r.changes) for r in report.change_rate(s, ["k"], ["i"], "clock", "s").collect()} == {1: (2, 1), 2: (1, 1)}
    d = report.distribution(spark.createDataFrame([("x", float(i)) for i in range(11)] + [("x", None), ("x", float("nan"))], "k string, v double"), ["k"], "v").first()
    assert (d.n, d.mean, list(d.deciles)) == (11, 5.0, [float(i) for i in range(1, 10)])
    v = spark.createDataFrame([("x", 30, 4.0, 2), ("x", 60, 10.0, 5), ("x", 90, 10.0, 5)], "k string, clock int, ss double, n int")
    assert [r.variance for r in report.interval_variance(v, ["k"], "clock", "ss", "n").orderBy("clock").collect()] == [2.0, 2.0, None]


def test_catalogs_and_registry(spark, tmp_path):
    for n in ("AXN.statistics.v1", "AXN.definition.v1", "AXN.definition.v3", "AXN.mbp-1", "notes"):
        (tmp_path / n).mkdir()
    assert catalog.siblings(spark, str(tmp_path), "definition") == {1: [f"{tmp_path}/AXN.definition.v1"], 3: [f"{tmp_path}/AXN.definition.v3"]}
    assert catalog.schema_of("AXN.mbp-1") == "quotes" and catalog.schema_of("notes") is None
    assert catalog.free_path(spark, f"{tmp_path}/notes") == f"{tmp_path}/notes_2" and catalog.free_path(spark, f"{tmp_path}/new") == f"{tmp_path}/new"
    assert set(catalog.newest_first(spark, str(tmp_path))) >= {"notes"} and catalog.newest_first(spark, f"{tmp_path}/none") == []
    (tmp_path / "notes" / "AXN.mbp-1").mkdir()
    labels = catalog.catalogued(spark, [str(tmp_path), f"{tmp_path}/notes"])
    assert labels["AXN.mbp-1 (notes)"].endswith("notes/AXN.mbp-1") and "notes" in labels
    r = catalog.Registry()
    r.add("walk", lambda x, n=1, kind="a": (x, n, kind), {"n": 1, "kind": "a"}, {"kind": ["a", "b"]})
    assert r.call("walk", 5, kind="b") == (5, 1, "b")
    for bad, error in (({"m": 1}, KeyError), ({"n": 1.5}, TypeError), ({"n": True}, TypeError), ({"kind": "c"}, ValueError)):
        with pytest.raises(error):
            r.call("walk", 5, **bad)
    for args in (("walk", lambda: 0, {}), ("x", 5, {}), ("y", print, {"p": []}), ("z", print, {"p": 1}, {"p": [2]})):
        with pytest.raises((TypeError, ValueError)):
            r.add(*args)


def test_ranges_and_windows(spark, tmp_path):
    rows = spark.createDataFrame([(D + timedelta(h // 24), "a" if h % 3 else "b", at(h), h) for h in range(72)], "dt date, k string, t timestamp, x int")
    days.write_days(rows, str(tmp_path / "t"))
    got = [r.x for r in days.read_range(spark, str(tmp_path / "t"), "k", "a", "t", at(20), at(30)).collect()]
    assert got == [20, 22, 23, 25, 26, 28, 29]
    marks = spark.createDataFrame([(1, "b", at(7), at(13)), (2, "b", at(-9), at(0)), (3, "b", at(68), at(99)), (4, "z", at(1), at(2))], "m int, k string, a timestamp, z timestamp")
    near = days.around(rows, ["k"], "t", marks, "m", "a", "z", 1, 1)
    by = {m: sorted(r.x for r in near.where(F.col("m") == m).collect()) for m in (1, 2, 3, 4)}
    assert by == {1: [3, 6, 9, 12, 15, 18], 2: [0, 3], 3: [63, 66, 69], 4: []}
    days.save_filtered(rows.limit(3), {"day_type": ["fomc"]}, str(tmp_path / "f"))
    days.save_filtered(rows.limit(3), None, str(tmp_path / "g"))
    assert days.provenance(spark, str(tmp_path / "f")) == {"day_type": ["fomc"]} and days.provenance(spark, str(tmp_path / "g")) is None


def test_order_records_and_definitions(spark, tmp_path):
    rows = np.zeros(2, records.dtype("orders"))
    rows["instrument_id"], rows["ts_recv"], rows["order_id"], rows["price"], rows["size"], rows["action"], rows["side"] = 7, [10**15, 3 * 10**15], [1, 2], 5, 3, [b"A", b"C"], [b"b", b"N"]
    defs = np.zeros(4, records.dtype("definition"))
    defs["instrument_id"], defs["instrument_class"], defs["ts_recv"], defs["strike_price"] = [1, 1, 2, 3], [b"C", b"C", b"P", b"F"], [5, 9, 5, 5], [10**9, 2 * 10**9, 2**63 - 1, 1]
    defs["raw_symbol"], defs["expiration"], defs["contract_multiplier"] = b"AXN C100", 2 * 10**15, [50, 50, 2**31 - 1, 1]
    records.register(spark)
    for layout, data in (("orders", rows), ("definition", defs)):
        (tmp_path / layout).mkdir()
        (tmp_path / layout / "f.bin").write_bytes(records.pack(data))
    read = lambda layout: spark.read.format("records").option("layout", layout).option("path", str(tmp_path / layout)).load()
    e = sorted(records.order_events(read("orders")).collect(), key=lambda r: r.order_id)
    assert [(r.action, r.side, r.sz) for r in e] == [("A", "B", 3), ("C", None, 3)] and e[0].ts_recv == datetime(1970, 1, 12, 13, 46, 40)
    symbols = spark.createDataFrame([(7, "AXN", datetime(1970, 1, 1), datetime(1970, 1, 20))], "instrument_id long, symbol string, start timestamp, end timestamp")
    assert [(r.order_id, r.symbol) for r in records.order_events(read("orders"), symbols).collect()] == [(1, "AXN")]
    got = sorted((r.instrument_id, r.cp_flag, r.strike, r.multiplier) for r in records.definitions(read("definition")).collect())
    assert got == [(1, "call", 2.0, 50), (2, "put", None, None)]


def test_session_grid_over_the_change_of_clocks(spark):
    start = spark.createDataFrame([(date(2026, 3, 6),), (date(2026, 3, 10),)], "d date").select("d", calendar.session_start(F.col("d")).alias("s")).collect()
    assert [r.s.hour for r in start] == [23, 22]
    rows = [("S", date(2026, 3, 10), datetime(2026, 3, 9, 22, m), p, p, p, p, 1) for m, p in ((2, 5.0), (4, 7.0))] + [("S", date(2026, 3, 10), datetime(2026, 3, 9, 21, 59), 1.0, 1.0, 1.0, 1.0, 1), ("T", date(2026, 3, 10), None, 1.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, day date, minute timestamp, open double, high double, low double, close double, volume int").withColumn("start", calendar.session_start(F.col("day")))
    got = bars.session_grid(df, ["k", "day"], "start", minutes=6).orderBy("slot").collect()
    assert [(r.k, r.slot, r.close, r.open, r.volume, r.filled) for r in got] == [("S", 0, 5.0, 5.0, 0, True), ("S", 1, 5.0, 5.0, 0, True), ("S", 2, 5.0, 5.0, 1, False), ("S", 3, 5.0, 5.0, 0, True), ("S", 4, 7.0, 7.0, 1, False), ("S", 5, 7.0, 7.0, 0, True)]
    assert bars.session_grid(df.limit(0), ["k", "day"], "start").count() == 0


def test_selection_on_the_driver_and_in_spark_agree(spark, monkeypatch):
    import __spark_entry__ as entry
    from quantloom.operators import combine

    run = lambda: [(r.k, r.stage, r.members, round(r.total, 6)) for r in entry.queries()["combined_selection"](spark, "/root/testdata/sf0.001").collect()]
    here = run()
    monkeypatch.setattr(combine, "MOST_ROWS", 0)
    assert run() == here and here
