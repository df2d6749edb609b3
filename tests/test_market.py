"""Hand-checked cases of the market operators."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import calendar, market
from quantloom.operators import bars, book, combine, folds, indicators, joins, patterns, profile, regimes, report, rules, simulate

D = date(2026, 1, 5)


def minutes(n, start=datetime(2026, 1, 5, 14, 30)):
    return [start + timedelta(minutes=i) for i in range(n)]


def one(df, c):
    return df.select(c.alias("x")).first()["x"]


def test_weekdays_and_dates(spark):
    days = [date(2026, 1, 1) + timedelta(days=i) for i in range(20)]
    df = spark.createDataFrame([(a, b) for a in days for b in days if b >= a], "a date, b date").withColumn("n", calendar.weekdays_between(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r.n == sum((r.a + timedelta(days=i)).weekday() < 5 for i in range((r.b - r.a).days + 1))
    df = spark.range(1)
    assert one(df, calendar.nth_weekday(F.lit(2026), F.lit(3), 4, 3)) == date(2026, 3, 20)
    assert one(df, calendar.trade_date(F.lit("2026-01-05 18:00:00").cast("timestamp"))) == date(2026, 1, 6)
    assert one(df, calendar.trade_date(F.lit("2026-01-05 17:59:00").cast("timestamp"))) == D
    assert one(df, F.date_format(calendar.local(F.lit("2026-07-01 12:00:00").cast("timestamp")), "HH:mm")) == "08:00"
    assert calendar.snapshot_clocks(23 * 60, 60, 30) == ["23:30", "00:00", "00:30", "01:00"]


def test_prices_costs_and_sides(spark):
    df = spark.range(1)
    f = F.lit
    assert one(df, market.fixed_point(f(market.NO_PRICE))) is None and one(df, market.fixed_point(f(1_500_000_000))) == 1.5
    assert one(df, market.commission(f(1.3), 2.0, 0.5)) == pytest.approx(7.0)
    assert one(df, market.commission(f(1.0), 2.0, None)) == 4.0
    assert [one(df, market.slippage(f(g), f(2.0), 1, 12.5)) for g in (10.0, 0.0, -1.0)] == [25.0, 25.0, 50.0]
    side = lambda p, b, a, s: one(df, market.aggressor(f(p), f(b), f(a), f(s)))
    assert [side(2.0, 1.0, 2.0, "A"), side(1.0, 1.0, 2.0, "B"), side(1.5, 1.0, 2.0, "B"), side(1.0, 1.0, 1.0, "b"), side(1.0, 1.0, 1.0, "N")] == [1, -1, 0, 1, 0]
    assert one(df, market.asset_of(f("MESH4"), ["M", "MES", "ES"])) == "MES" and one(df, market.asset_of(f("ESH4-ESM4"), ["ES"])) is None
    assert one(df, market.snap(f(10.30), 0.25, f(True))) == 10.5 and one(df, market.snap(f(10.30), 0.25, f(False))) == 10.25
    assert one(df, market.root_of(f("ESH4"))) == "ES"
    assert one(df, market.signed_percent(f(1.0), f(0.0))) == 0.0


def trades(spark, ticks, **more):
    rows = [(1, i, D + timedelta(days=i), "long" if i % 2 else "short", float(t), 100.0, 99.0, 102.0, float(t), datetime(2026, 1, 5) + timedelta(days=i), datetime(2026, 1, 5, 1) + timedelta(days=i), "stop", None) for i, t in enumerate(ticks)]
    return spark.createDataFrame(rows, "run_id int, trade_id int, day date, direction string, ticks double, entry_price double, sl double, tp double, pnl_points double, entry_time timestamp, exit_time timestamp, exit_reason string, day_type string")


def test_cells(spark):
    c = report.cells(trades(spark, [10, 20, 30]), ["run_id"], "ticks", "day").first()
    assert (c.total_ticks, c.profit_factor, c.win_rate) == (60.0, math.inf, 100.0)
    assert c.sharpe_trade == pytest.approx(2 * math.sqrt(252)) and c.sharpe_daily == pytest.approx(2 * math.sqrt(252))
    c = report.cells(trades(spark, [3, 2, 0, -2, -3]), ["run_id"], "ticks", "day", 2.0).first()
    assert (c.win_rate, c.win_rate_be, c.profit_factor) == (20.0, 80.0, 1.0)
    assert report.cells(trades(spark, [4]), ["run_id"], "ticks", "day").first().sharpe_trade is None


def test_report_streaks_and_drawdown(spark):
    r = report.trade_report(trades(spark, [5, 5, -3, 0, -4, 9]), ["run_id"], ["trade_id"]).first()
    assert (r.max_consec_wins, r.max_consec_losses, r.max_drawdown, r.max_peak) == (2, 3, -7.0, 12.0)
    assert r.calmar == pytest.approx(12 / 7) and r.avg_rr_planned == 2.0
    r = report.trade_report(trades(spark, [0, 0]), ["run_id"], ["trade_id"]).first()
    assert r.profit_factor == 0.0 and r.calmar == math.inf and r.sharpe_daily == 0.0


def test_newey_west_against_numpy(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=60)
    y = 0.5 + 2 * x + g.normal(size=60)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k int, i int, x double, y double")
    got = report.exposure(df, ["k"], "i").first()
    z = np.column_stack([np.ones(60), x])
    beta = np.linalg.solve(z.T @ z, z.T @ y)
    s = z * (y - z @ beta)[:, None]
    m = s.T @ s + sum((1 - k / 6) * (s[k:].T @ s[:-k] + s[:-k].T @ s[k:]) for k in range(1, 6))
    inv = np.linalg.inv(z.T @ z)
    cov = inv @ m @ inv
    assert (got.alpha, got.beta) == pytest.approx(tuple(beta))
    assert (got.t_alpha, got.t_beta) == pytest.approx((beta[0] / cov[0, 0] ** 0.5, beta[1] / cov[1, 1] ** 0.5))
    assert report.exposure(df.limit(2), ["k"], "i").count() == 0


def test_adf_against_normal_equations(spark):
    g = np.random.default_rng(4)
    c = 100 + np.cumsum(g.normal(size=80))
    df = spark.createDataFrame([(1, t, float(v), 10) for t, v in zip(minutes(80), c)], "k int, minute timestamp, close double, volume long")
    r = regimes.returns(df, ["k"])
    got = regimes.adf(r, ["k"], F.col("close")).first()
    d = np.diff(c)
    x = np.column_stack([np.ones(78), c[1:-1], d[:-1]])
    y = d[1:]
    b = np.linalg.solve(x.T @ x, x.T @ y)
    s2 = ((y - x @ b) ** 2).sum() / (78 - 3)
    t = b[1] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1])
    assert got.n == 78 and got.adf_t == pytest.approx(t, rel=1e-6)
    assert regimes.efficiency(r, ["k"], F.col("close")).first().er == pytest.approx(abs(c[-1] - c[0]) / np.abs(d).sum())


def test_variance_ratio_tells_reversion_from_trend(spark):
    def vr(signs):
        c = 5000 * np.exp(np.cumsum(0.0008 * np.array(signs)))
        df = spark.createDataFrame([(1, t, float(v), 10) for t, v in zip(minutes(len(c)), c)], "k int, minute timestamp, close double, volume long")
        r = regimes.returns(df, ["k"])
        return regimes.variance_ratio(r, ["k"], 5).first().vr, regimes.hurst_variance(r, ["k"]).first().hurst

    flip, runs = vr([1, -1] * 60), vr(([1] * 20 + [-1] * 20) * 3)
    assert flip[0] < 0.3 < 1 < runs[0] and flip[1] < 0.5 < runs[1]


def test_returns_skip_gaps_and_robust_z(spark):
    t = [*minutes(3), *minutes(3, datetime(2026, 1, 5, 15, 0))]
    df = spark.createDataFrame([(1, x, 100.0 + i, 1) for i, x in enumerate(t)], "k int, minute timestamp, close double, volume long")
    assert [r.valid for r in regimes.returns(df, ["k"]).orderBy("minute").collect()] == [False, True, True, False, True, True]
    z = spark.createDataFrame([(1, D + timedelta(days=i), float(v)) for i, v in enumerate([1, 2, 3, 4, 10])], "k int, day date, v double")
    last = regimes.robust_z(z, ["k"], "day", "v").orderBy("day").collect()[-1]
    assert (last.center, last.hist_n) == (2.5, 4) and last.z == pytest.approx(7.5 / 1.4826)
    assert regimes.robust_z(z, ["k"], "day", "v").orderBy("day").first().z is None


def test_hysteresis_and_no_overlap(spark):
    z = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 1.2, 0.7, None, 0.4, -1.5, -0.6, 2.0])], "k int, i int, z double")
    got = [r.state for r in folds.hysteresis(z, ["k"], ["i"], "z").orderBy("i").collect()]
    assert got == ["normal", "high", "high", "unknown", "normal", "low", "low", "high"]
    g = np.random.default_rng(8)
    zs = [None if u > 0.95 else float(round(v, 1)) for u, v in zip(g.random(400), g.normal(size=400))]
    state, want = "normal", []
    for v in zs:
        if v is None:
            want.append("unknown")
            continue
        if (state == "high" and v < 0.5) or (state == "low" and v > -0.5):
            state = "normal"
        if state == "normal":
            state = "high" if v > 1 else "low" if v < -1 else "normal"
        want.append(state)
    many = spark.createDataFrame([(1, i, v) for i, v in enumerate(zs)], "k int, i int, z double")
    assert [r.state for r in folds.hysteresis(many, ["k"], ["i"], "z").orderBy("i").collect()] == want
    t0 = datetime(2026, 1, 5)
    spans = [(0, 10), (5, 6), (10, 12), (11, 13), (12, 12)]
    df = spark.createDataFrame([(1, i, t0 + timedelta(minutes=a), t0 + timedelta(minutes=b)) for i, (a, b) in enumerate(spans)], "k int, i int, e timestamp, x timestamp")
    assert sorted(r.i for r in folds.no_overlap(df, ["k"], "e", "x", ["i"]).collect()) == [0, 2, 4]
    spans = sorted((int(a), int(a + b)) for a, b in zip(g.integers(0, 600, 300), g.integers(0, 12, 300)))
    df = spark.createDataFrame([(1, i, t0 + timedelta(minutes=a), t0 + timedelta(minutes=b)) for i, (a, b) in enumerate(spans)], "k int, i int, e timestamp, x timestamp")
    keep, last = [], -1
    for i, (a, b) in enumerate(spans):
        if a >= last:
            keep.append(i)
            last = b
    assert sorted(r.i for r in folds.no_overlap(df, ["k"], "e", "x", ["i"]).collect()) == keep


def test_sizing(spark):
    t = trades(spark, [10, -5, 10, -5])
    kelly = folds.sized(t, ["run_id"], ["trade_id"], folds.kelly_rule()).orderBy("trade_id").collect()
    share = (0.5 - 0.5 / 2) * 0.25
    assert kelly[0].contracts == pytest.approx(math.floor(100_000 * share / 62.5 / 0.1) * 0.1)
    only = folds.sized(trades(spark, [1, 2]), ["run_id"], ["trade_id"], folds.kelly_rule()).collect()
    assert all(r.contracts == 0 for r in only)
    risk = folds.sized(t, ["run_id"], ["trade_id"], folds.risk_rule()).orderBy("trade_id").first()
    assert risk.contracts == pytest.approx(80.0)
    fixed = folds.sized(t, ["run_id"], ["trade_id"], folds.fixed_rule(1.5)).orderBy(F.desc("trade_id")).first()
    assert fixed.equity == 100_000 + 10 * 12.5 * 1.5
    d = report.dollar_metrics(folds.sized(t, ["run_id"], ["trade_id"], folds.fixed_rule(1.0)), ["run_id"], ["trade_id"]).first()
    assert (d.total, d.total_trades, d.win_rate, d.profit_factor) == (125.0, 4, 0.5, 2.0)


def day_bars(spark, rows):
    return spark.createDataFrame([("S", D, t, *map(float, r), 100) for t, r in zip(minutes(len(rows)), rows)], "symbol string, day date, minute timestamp, open double, high double, low double, close double, volume long")


def test_opening_range_exits(spark):
    flat = [(100, 101, 99, 100)] * 15
    run = lambda tail, **k: rules.opening_range(day_bars(spark, flat + tail), ["symbol", "day"], **k).collect()
    up = [(100, 102, 100, 102), (102, 103, 101, 102)]
    tie = run([*up, (102, 107, 99, 103)])[0]
    assert (tie.direction, tie.exit_reason, tie.exit_price, tie.pnl_points) == ("long", "sl", 100.0, -2.0)
    hit = run([*up, (102, 107, 101, 103)])[0]
    assert (hit.exit_reason, hit.exit_price) == ("tp", 106.0)
    late = run([*up, (102, 103, 101, 101.5), (102, 102.5, 101, 101.5)], timeout_minutes=1)[0]
    assert (late.exit_reason, late.exit_price, late.tp) == ("tp", 102.0, 102.0)
    gain = run([*up, (102, 104, 101.5, 103)], timeout_minutes=1)[0]
    assert (gain.exit_reason, gain.exit_price) == ("timeout_profit", 103.0)
    assert run([(100, 101, 99, 100)] * 3) == []
    assert rules.opening_range(day_bars(spark, flat).limit(0), ["symbol", "day"]).count() == 0


def test_vwap_trend_fills_and_carries(spark):
    rows = [(10, 10, 10, 11), (11, 12, 11, 12), (12, 12, 8, 8), (8, 8, 7, 7), (7, 9, 7, 9)]
    df = day_bars(spark, rows).withColumn("vwap", F.lit(10.0))
    got = sorted(rules.vwap_trend(df, ["symbol", "day"], "vwap").collect(), key=lambda r: r.entry_minute)
    assert [(r.direction, r.entry_price, r.exit_price, r.exit_reason) for r in got] == [("long", 11.0, 8.0, "vwap_flip"), ("short", 8.0, 9.0, "eod")]
    idle = df.withColumn("volume", F.when(F.col("close") == 8, 0).otherwise(F.col("volume")))
    got = sorted(rules.vwap_trend(idle, ["symbol", "day"], "vwap").collect(), key=lambda r: r.entry_minute)
    assert [(r.direction, r.entry_price) for r in got] == [("long", 11.0), ("short", 7.0)]
    out = rules.vwap_trend(df, ["symbol", "day"], "vwap", excluded=F.col("open") == 12).collect()
    assert any(r.exit_reason == "exclusion" for r in out)


def test_sweep_axes():
    assert rules.combinations({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]
    assert rules.number_range(0.1, 0.5, 0.1) == [0.1, 0.2, 0.3, 0.4, 0.5] and rules.number_range(1, 2, 0.75) == [1, 1.75, 2]


def test_asof_modes_and_guards(spark):
    t0 = datetime(2026, 1, 5, 10)
    left = spark.createDataFrame([(1, "a", t0), (2, "a", t0 + timedelta(minutes=5)), (3, None, t0), (4, "b", None), (5, "a", t0 - timedelta(days=3))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", t0, 7), ("a", t0 - timedelta(days=2), 6), (None, t0, 9)], "k string, r timestamp, v int")
    get = lambda **k: {x.id: x.v for x in joins.asof(left, right, ["k"], "t", "r", ["v"], **k).collect()}
    assert get() == {1: 7, 2: 7, 3: None, 4: None, 5: None}
    assert get(strict=True)[1] == 6
    assert get(tolerance_seconds=60) == {1: 7, 2: None, 3: None, 4: None, 5: None}
    assert {x.v for x in joins.asof(left, right.limit(0), ["k"], "t", "r", ["v"]).collect()} == {None}


def test_legs_and_defaults(spark):
    t = spark.createDataFrame([(1, 10, 1), (2, 5, -1)], "sid int, size int, sign int")
    legs = spark.createDataFrame([(1, 100, 1, 1), (1, 101, 2, -1)], "sid int, leg int, ratio int, leg_sign int")
    assert sorted((r.leg, r.size, r.sign) for r in joins.legs(t, legs, "sid", "size", "sign").collect()) == [(100, 10, 1), (101, 20, -1)]
    look = spark.createDataFrame([(1, "fomc")], "sid int, bucket string")
    assert {r.sid: r.bucket for r in joins.with_default(t, look, "sid", "bucket", "normal").collect()} == {1: "fomc", 2: "normal"}


def test_day_buckets(spark):
    rows = [(D, "CPI m/m", "red"), (D, "FOMC Statement", "red"), (D + timedelta(1), "Bank Holiday", "grey"), (D + timedelta(1), "CPI", "red"), (D + timedelta(2), "Flash PMI", "red"), (D + timedelta(3), "Trade Balance", "orange")]
    got = {r.d: r.bucket for r in report.bucket_days(spark.createDataFrame(rows, "d date, name string, impact string"), "d", F.col("name"), F.col("impact")).collect()}
    assert got == {D: "fomc", D + timedelta(1): "holiday", D + timedelta(2): "other_high_impact"}


def test_red_events_make_the_bucket_of_a_day(spark):
    rows = [("a", "Bank Holiday", "grey"), ("a", "CPI m/m", "red"), ("b", "Retail Sales m/m", "red"), ("b", "Core PPI m/m", "red"), ("c", "CPI m/m", "red"), ("c", "FOMC Statement", "red"), ("d", "Flash Manufacturing PMI", "red"), ("e", "CPI m/m", "orange"), ("f", "Non-Farm Employment Change", "red"), ("g", "Rate Decision", "red"), ("h", None, "red"), (None, "CPI", "red")]
    got = {r.d: r.bucket for r in report.bucket_days(spark.createDataFrame(rows, "d string, name string, impact string"), "d", F.col("name"), "impact").collect()}
    assert got == {"a": "holiday", "b": "ppi", "c": "fomc", "d": "other_high_impact", "f": "nfp", "g": "other_high_impact", "h": "other_high_impact"}


def test_members_without_a_common_day_have_a_correlation(spark):
    rows = [("a", 1, 5.0), ("a", 2, -1.0), ("b", 3, 4.0), ("c", 1, 2.0), ("c", 3, 2.0), (None, 1, 1.0)]
    got = {(r.a, r.b): r["corr"] for r in report.correlations(spark.createDataFrame(rows, "m string, d int, x double"), "m", "d", "x").collect()}
    daily = {"a": [5, -1, 0], "b": [0, 0, 4], "c": [2, 0, 2]}
    assert got == {(x, y): pytest.approx(float(np.corrcoef(daily[x], daily[y])[0, 1])) for x in daily for y in daily if x < y}


def test_clock_of_a_book_holds_for_all_its_levels(spark):
    day = date(2026, 1, 5)
    rows = [("S", day, 1, datetime(2026, 1, 5, 10, 0, 9), "A", "B", 100, 5, 1), ("S", day, 2, datetime(2026, 1, 5, 10, 0, 4), "A", "A", 101, 5, 2), ("S", day, 5000, datetime(2026, 1, 5, 10, 0, 2), "A", "A", 102, 5, 3)]
    df = spark.createDataFrame(rows, "symbol string, session_date date, seq long, ts timestamp, action string, side string, px long, sz long, order_id long")
    assert {r.sec % 60 for r in book.depth_by_second(df).collect()} == {9}


def test_book_depth_follows_a_hand_trace(spark):
    ev = [("A", "B", 100, 5, 1), ("A", "B", 100, 3, 2), ("F", None, 9, 2, 1), ("M", "B", 101, 4, 2), ("C", None, 9, 9, 7), ("C", "A", 9, 3, 1), ("R", "N", 0, 0, 0), ("A", "A", 102, 1, 1)]
    rows = [("S", D, i + 1, datetime(2026, 1, 5, 0, 0, i), a, s, p, z, o) for i, (a, s, p, z, o) in enumerate(ev)]
    df = spark.createDataFrame(rows, "symbol string, session_date date, seq long, ts timestamp, action string, side string, px long, sz long, order_id long")
    got = sorted((r.life, r.sec % 60, r.side, r.px, r.size) for r in book.depth_by_second(df).collect())
    assert got == [(0, 0, "B", 100, 5), (0, 1, "B", 100, 8), (0, 2, "B", 100, 6), (0, 3, "B", 100, 3), (0, 3, "B", 101, 4), (0, 5, "B", 100, 0), (1, 7, "A", 102, 1)]


def test_value_area():
    price = np.arange(10.0)
    volume = np.array([1, 2, 9, 3, 1, 1, 2, 3, 2, 1.0])
    poc, vah, val = profile.value_area(price, volume)
    assert poc == 2.0 and val <= 2 <= vah and volume[(price >= val) & (price <= vah)].sum() >= 0.7 * volume.sum()
    assert profile.value_area(np.array([]), np.array([])) is None
    assert profile.value_area(np.array([1.0, 2.0]), np.array([5.0, 1.0]))[0] == 1.0


def test_ema_matches_recursion(spark):
    df = spark.createDataFrame([(1, t, float(v)) for t, v in zip(minutes(6), [1, 2, 4, 8, 4, 2])], "k int, minute timestamp, close double")
    got = [r.e for r in indicators.ema(df, ["k"], "minute", "close", 3, "e").orderBy("minute").collect()]
    want = [1.0]
    for v in [2, 4, 8, 4, 2]:
        want.append(0.5 * v + 0.5 * want[-1])
    assert got == pytest.approx(want)


def test_greedy_choice_and_compatibility():
    v = lambda n, t: combine.Variant(n, n[0], t)
    pool = [v("a", [(0, 10, 0, 5.0)]), v("b", [(10, 20, 0, 4.0)]), v("c", [(5, 15, 0, 6.0)]), v("d", [(30, 40, 0, -1.0)])]
    path = combine.choose(pool, np.eye(4))
    assert sorted(path[-1]["members"]) in (["a", "b"], ["c"]) and path[-1]["total"] >= 6
    assert combine.total([pool[0].trades, pool[2].trades]) == 5.0
    with pytest.raises(ValueError):
        combine.compatible([{"ticker": "A", "dataset": "d", "ticks_per_point": 4, "start_date": D, "end_date": D}, {"ticker": "B", "dataset": "d", "ticks_per_point": 4, "start_date": D, "end_date": D}])


def test_stopped_paths_rules(spark):
    win = simulate.stopped_paths(spark, np.array([100.0]), 8, 50, 1000.0, 1, 500.0, 300.0).collect()
    assert {(r.outcome, r.stop_step, r.final_equity) for r in win} == {("pass", 5, 1500.0)}
    lose = simulate.stopped_paths(spark, np.array([-100.0]), 8, 50, 1000.0, 1, 500.0, 300.0, 200.0).collect()
    assert {(r.outcome, r.stop_step) for r in lose} == {("fail:static", 2)}
    held = simulate.stopped_paths(spark, np.array([600.0]), 4, 3, 1000.0, 1, 500.0, consistency=0.4).collect()
    assert {(r.outcome, r.held, r.stop_step) for r in held} == {("pass", True, 3)}
    same = [simulate.stopped_paths(spark, np.array([5.0, -4.0]), 300, 20, 1000.0, 9, 20.0, 30.0).orderBy("path").collect() for _ in range(2)]
    assert same[0] == same[1]


def test_switching_paths_absorb_and_stay(spark):
    p = simulate.switching_paths(spark, np.array([1.0, 0.0]), np.array([[0.0, 1.0], [0.0, 0.0]]), np.array([1.0, 0.0]), [np.array([7.0]), np.array([])], 5, 4, 100.0, 3).collect()
    assert {(r.step, r.state) for r in p} == {(1, 0), (2, 1), (3, 1), (4, 1)} and {r.equity for r in p} == {107.0}


def test_bars_roll_and_bands(spark):
    t = spark.createDataFrame([("x", "F1", 100), ("x", "F2", 21), ("y", "F1", 100), ("y", "F2", 20), ("z", "F1", 1)], "g string, s string, v long")
    got = {r.g: (r.front, r.is_roll_day) for r in bars.front_and_roll(t, ["g"], "s", "v").collect()}
    assert got == {"x": ("F1", True), "y": ("F1", False), "z": ("F1", False)}
    p = spark.createDataFrame([(i, 1, float(i)) for i in range(5)], "path long, step int, equity double")
    assert {(r.percentile, r.equity) for r in simulate.bands(p, [50.0, 100.0]).collect()} == {(50.0, 2.0), (100.0, 4.0)}
    assert {r.label for r in simulate.featured(p).collect()} == {"best final equity", "worst final equity"}


def test_inverse_gap_by_hand(spark):
    flat = lambda lo, hi, n: [(lo, hi, lo, hi)] * n
    # Coarse gap: bars 0-4 top at 101, 10-14 bottom at 103 (bullish gap 101..103, confirmed at minute 15).
    rows = flat(100, 101, 5) + flat(101, 104, 5) + flat(103, 106, 5)
    rows += [(105, 106, 104, 104.5)]  # 15: confirmed, not yet after it
    rows += [(104.5, 105, 104.2, 104.4)]  # 16
    rows += [(104.4, 104.5, 103.5, 103.6)]  # 17: falls
    rows += [(103.6, 103.7, 102.5, 102.6)]  # 18: enters the gap; fine bearish gap below 104.2 (bar 16's low)
    rows += [(102.6, 104.6, 102.4, 104.5)]  # 19: closes above 104.2: entry, stop 102.4, target 106
    rows += [(104.5, 106.5, 104, 106)]  # 20: target
    t = patterns.inverse_gap_trades(day_bars(spark, rows), ["symbol", "day"], 5).collect()
    assert [(r.direction, r.entry_price, r.sl, r.tp, r.exit_reason, r.pnl_points) for r in t] == [("long", 104.5, 102.4, 106.0, "tp", 1.5)]
    assert patterns.inverse_gap_trades(day_bars(spark, rows[:12]), ["symbol", "day"], 5).count() == 0
    broken = rows[:17] + [(104.4, 104.5, 100, 100.5)] + rows[18:]
    assert patterns.inverse_gap_trades(day_bars(spark, broken), ["symbol", "day"], 5).count() == 0
