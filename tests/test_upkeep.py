"""The data-upkeep operators against brute force on small random fixtures with every kind of dirt."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.operators import changes, history, known, late, regular, trailing

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


FEED = "symbol string, session_date date, seq long, ts_recv timestamp, action string, side string, px long, sz long, order_id long, epoch int, slice string"


def feed_rows(seed, n=600):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        book = r.choice(["HOT", "HOT", "B", None]) if r.random() < 0.05 else r.choice(["HOT", "HOT", "B"])
        seq = r.randrange(1, n) * 3 if r.random() > 0.02 else None
        row = [book, date(2024, 1, 1), seq, at(r.randrange(10_000)), r.choice("AAACCFMT" + "R" * (r.random() < 0.1)), r.choice(["A", "b", None]), r.choice([100, 2**63 - 1]), r.choice([1, 3, 5, None, 0, -2]), r.choice([1, 2, 3, 4, 5, None]), 7, "clash"]
        rows.append(tuple(row))
        if r.random() < 0.2:
            copy = list(row)
            copy[3] = at(r.randrange(10_000))
            copy[7] = r.choice([2, 4])
            rows.append(tuple(copy))
        if r.random() < 0.1:
            rows.append(tuple(row))
    r.shuffle(rows)
    return rows


def brute_state(rows):
    last = {}
    code = {"A": 1, "M": 1, "C": 2, "F": 2, "R": 3}
    for row in rows:
        if row[0] is None or row[2] is None:
            continue
        none = lambda x: (x is not None, x)
        rank = (row[3], code.get(row[4], 0), none(row[8]), none(row[7]), none(row[5]), none(row[6]))
        k = row[:3]
        if k not in last or rank > last[k][0]:
            last[k] = rank, row
    books = {}
    for k in sorted(last):
        row = last[k][1]
        book = books.setdefault(k[:2], {})
        action, side, px, sz, oid = row[4:9]
        if action == "R":
            book.clear()
        elif oid is None:
            continue
        elif action in "AM":
            book[oid] = [side, px, sz or 0]
        elif action in "CF" and oid in book:
            book[oid][2] -= max(sz or 0, 0)
            if book[oid][2] <= 0 and (sz or 0) > 0:
                del book[oid]
    return sorted((*k, oid, *v) for k, b in books.items() for oid, v in b.items() if v[2] > 0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_current_state_equals_replay(spark, seed):
    rows = feed_rows(seed)
    df = spark.createDataFrame(rows, FEED)
    got = changes.current_state(df, changes.order_feed(df), epoch_size=64, slices=3)
    assert sorted(map(str, [(r.symbol, r.session_date, r.order_id, r.side, r.px, r.sz) for r in got.collect()])) == sorted(map(str, brute_state(rows)))


def test_state_of_empty_feed(spark):
    df = spark.createDataFrame([], FEED)
    assert changes.current_state(df, changes.order_feed(df)).count() == 0


def test_open_gap_is_held_until_it_is_old(spark):
    rows = [("B", date(2024, 1, 1), s, at(t), "A", "B", 1, 1, s, 0, "") for s, t in [(1, 0), (2, 1), (5, 100), (6, 130)]]
    df = spark.createDataFrame(rows, FEED)
    spec = changes.order_feed(df)
    held = changes.current_state(df, spec, hold_seconds=60)
    assert sorted(r.order_id for r in held.collect()) == [1, 2]
    free = changes.current_state(df, spec, hold_seconds=20)
    assert sorted(r.order_id for r in free.collect()) == [1, 2, 5, 6]
    marks = changes.watermarks(changes.latest_copies(df, spec, 2), 2, 60)
    assert [r.watermark for r in marks.collect()] == [2]


def test_incomplete_transaction_is_not_shown(spark):
    rows = [("B", 1, at(0), "A", 1, 10, 1), ("B", 2, at(1), "A", 1, 11, 1), ("B", 3, at(2), "A", 1, 12, 2)]
    df = spark.createDataFrame([(*r, 2 if r[1] == 3 else 1) for r in rows], "t string, seq long, arrived timestamp, a string, amount long, key long, txn long, size int")
    spec = changes.Feed(["t"], "key", "seq", "arrived", F.lit(changes.SET), "amount", [], "txn", "size")
    assert sorted(r.key for r in changes.current_state(df, spec, hold_seconds=10).collect()) == [10, 11]


def test_transaction_over_two_epochs_is_complete(spark):
    rows = [("B", 4094 + i, at(i), "A", 1, 10 + i, 7 if i else 6, 3 if i else 1) for i in range(4)]
    df = spark.createDataFrame(rows, "t string, seq long, arrived timestamp, a string, amount long, key long, txn long, size int")
    spec = changes.Feed(["t"], "key", "seq", "arrived", F.lit(changes.SET), "amount", [], "txn", "size")
    assert sorted(r.key for r in changes.current_state(df, spec, hold_seconds=10).collect()) == [10, 11, 12, 13]


def test_incomplete_transaction_is_dropped_whole_once_its_hold_is_over(spark):
    rows = [("B", 1, at(0), 10, 1, 1), ("B", 2, at(1), 11, 2, 2), ("B", 3, at(500), 12, 3, 1), ("B", 4, at(501), 13, None, None)]
    df = spark.createDataFrame(rows, "t string, seq long, arrived timestamp, key long, txn long, size int").withColumn("amount", F.lit(1))
    spec = changes.Feed(["t"], "key", "seq", "arrived", F.lit(changes.SET), "amount", [], "txn", "size")
    shown = lambda hold, epoch: sorted(r.key for r in changes.current_state(df, spec, epoch, hold_seconds=hold).collect())
    for epoch in (2, 4096):
        assert shown(None, epoch) == [10, 12, 13]
        assert shown(100, epoch) == [10, 12, 13]
        assert shown(1000, epoch) == [10]


def test_held_transaction_over_two_epochs_hides_what_follows(spark):
    rows = [("B", s, at(s - 4090), 10 + i, x, n) for i, (s, x, n) in enumerate([(4094, 1, 1), (4095, 2, 3), (4096, 2, 3), (4097, 3, 1)])]
    df = spark.createDataFrame(rows, "t string, seq long, arrived timestamp, key long, txn long, size int").withColumn("amount", F.lit(1))
    spec = changes.Feed(["t"], "key", "seq", "arrived", F.lit(changes.SET), "amount", [], "txn", "size")
    assert sorted(r.key for r in changes.current_state(df, spec, hold_seconds=1000).collect()) == [10]
    assert sorted(r.key for r in changes.current_state(df, spec).collect()) == [10, 13]


def test_known_at_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, 2, None]), at(300 * r.randrange(400)), None, i, r.choice([None, 5, 6])) for i in range(400)]
    rows = [(e, b, b + timedelta(seconds=r.choice([1, 90, 200_000])) if r.random() > 0.03 else None, i, x) for e, b, _, i, x in rows]
    rows += rows[:30]
    prints = [(i, r.choice([1, 2, 3, None]), at(r.randrange(400_000)) if r.random() > 0.05 else None, "z") for i in range(300)]
    prints += prints[:20]
    v = spark.createDataFrame(rows, "e long, v timestamp, r timestamp, id long, x int")
    p = spark.createDataFrame(prints, "print_id long, e long, t timestamp, cell string")
    got = {x.print_id: (x.id, x.x) for x in known.known_at(p, "print_id", "t", v, "e", "v", "r", "id", ["x"], 7200).collect()}
    want = {}
    for i, e, t, _ in prints:
        ok = [(b, k, n, x) for (ee, b, k, n, x) in rows if ee == e and e is not None and k is not None and t is not None and k <= t]
        if ok:
            best = max(ok, key=lambda y: y[:3])
            want[i] = best[2], best[3]
    assert got == want
    assert known.known_at(p.limit(0), "print_id", "t", v, "e", "v", "r", "id").count() == 0
    assert known.known_at(p, "print_id", "t", v.limit(0), "e", "v", "r", "id").count() == 0


def test_regions_are_disjoint_and_current(spark):
    r = random.Random(6)
    rows = [(1, at(300 * r.randrange(50)), at(r.randrange(300_000)), i) for i in range(120)]
    v = spark.createDataFrame([*rows, *rows[:9], (None, T0, T0, 1), (1, None, T0, 2)], "e long, v timestamp, r timestamp, id long")
    us = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    got = known.regions(v, "e", "v", "r", "id", 3600).collect()
    for _ in range(300):
        x, y = us(at(r.randrange(16_000))), us(at(r.randrange(310_000)))
        cell = x // 3_600_000_000
        inside = [g.id for g in got if g.cell == cell and g.valid_from <= x and (g.valid_to is None or x < g.valid_to) and g.recorded_from <= y and (g.recorded_to is None or y < g.recorded_to)]
        known_then = [(us(b), us(k), i) for _, b, k, i in rows if us(b) // 3_600_000_000 == cell and us(b) <= x and us(k) <= y]
        assert inside == ([max(known_then)[2]] if known_then else [])


@pytest.mark.parametrize("seed", [11, 12])
def test_any_point_of_the_plane_is_located(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("HHHK"), at(300 * r.randrange(300)), at(r.randrange(120_000)), i, r.choice([None, 1.5, float("nan")])) for i in range(300)]
    points = [(i, r.choice("HHHK"), at(r.randrange(120_000)), at(r.randrange(130_000))) for i in range(400)]
    v = spark.createDataFrame(rows, "e string, v timestamp, r timestamp, id long, x double")
    p = spark.createDataFrame(points, "p long, e string, asked timestamp, t timestamp")
    got = {g.p: g.id for g in known.known_at(p, "p", "t", v, "e", "v", "r", "id", ["x"], 7200, "asked").collect()}
    want = {}
    for i, e, x, t in points:
        ok = [(b, k, n) for ee, b, k, n, _ in rows if ee == e and b <= x and k <= t]
        if ok:
            want[i] = max(ok)[2]
    assert got == want


def test_trailing_totals_equal_brute_force(spark):
    r = random.Random(7)
    rows = [(r.choice([1, 1, 2, None]), date(2024, 1, 1) + timedelta(days=r.randrange(90)) if r.random() > 0.05 else None, r.choice([0.1, -0.1, 2.5, -7.0, None, float("nan")])) for _ in range(300)]
    df = spark.createDataFrame(rows, "run long, day date, x double")
    got = {(g.run, g.day): (float(g.total_7), float(g.total_30)) for g in trailing.by_day(trailing.trailing_segments(df, "run", "day", "x")).collect()}
    want = {}
    for run in (1, 2):
        ok = [(d, x) for e, d, x in rows if e == run and d and x is not None and not math.isnan(x)]
        d = min(a for a, _ in ok)
        while d <= max(a for a, _ in ok):
            want[run, d] = tuple(round(sum(x for a, x in ok if d - timedelta(days=n) < a <= d), 6) for n in (7, 30))
            d += timedelta(days=1)
    assert {k: (round(a, 6), round(b, 6)) for k, (a, b) in got.items()} == want
    assert trailing.trailing_segments(df.limit(0), "run", "day", "x").count() == 0


def test_session_days_in_every_notation(spark):
    text = ["2024-01-05", "20240105", "2024-01-05T00:00:00", "2024-01-05 00:00:00", "2024/1/5", " 2024.01.05 ", "2024-13-40", "x", "", None]
    df = spark.createDataFrame([(t,) for t in text], "t string").select("t", trailing.session_day(F.col("t")).alias("d"))
    got = [r.d for r in df.collect()]
    assert got == [date(2024, 1, 5)] * 6 + [None] * 4


def reading_rows(seed):
    r = random.Random(seed)
    rows = []
    for s in ("X", "Y", "Z"):
        t = 0.0
        for i in range(60):
            t += r.choice([0.2, 1.0, 3.7, 29.9, 31.2, 2500.0])
            good = s != "Z"
            bid = r.choice([10.0, 11.0, None, float("nan")]) if good else None
            rows.append((f"{s}{i}".__hash__() % 10**9, s, date(2024, 1, 1), at(t), bid, 5.0, r.choice([1, 2, None]), at(t + 1)))
    rows += [(*x[:4], 12.0, x[5], x[6], x[7] + timedelta(hours=3)) for x in rows[:8]] + rows[20:25]
    return rows


READ = "reading_id long, symbol string, session_date date, ts timestamp, best_bid double, close double, volume long, recv_at timestamp"


def test_missing_slots_equal_brute_force(spark):
    rows = reading_rows(8)
    df = spark.createDataFrame(rows, READ)
    readings = regular.last_copies(df, "reading_id", "recv_at", ["symbol", "session_date"], "ts", ["best_bid", "close", "volume"])
    series = lambda x: regular.regular_series(x, ["symbol", "session_date"], ["best_bid", "close", "volume"], ["best_bid", "close"], ["volume"], 30, 60)
    got = {(g.symbol, g.slot): g.reading_id for g in regular.missing_slots(series(readings)).collect()}
    last = {}
    for x in rows:
        if x[0] not in last or x[7] > last[x[0]][7]:
            last[x[0]] = x
    want = {}
    epoch = datetime(1970, 1, 1)
    sec = lambda t: (t - epoch).total_seconds()
    for s in ("X", "Y", "Z"):
        own = sorted((x for x in last.values() if x[1] == s), key=lambda x: x[3])
        ok = [x for x in own if x[4] is not None and not math.isnan(x[4]) and x[6] is not None]
        have = {int(sec(x[3]) // 1) for x in ok}
        for slot in range(int(sec(own[0][3]) // 1), int(sec(own[-1][3]) // 1) + 1):
            if slot not in have:
                before = [x for x in ok if sec(x[3]) <= slot]
                want[s, slot] = before[-1][0] if before and slot - sec(before[-1][3]) <= 30 else -1
    assert got == want
    assert regular.missing_slots(series(readings.limit(0))).count() == 0


def test_series_interpolates_without_overshoot(spark):
    rows = [(i, "X", date(2024, 1, 1), at(t), y, y, 1, at(t)) for i, (t, y) in enumerate([(0, 1.0), (4, 2.0), (8, 2.0), (13, 5.0), (100, 9.0)])]
    readings = regular.last_copies(spark.createDataFrame(rows, READ), "reading_id", "recv_at", ["symbol", "session_date"], "ts", ["best_bid", "close", "volume"])
    got = sorted(regular.regular_series(readings, ["symbol", "session_date"], ["best_bid", "close", "volume"], ["best_bid"], ["volume"], 30, 6).collect(), key=lambda g: g.slot)
    first = got[0].slot
    y = [g.best_bid_smooth for g in got[:14]]
    assert len(got) == 101 and y[0] == 1.0 and y[4] == pytest.approx(2.0)
    assert all(a <= b + 1e-12 for a, b in zip(y[:13], y[1:14]) if b is not None)
    assert all(v == pytest.approx(2.0) for v in y[4:9])
    by = {g.slot - first: g for g in got}
    assert by[2].status == "filled" and by[2].best_bid == 1.0 and by[2].volume == 0
    assert by[43].status == "carried" and by[43].best_bid_smooth is None
    assert by[44].status == "gap" and by[44].best_bid is None and by[100].status == "read"


def test_versions_equal_brute_force(spark):
    r = random.Random(9)
    rows = []
    for e in (1, 2, 3):
        for d in range(0, 700, r.choice([1, 2])):
            if r.random() < 0.7:
                rows.append((e, date(2023, 6, 1) + timedelta(days=d), at(d), r.choice([None, 1, 1, 1, 2]), r.choice([None, 10.0, 10.0, 10.004, 10.01])))
    rows += [(e, d, t + timedelta(seconds=5), 3, None) for e, d, t, _, _ in rows[::40]] + rows[::30] + [(None, date(2024, 1, 1), at(0), 1, 1.0), (4, date(2024, 1, 1), at(0), None, None)]
    df = spark.createDataFrame(rows, "e long, d date, at timestamp, a long, b double")
    got = sorted((g.e, g.valid_from, g.valid_to) for g in history.versions(df, "e", "d", "at", {"a": F.col("a"), "b": history.cents(F.col("b"))}).collect())
    want = []
    for e in (1, 2, 3):
        last = {}
        for row in rows:
            key = (row[2], (row[3] is not None, row[3]), (row[4] is not None, row[4]))
            if row[0] == e and (row[1] not in last or key > last[row[1]][0]):
                last[row[1]] = key, row
        now, starts = (None, None), []
        for d in sorted(last):
            row = last[d][1]
            new = (row[3] if row[3] is not None else now[0], round(row[4] * 100) if row[4] is not None else now[1])
            if new != now:
                starts.append(d)
            now = new
        want += [(e, str(a), str(b)) for a, b in zip(starts, [*starts[1:], history.END])]
    assert got == sorted(want)
    assert history.versions(df.limit(0), "e", "d", "at", {"a": F.col("a")}).count() == 0


def test_late_corrections_equal_brute_force(spark):
    r = random.Random(10)
    rows = []
    for i in range(300):
        t = at(r.randrange(3 * 86_400))
        lag = r.choice([10, 5_000, 40_000, 100_000, 400_000])
        rows.append((i, t, t + timedelta(seconds=lag) if r.random() > 0.03 else None, r.choice(["evening", " Morning", "EXPIRED", None]), r.choice([1, 2, 3]), r.choice(["S", "T"]), r.choice([5, 9, None, 0])))
    rows += [(*x[:2], x[2] + timedelta(hours=9) if x[2] else None, *x[3:]) for x in rows[:40]]
    df = spark.createDataFrame(rows, "snapshot_id long, snapshot_time timestamp, arrived_at timestamp, snapshot_type string, instrument_id long, series string, open_interest int")
    got = {(g.series, g.day, g.snapshot_type): g.oi_total for g in late.corrected(df).collect()}
    once = {}
    for x in rows:
        if x[2] is not None and (x[0] not in once or x[2] < once[x[0]][2]):
            once[x[0]] = x
    periods = {}
    for x in once.values():
        kind = (x[3] or "").strip().lower()
        if kind in ("evening", "morning") and x[6] is not None:
            periods.setdefault((x[5], str(x[1].date()), kind), []).append(x)
    want = {}
    for k, pubs in periods.items():
        end = datetime.fromisoformat(k[1]) + timedelta(days=1)

        def total(limit):
            best = {}
            for x in pubs:
                if x[2] <= limit and (x[4] not in best or (x[1], x[0]) > best[x[4]][:2]):
                    best[x[4]] = (x[1], x[0], x[6])
            return sum(b[2] for b in best.values()) if best else None

        final, early = total(end + timedelta(hours=36)), total(end)
        if final is not None and final != early:
            want[k] = final
    assert got == want
    assert late.corrected(df.limit(0)).count() == 0
