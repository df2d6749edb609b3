"""The subpackage against brute force, other encoders, exact plans and hand-made texts."""

import base64
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import encode, mix, nearest, residue

PATH = f"{encode.TOKENIZERS}/{encode.VOCABULARY}"
T0 = datetime(2024, 1, 1)
LEFT = "record_id long, k string, t timestamp, saved timestamp"
RIGHT = "match_id long, k string, t timestamp, x int, is_left string"


def sides(spark, left, right):
    return [
        nearest.left_side(spark.createDataFrame(left, LEFT), "record_id", "k", "t", "saved"),
        nearest.right_side(spark.createDataFrame(right, RIGHT), "match_id", "k", "t", F.col("x").isNotNull()),
    ]


def test_nearest_equals_brute_force(spark):
    r = random.Random(1)
    at = lambda: T0 + timedelta(seconds=r.randrange(40_000), microseconds=r.choice([0, 1]))
    left = [(i, r.choice(["HOT", "HOT", "b", None]), at() if r.random() > 0.05 else None, T0) for i in range(300)]
    left += [(*x[:2], at() if r.random() > 0.3 else None, T0 + timedelta(hours=1)) for x in left[:60]] + left[100:120]
    right = [(10_000 + i, r.choice(["HOT", "b", None]), at() if r.random() > 0.02 else None, r.choice([1, None, 2]), "clash") for i in range(500)]
    right += right[:20]
    r.shuffle(left)
    r.shuffle(right)
    report = {}
    got = {x.record_id: x.match_id for x in nearest.match_bounded(spark, sides(spark, left, right), 90, 3600, least_slices=10, buckets=100_000, report=report).collect()}
    cells = {(x[1], (x[2] - T0) // timedelta(hours=1)) for x in left + right if x[1] and x[2]}
    assert report["batches"] == 12 and 0 < report["most_held"] < len(cells) * 2 // 3
    last = {}
    for x in left:
        if x[0] not in last or x[3] > last[x[0]][3]:
            last[x[0]] = x
    want = {}
    for i, k, t, _ in last.values():
        ok = [(abs(c[2] - t), c[2], c[0]) for c in right if k is not None and t is not None and c[1] == k and c[2] is not None and c[3] is not None and abs(c[2] - t) <= timedelta(seconds=90)]
        if ok:
            want[i] = min(ok)[2]
    assert got == want


def test_nearest_of_nothing(spark):
    assert nearest.match_bounded(spark, sides(spark, [], []), 90).count() == 0


def test_nearest_ties_take_the_earlier():
    left = np.array([(5, 5, 100, 1, 0), (5, 6, 100, 2, 0)], nearest.LEFT)
    right = np.array([(5, 5, 90, 8), (5, 5, 90, 9), (5, 5, 110, 7), (5, 7, 100, 6)], nearest.RIGHT)
    assert nearest.nearest(left, right, 10).tolist() == [8, -1]
    assert nearest.nearest(left, right, 9).tolist() == [-1, -1]
    assert nearest.nearest(left, right[:0], 9).tolist() == [-1, -1]


def texts():
    r = random.Random(2)
    odd = [chr(c) for c in (*range(1, 0x250), 0x3000, 0x2028, 0x1F680, 0x4F60, 0x627, 0x200B, 0xFEFF, 0x0E01)]
    out = ["", " ", "Don't we'll", "  two  spaces \n\n x", "<|endoftext|>", "a" * 5000, "1234567 8.50", "\r\n\t mixed\x85ends\x1c"]
    return out + ["".join(r.choice([*odd, " ", "e", "'s", "\n"]) for _ in range(r.randrange(60))) for _ in range(400)]


def test_encoding_equals_other_encoders_and_round_trips():
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    import public_tokenizers

    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    third = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    third.encode_special_tokens = True
    e = encode.encoder(PATH)
    for t in texts():
        ids = e.encode([t])[0]
        assert ids == other.encode_ordinary(t) == third.encode(t, add_special_tokens=False).ids
        assert e.decode(ids) == t


def test_encode_rows(spark):
    rows = [(1, None, "z"), (2, "", "z"), (3, "Hello world", "z"), (3, "Hello world", "z"), (4, "x " * 20_000, "z"), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode.encode(df, most=1000)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    by = {r.doc_id: r.ids for r in got.collect()}
    assert got.count() == 6 and by[1] == by[2] == [] and by[3] == [15496, 995] and len(by[4]) == 20_001
    assert {r.doc_id: r.text for r in encode.decode(got).collect()}[3] == "Hello world"
    assert encode.encode(df.limit(0)).count() == 0
    assert sorted(r.n_tokens for r in encode.token_counts(df, ["doc_id"]).collect()) == [0, 0, 1, 2, 2, 20_001]


def test_plan_fills_and_caps():
    stats = [("a", 0.5, 1, 10, 1000), ("b", 0.3, 4, 5, 50), ("c", 0.2, 3, 0, 0)]
    full = {s.source: s.need for s in mix.plan(stats)}
    assert full == {"a": pytest.approx(850), "b": 200.0, "c": 0.0}
    exact = {s.source: s.need for s in mix.plan(stats, "exact")}
    assert exact["b"] == pytest.approx(200) and exact["a"] == pytest.approx(200 * 5 / 3)
    assert mix.plan([("a", 0.5, 1, 0, 0)])[0].need == 0.0
    over = {s.source: s.need for s in mix.plan(stats, 10_000)}
    assert over == {"a": 1000.0, "b": 200.0, "c": 0.0}


def test_curriculum_weights_add_to_one():
    shares = mix.plan([("a", 0.5, 9, 10, 1000), ("b", 0.3, 9, 5, 50), ("c", 0.2, 9, 5, 500)], "exact")
    knots = mix.curriculum(shares)
    need = {s.source: s.need for s in shares}
    for t in (0.0, 0.3, 1.0):
        assert sum(need[k] * (a[1] + (b[1] - a[1]) * t) for k, (a, b) in knots.items()) == pytest.approx(sum(need.values()))


def documents(spark):
    r = random.Random(3)
    names = ["Desk Notes", "desk-notes", "wiki", "small", None, "other"]
    rows = [(i, "word " * r.randrange(1, 60), r.choice(names), 1) for i in range(400)] + [(900, None, "wiki", 1), (901, "", "wiki", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position int")
    goal = spark.createDataFrame([("desk_notes", 0.5, 1), ("wiki", 0.2, 3), ("SMALL", 0.3, 2), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    return docs, goal


def test_mix_reaches_shares_and_caps(spark):
    docs, goal = documents(spark)
    m = mix.prepare(docs, goal)
    placed = mix.positions(m)
    rows = placed.collect()
    pos = [r.position for r in rows]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    most = {"desk_notes": 1, "wiki": 3, "small": 2}
    assert all(n <= most[s] for (s, _), n in Counter((r.source, r.doc_id) for r in rows).items())
    need = {s.source: s.need for s in m.shares}
    got = Counter()
    for r in rows:
        got[r.source] += r.n_tokens
    assert all(abs(got[s] - n) <= 60 for s, n in need.items())
    rep = {r.source: r for r in mix.report(m, placed).collect()}
    assert rep["absent"].actual_share == 0 and sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    half = [r for r in rows if r.position < 0.5]
    schedule = mix.curriculum(m.shares)
    for s, n in need.items():
        if n:
            (_, w0), (_, w1) = schedule[s]
            early = (w0 + (w0 + w1) / 2) / 4 / ((w0 + w1) / 2)
            assert sum(r.n_tokens for r in half if r.source == s) == pytest.approx(early * n, abs=0.03 * n + 60)


def test_exact_mix_meets_every_share_within_half_a_document(spark):
    docs, goal = documents(spark)
    m = mix.prepare(docs, goal, "exact")
    rep = mix.report(m, mix.positions(m)).collect()
    able = {s.source: s.target for s in m.shares if s.tokens}
    whole = sum(r.mixed_tokens for r in rep)
    longest = m.sized.agg(F.max("n_tokens")).first()[0]
    assert {r.source for r in rep if r.copies} == set(able)
    for r in rep:
        assert abs(r.mixed_tokens - whole * able.get(r.source, 0) / sum(able.values())) <= longest / 2 * (1 + len(able))


def test_mix_is_the_same_for_any_bucket_size(spark, monkeypatch):
    docs, goal = documents(spark)
    m = mix.prepare(docs, goal, 3000)
    a = mix.positions(m).collect()
    monkeypatch.setattr(mix, "BUCKET_DOCS", 7)
    assert mix.positions(m).collect() == a
    assert mix.positions(mix.prepare(docs.limit(0), goal)).count() == 0


def test_inverse_of_many_knots(spark):
    knots = [(0.0, 1.0), (0.25, 3.0), (0.6, 0.2), (1.0, 0.2)]
    seg = mix._segments(knots)
    df = spark.createDataFrame([(i / 40, [tuple(s.values()) for s in seg]) for i in range(41)], "u double, s array<struct<t0:double,h:double,w0:double,k:double,c0:double>>")

    def integral(t):
        return sum(s["w0"] * x + s["k"] * x * x / 2 for s in seg for x in [min(max(t - s["t0"], 0), s["h"])])

    for r in df.select("u", mix._position(F.col("u"), F.col("s")).alias("t")).collect():
        assert integral(r.t) == pytest.approx(r.u, abs=1e-9)


GOOD = ["The front contract stalled below the prior high. Net result for AXN: 3 winners, 4 losers.", "Monte Carlo with 50 paths puts the median drawdown at 90 ticks. Kelly gives 4.", "Use `{{symbol}}` in the alert text; the sender fills it in.", "Search for \"lorem ipsum dolor sit amet\" before you publish, somebody left it there.", "The vendor answered 'Error 500: internal server error' twice and went on. All 40 files came.", "```\nprint(f\"{symbol}\")\n``` is all the script does.", "Write the comment as [reason], for instance [stop], then add the 5 ticks.", "A missing file shows up as 404 in the log, which only means that AXN did not trade. The long leg held. The stop held. The bid held. The offer held. The roll held."]
BAD = {
    "residue": ["Prepared by {{author}}, {{day}}.", "Prepared by [AUTHOR_NAME], <<day>>.", "Monte Carlo with [N_TRADES] paths puts the median drawdown at 9 ticks.", "Hello ________, the ________ report is ready.", "Monte Carlo with :paths: paths puts the median drawdown at 7 ticks."],
    "filler": ["Notes on AXN\nMetus dolor nullam vitae amet pretium ipsum. Justo nullam ipsum massa.", "blah blah blah blah blah", "The stop held.\n\nAdd a short description of your report here.", "Texto de relleno texto de relleno."],
    "notice": ["<html><body><h1>404 - the page you requested could not be found.</h1></body></html>", "Home | Charts | Help\nPlease enable JavaScript to view this chart.", "Zugriff verweigert. Kennung 9fd08beddd5a"],
}


def test_residue_cases(spark):
    rows = [(i, t, "c") for i, t in enumerate(GOOD * 2)]
    want = {}
    for reason, ts in BAD.items():
        for t in ts:
            rows.append((len(rows), t, "c"))
            want[len(rows) - 1] = reason
    rows += [(1000, None, "c"), (1001, "", "c"), (1002, " \n ", "c"), (None, BAD["filler"][1], "c")]
    rows += rows[:3] + [rows[16]]
    df = spark.createDataFrame(rows, "doc_id long, text string, skeleton string")
    got = {r.doc_id: r.reason for r in residue.residue(df).collect()}
    assert got == want
    assert residue.residue(df.limit(0)).count() == 0


def test_constant_words_are_no_slot(spark):
    rows = [(i, f"Mark the exit as {{open}} until the {i} trade is done.") for i in range(8)] + [(100, "Mark the book as {symbol} until then."), (101, "Mark the book as {ticks} until then.")]
    got = {r.doc_id for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {100, 101}


def test_repeated_residue_stays_residue(spark):
    rows = [(i, f"Prepared by {{{{author}}}}. Note {i} on the roll held at {i} ticks.") for i in range(12)] + [(20 + i, "Our desk closes at ${closing_hour}.") for i in range(7)]
    good = ["Prepared by John Smith. The roll held.", "Mark the exit as {open} until the 3 trade is done.", "The variable {{symbol}} is set by the sender.", "Notez la sortie comme {ouvert} ou {clos}."]
    rows += [(100 + i, t) for i, t in enumerate(good)]
    got = {r.doc_id for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {*range(12), *range(20, 27)}


LONG_PAGE = "Service unavailable\nError 503: the server is under maintenance.\nThe chart host did not answer within 30 seconds.\nPlease reload the page.\nCheck your network connection.\nClear your browser cache.\nRequest id 7f3a9c0{}b1\nContact support if this goes on."
TRACE_PAGE = 'Traceback (most recent call last):\n  File "/srv/app/run.py", line 41, in main\n    out = load(path)\n  File "/srv/app/io.py", line 7, in load\n    return read(path)\n  File "/srv/app/io.py", line 19, in read\n    raise KeyError(name)\nKeyError: symbol'


def test_long_pages(spark):
    short = "Error 503: the server is under maintenance.\nPlease reload the page."
    report = "The vendor had an outage on day {}. The feed answered error 503 for an hour. The long leg held at {}. The stop was moved once. The offer stood at {}. The roll went as planned. Nobody had to reload the chart."
    rows = [(1, LONG_PAGE.format(1)), (2, TRACE_PAGE), (3, short)] + [(10 + i, LONG_PAGE.format(i) + "\nThe status board is on the left.") for i in range(6)] + [(100 + i, report.format(i, i, i)) for i in range(8)]
    rows += [(200, LONG_PAGE.format(5) + "\nThe desk sold the spread and closed the day flat.")]
    got = {r.doc_id for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1, 2, 3, *range(10, 16)}


def test_filler_behind_a_lead():
    lead = "A summary of the week for the desk with the positions that were held over the roll and the reasons for each of them"
    for u in [f"{lead}: Enter your text here", f"{lead} - add a short description of your report here", f"{lead} (Insert your text here)", "Market overview: Lorem ipsum dolor sit amet, consectetur adipiscing elit", "Market overview for the week Lorem ipsum dolor sit amet.", "Overview of AXN - lorem ipsum dolor sit amet, then 4 trades."]:
        assert residue.is_filler(u), u
    for u in [f"{lead}: the long leg held here", "Somebody left lorem ipsum dolor sit amet in the draft that went out.", "The desk may add a stop here.", "In the sample the stop was hit 4 times: see the text for an example."]:
        assert not residue.is_filler(u), u


def test_notice_stems():
    for u in ["404 - gone", "HTTP status 502", "JS is required", "Skripte sind ausgeschaltet", "session a expiré", "Nothing here", "Access denied", "cannot read x on line 3", "You need to sign in again to read"]:
        assert residue.says_notice(u) and residue.NOTICE.search(u)


def test_very_long_text(spark):
    t = "The stop held at 5. " * 20_000 + "Filled {{price}} at {{time}}, stop {{sl}}."
    assert residue.residue(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().reason == "residue"


LETTERS = [f"Dear {n}, your order of the {x} is ready for collection at our shop." for n in ("Anna", "Bob Hart", "Chidi", "Dolores", "Emre") for x in ("garden chair", "lamp", "oak table", "rug", "blue kettle", "shelf", "mirror", "door mat")]


def test_slots_are_induced_from_what_varies(spark):
    left = ["Dear FIRST NAME, your order of the lamp is ready for collection at our shop.", "Dear CUSTOMER NAME, your order of the PRODUCT NAME is ready for collection at our shop.", "Dear customer_name, your order of the rug is ready for collection at our shop.", "Dear , your order of the  is ready for collection at our shop.", "Dear [Name], your order of the lamp is ready for collection at our shop.", "Dear Anna, your order of the undefined is ready for collection at our shop."]
    good = ["The FIRST NAME on the list was Anna, and the rug went to the shop.", "The parameter max_depth is set once.", "Dear all, the shop is closed on Monday .", "The ORDER BOOK of the day was thin.", "Our lamp is ready for collection at our shop ."]
    rows = [(i, t) for i, t in enumerate(LETTERS)] + [(100 + i, t) for i, t in enumerate(left)] + [(200 + i, t) for i, t in enumerate(good)]
    got = {r.doc_id for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {100 + i for i in range(len(left))}


def test_names_count_only_where_others_hold_values(spark):
    rows = [(i, f"The parameter customer_name is set in block {i} of the export sheet.") for i in range(9)] + [(50, "Dear FIRST NAME, your order of the lamp is ready."), (51, "Dear Anna, your order of the lamp is ready."), (52, "Dear Bob, your order of the rug is ready.")]
    assert residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_forms_of_any_length(spark):
    path = "customer.address." + "inner." * 12 + "name"
    rows = [(1, f"Prepared by {{{{{path}}}}} today."), (2, "Name: " + "_" * 40 + " of the desk"), (3, "The stop held.\n" + "_" * 90 + "\nThe bid held."), (4, "A summary of the week, the positions held over the roll, and the reasons for each one: Insert your report on the whole of the last quarter here and keep it as short as you can so that all can read it in the morning")]
    got = {r.doc_id: r.reason for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "residue", 2: "residue", 4: "filler"}


def test_residue_of_templates_never_seen(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(r.choice([2, 3, 3, 4]))) for _ in range(1500)]
    w = lambda n: [r.choice(vocab) for _ in range(n)]
    left = [lambda n: n, lambda n: n.upper().replace("_", " "), lambda n: "", lambda n: f"[{n.split('_')[0].title()}]", lambda n: "undefined", lambda n: "{{" + n + "}}", lambda n: "____"]
    rows, want = [], set()
    for _ in range(15):
        a, b, c = (w(r.choice([3, 4, 5])) for _ in range(3))
        names = ["_".join(w(2)) for _ in range(2)]
        record = lambda fill: " ".join(" ".join(w(9)).capitalize() + "." for _ in range(3)) + f" {' '.join(a).capitalize()} {fill[0]} {' '.join(b)} {fill[1]} {' '.join(c)}."  # noqa: E731, B023
        rows += [(len(rows) + i, record([" ".join(w(r.choice([1, 1, 2, 3]))) for _ in range(2)])) for i in range(25)]
        for f in left:
            fill, slot = [" ".join(w(r.choice([1, 2]))) for _ in range(2)], r.randrange(2)
            fill[slot] = f(names[slot])
            want.add(len(rows))
            rows.append((len(rows), record(fill)))
    assert {x.doc_id for x in residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_gaps_of_a_batch_are_those_of_each_form():
    import pyarrow as pa

    forms = ["dear anna, your order of the garden chair is ready", "the \x00 stop held, so \x00 lots went", "one", "", "a b c d e f g h", "is it (not) so: x.y; no!"]
    want = set()
    for f in forms:
        tokens = residue.TOKENS.findall(f)
        for i in range(len(tokens)):
            for j in range(i + 1, min(i + residue.WIDTH, len(tokens)) + 1):
                inner = tokens[i:j]
                gap = residue._gap(residue._left(tokens, i), residue._right(tokens, j))
                if gap is not None and not any(t in residue.MARKS or residue.SLOT in t for t in inner):
                    want.add((gap, residue._digest(" ".join(inner))))
    assert residue._stands(pa.array([*forms, None]), np.full(residue.BITMAP // 8, 255, np.uint8)) == want and len(want) > 40
    assert residue._stands(pa.array(forms), np.zeros(residue.BITMAP // 8, np.uint8)) == set()
