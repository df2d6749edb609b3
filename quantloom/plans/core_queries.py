"""Queries of the data-upkeep operators (p1, p2, p3, p4, p6, p7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import changes, history, known, late, regular, trailing
from quantloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "order_feed").withColumn("side", F.upper("side"))
    return changes.current_state(feed, changes.order_feed(feed)).select("order_id", "side", "px", F.col("sz").cast("long").alias("sz"))


def p1_committed(spark: SparkSession, d: str) -> DataFrame:
    """How far each book is committed while its feed is still open, gaps being held for an hour."""
    feed = table(spark, d, "order_feed")
    marks = changes.watermarks(changes.latest_copies(feed, changes.order_feed(feed)), 2, 3600.0)
    return marks.select(F.col("t0").alias("symbol"), F.date_format("t1", "yyyy-MM-dd").alias("day"), "watermark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "options_5m").where("open_interest IS NOT NULL")
    return known.known_at(table(spark, d, "option_trades"), "print_id", "ts_event", rows, "instrument_id", "bucket_ts", "known_at", "obs_id")


def p2_attributes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "options_5m").where("open_interest IS NOT NULL")
    return known.known_at(
        table(spark, d, "option_trades"), "print_id", "ts_event", rows, "instrument_id", "bucket_ts", "known_at", "obs_id", ["open_interest", "is_morning_update", "daily_estimated_oi"]
    )


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return trailing.trailing_segments(trailing.run_ticks(table(spark, d, "trades")), "run_id", "day", "ticks", (7, 30))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = p3_segments(spark, d).where("total_7 < 0 AND total_30 > 0")
    return trailing.by_day(found).select("run_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p3_trailing(spark: SparkSession, d: str) -> DataFrame:
    days = trailing.by_day(p3_segments(spark, d))
    return days.select(
        "run_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.col(f"total_{n}").cast("double").alias(f"total_{n}") for n in (7, 30)], *[F.round(F.col(f"total_{n}").cast("double") / n, 6).alias(f"avg_{n}") for n in (7, 30)]
    )


def _readings(spark: SparkSession, d: str, values: list[str]) -> DataFrame:
    return regular.last_copies(table(spark, d, "mbo_full_book_1s"), "reading_id", "recv_at", ["symbol", "session_date"], "ts", values)


def _series(spark: SparkSession, d: str) -> DataFrame:
    values = ["best_bid", "close", "volume"]
    return regular.regular_series(_readings(spark, d, values), ["symbol", "session_date"], values, ["best_bid", "close"], ["volume"])


def p4_series(spark: SparkSession, d: str) -> DataFrame:
    smooth = {c: F.round(c, 6) for c in ("best_bid_smooth", "close_smooth")}
    return _series(spark, d).withColumns(smooth | {"session_date": F.date_format("session_date", "yyyy-MM-dd")}).withColumnRenamed("session_date", "day")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return regular.missing_slots(_series(spark, d)).select("symbol", "slot", "reading_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "options_5m_contracts")
    return history.versions(rows, "instrument_id", "session_date", "loaded_at", {"expiry": F.col("expiry"), "strike": history.cents(F.col("strike"))}).select("instrument_id", "valid_from", "valid_to")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return late.corrected(table(spark, d, "options_oi_snapshot"))


def p7_revisions(spark: SparkSession, d: str) -> DataFrame:
    return late.revisions(table(spark, d, "options_oi_snapshot")).withColumns({"arrival": F.col("arrival").cast("long"), "day": F.date_format("day", "yyyy-MM-dd")})


QUERIES = {f.__name__: f for f in (p1_found, p1_committed, p2_found, p2_attributes, p3_found, p3_trailing, p4_found, p4_series, p6_found, p7_found, p7_revisions)}

_P2 = """
WITH rows AS (SELECT * FROM options_5m WHERE open_interest IS NOT NULL AND known_at IS NOT NULL AND bucket_ts IS NOT NULL),
prints AS (SELECT DISTINCT print_id, instrument_id, ts_event FROM option_trades WHERE ts_event IS NOT NULL)
SELECT print_id, x.obs_id AS obs_id{more} FROM (
  SELECT p.print_id, max(struct_pack(b := r.bucket_ts, k := r.known_at, obs_id := r.obs_id, oi := r.open_interest, mu := r.is_morning_update, de := r.daily_estimated_oi)) AS x
  FROM prints p JOIN rows r ON p.instrument_id = r.instrument_id AND r.known_at <= p.ts_event
  GROUP BY p.print_id)
"""
_P3 = """
WITH last AS (
  SELECT run_id, strptime(substr(replace(date, '-', ''), 1, 8), '%Y%m%d')::DATE AS day, ticks,
         row_number() OVER (PARTITION BY trade_id ORDER BY saved_at DESC) AS n FROM trades
), daily AS (
  SELECT run_id, day, sum(ticks) AS x FROM last WHERE n = 1 AND day IS NOT NULL AND ticks IS NOT NULL AND ticks::VARCHAR <> 'nan' GROUP BY ALL
), spine AS (
  SELECT run_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY run_id
), totals AS (
  SELECT s.run_id, s.day,
         sum(coalesce(x, 0)) OVER (PARTITION BY s.run_id ORDER BY s.day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS total_7,
         sum(coalesce(x, 0)) OVER (PARTITION BY s.run_id ORDER BY s.day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS total_30
  FROM spine s LEFT JOIN daily d USING (run_id, day)
)
"""
def _p4_level(c: str) -> dict[str, str]:
    """SQL of one level's slopes, tangents and cubic."""
    inner = lambda d0, d1, h0, h1: f"CASE WHEN {d0} * {d1} > 0 THEN ((2 * {h1} + {h0}) + ({h1} + 2 * {h0})) / ((2 * {h1} + {h0}) / {d0} + ({h1} + 2 * {h0}) / {d1}) ELSE 0 END"

    def end(d0: str, d1: str, h0: str, h1: str) -> str:
        m = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
        return f"CASE WHEN sign({m}) <> sign({d0}) THEN 0 WHEN sign({d0}) <> sign({d1}) AND abs({m}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {m} END"

    d, dp, dn = f"d_{c}", f"dp_{c}", f"dn_{c}"
    return {
        "slopes": f"(p1_{c} - p2_{c}) / hp AS {dp}, (l_{c} - p1_{c}) / h AS {d}, (n1_{c} - l_{c}) / hn AS {dn}",
        "tangents": f"CASE WHEN hp IS NOT NULL THEN {inner(dp, d, 'hp', 'h')} WHEN hn IS NOT NULL THEN {end(d, dn, 'h', 'hn')} ELSE {d} END AS m0_{c}, CASE WHEN hn IS NOT NULL THEN {inner(d, dn, 'h', 'hn')} WHEN hp IS NOT NULL THEN {end(d, dp, 'h', 'hp')} ELSE {d} END AS m1_{c}",
        "cubic": f"CASE WHEN h IS NOT NULL THEN (2 * (u * u * u) - 3 * (u * u) + 1) * p1_{c} + ((u * u * u) - 2 * (u * u) + u) * h * m0_{c} + (3 * (u * u) - 2 * (u * u * u)) * l_{c} + ((u * u * u) - (u * u)) * h * m1_{c} WHEN slot * 1000000 = us AND hn IS NOT NULL THEN l_{c} END",
    }


_L = {c: _p4_level(c) for c in ("bid", "close")}
_P4_SERIES = f"""
WITH last AS (
  SELECT *, row_number() OVER (PARTITION BY reading_id ORDER BY recv_at DESC) AS n FROM mbo_full_book_1s
), r AS (
  SELECT symbol, session_date, epoch_us(ts) AS us, reading_id AS id, floor(epoch_us(ts) / 1000000)::BIGINT AS sec, best_bid AS l_bid, "close" AS l_close, volume,
         coalesce(best_bid::VARCHAR <> 'nan' AND "close"::VARCHAR <> 'nan' AND volume IS NOT NULL, false) AS usable
  FROM last WHERE n = 1 AND ts IS NOT NULL
), slots AS (
  SELECT symbol, session_date, unnest(generate_series(min(sec), max(sec))) AS slot FROM r GROUP BY symbol, session_date
), own AS (
  SELECT symbol, session_date, sec, arg_max(id, struct_pack(a := us, b := id)) AS id, arg_max(l_bid, struct_pack(a := us, b := id)) AS bid, arg_max(l_close, struct_pack(a := us, b := id)) AS c, sum(volume) AS volume
  FROM r WHERE usable GROUP BY symbol, session_date, sec
), near AS (
  SELECT *, lag(us) OVER w AS p1, lag(us, 2) OVER w AS p2, lead(us) OVER w AS n1, lag(l_bid) OVER w AS p1_bid, lag(l_bid, 2) OVER w AS p2_bid, lead(l_bid) OVER w AS n1_bid,
         lag(l_close) OVER w AS p1_close, lag(l_close, 2) OVER w AS p2_close, lead(l_close) OVER w AS n1_close
  FROM r WHERE usable WINDOW w AS (PARTITION BY symbol, session_date ORDER BY us, id)
), gaps AS (
  SELECT *, CASE WHEN us > p1 AND us - p1 <= 30000000 THEN (us - p1) / 1000000.0::DOUBLE END AS h, CASE WHEN p1 > p2 AND p1 - p2 <= 30000000 THEN (p1 - p2) / 1000000.0::DOUBLE END AS hp,
         CASE WHEN n1 > us AND n1 - us <= 30000000 THEN (n1 - us) / 1000000.0::DOUBLE END AS hn, row_number() OVER (PARTITION BY symbol, session_date, us ORDER BY id) AS one FROM near
), slopes AS (SELECT *, {_L["bid"]["slopes"]}, {_L["close"]["slopes"]} FROM gaps WHERE one = 1
), tangents AS (SELECT *, {_L["bid"]["tangents"]}, {_L["close"]["tangents"]} FROM slopes
), before AS (SELECT symbol, session_date, us, max(id) AS id, arg_max(l_bid, id) AS bid, arg_max(l_close, id) AS c FROM r WHERE usable GROUP BY symbol, session_date, us
), carried AS (
  SELECT s.symbol, s.session_date, s.slot, b.us AS b_us, b.id AS b_id, b.bid AS b_bid, b.c AS b_c FROM (SELECT *, slot * 1000000 AS t0 FROM slots) s
  ASOF LEFT JOIN before b ON s.symbol = b.symbol AND s.session_date = b.session_date AND s.t0 >= b.us
), placed AS (
  SELECT a.*, t.* EXCLUDE (symbol, session_date), CASE WHEN a.t0 = t.us THEN 1.0::DOUBLE ELSE (a.t0 - t.p1) / 1000000.0::DOUBLE / h END AS u FROM (SELECT *, slot * 1000000 AS t0 FROM carried) a
  ASOF LEFT JOIN tangents t ON a.symbol = t.symbol AND a.session_date = t.session_date AND a.t0 <= t.us
), cubic AS (SELECT *, {_L["bid"]["cubic"]} AS bid_smooth, {_L["close"]["cubic"]} AS close_smooth FROM placed)
SELECT p.symbol, strftime(p.session_date, '%Y-%m-%d') AS day, p.slot::BIGINT AS slot,
       CASE WHEN o.id IS NOT NULL THEN 'read' WHEN h IS NOT NULL THEN 'filled' WHEN p.t0 - b_us <= 30000000 THEN 'carried' ELSE 'gap' END AS status,
       coalesce(o.id, CASE WHEN p.t0 - b_us <= 30000000 THEN b_id END, -1)::BIGINT AS reading_id,
       coalesce(o.bid, CASE WHEN p.t0 - b_us <= 30000000 THEN b_bid END) AS best_bid, coalesce(o.c, CASE WHEN p.t0 - b_us <= 30000000 THEN b_c END) AS close,
       round(bid_smooth, 6) AS best_bid_smooth, round(close_smooth, 6) AS close_smooth, coalesce(o.volume, 0)::DOUBLE AS volume
FROM cubic p LEFT JOIN own o ON p.symbol = o.symbol AND p.session_date = o.session_date AND p.slot = o.sec
"""
_P7 = """
WITH once AS (
  SELECT *, min(arrived_at) OVER (PARTITION BY snapshot_id) AS arr, row_number() OVER (PARTITION BY snapshot_id ORDER BY arrived_at) AS n FROM options_oi_snapshot
), pubs AS (
  SELECT series, snapshot_time::DATE AS day, lower(trim(snapshot_type)) AS snapshot_type, instrument_id, snapshot_time, snapshot_id, open_interest AS oi, arr,
         (snapshot_time::DATE + 1)::TIMESTAMP AS midnight
  FROM once WHERE n = 1 AND open_interest IS NOT NULL AND lower(trim(snapshot_type)) IN ('evening', 'morning')
), ok AS (SELECT * FROM pubs WHERE arr::TIMESTAMP <= midnight + INTERVAL 36 HOUR
), final AS (
  SELECT series, day, snapshot_type, sum(oi) AS total FROM (
    SELECT series, day, snapshot_type, arg_max(oi, struct_pack(a := snapshot_time, b := snapshot_id)) AS oi FROM ok GROUP BY series, day, snapshot_type, instrument_id) GROUP BY ALL
), early AS (
  SELECT series, day, snapshot_type, sum(oi) AS total FROM (
    SELECT series, day, snapshot_type, arg_max(oi, struct_pack(a := snapshot_time, b := snapshot_id)) AS oi FROM ok WHERE arr::TIMESTAMP <= midnight GROUP BY series, day, snapshot_type, instrument_id) GROUP BY ALL
)
SELECT series, strftime(day, '%Y-%m-%d') AS day, snapshot_type, f.total::BIGINT AS oi_total
FROM final f LEFT JOIN early e USING (series, day, snapshot_type) WHERE e.total IS NULL OR e.total <> f.total
"""

SQL = {
    "p1_found": """
WITH last AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, session_date, seq ORDER BY ts_recv DESC) AS n FROM order_feed
), f AS (SELECT * FROM last WHERE n = 1
), r AS (SELECT symbol, session_date, max(seq) AS reset_seq FROM f WHERE action = 'R' GROUP BY ALL
), s AS (
  SELECT symbol, session_date, order_id, max(seq) AS set_seq, arg_max(upper(side), seq) AS side, arg_max(px, seq) AS px, arg_max(sz, seq) AS sz
  FROM f WHERE action IN ('A', 'M') GROUP BY ALL
), t AS (
  SELECT s.symbol, s.session_date, s.order_id, sum(f.sz) AS taken
  FROM s JOIN f USING (symbol, session_date, order_id) WHERE f.action IN ('C', 'F') AND f.seq > s.set_seq GROUP BY ALL
)
SELECT s.order_id, s.side, s.px, (s.sz - coalesce(t.taken, 0))::BIGINT AS sz
FROM s LEFT JOIN t USING (symbol, session_date, order_id) LEFT JOIN r USING (symbol, session_date)
WHERE s.sz > coalesce(t.taken, 0) AND (r.reset_seq IS NULL OR s.set_seq > r.reset_seq)
""",
    "p1_committed": """
WITH last AS (
  SELECT symbol, session_date, seq, ts_recv, row_number() OVER (PARTITION BY symbol, session_date, seq ORDER BY ts_recv DESC) AS n FROM order_feed
), f AS (
  SELECT *, lag(seq) OVER (PARTITION BY symbol, session_date ORDER BY seq) AS prev, max(ts_recv) OVER (PARTITION BY symbol, session_date) AS clock FROM last WHERE n = 1
)
SELECT symbol, strftime(session_date, '%Y-%m-%d') AS day, coalesce(min(CASE WHEN seq - prev > 1 AND clock - ts_recv < INTERVAL 1 HOUR THEN prev END), max(seq))::BIGINT AS watermark
FROM f GROUP BY symbol, session_date
""",
    "p2_found": _P2.replace("{more}", ""),
    "p2_attributes": _P2.replace("{more}", ", x.oi AS open_interest, x.mu AS is_morning_update, x.de AS daily_estimated_oi"),
    "p3_found": _P3 + "SELECT run_id, strftime(day, '%Y-%m-%d') AS day FROM totals WHERE total_7 < 0 AND total_30 > 0",
    "p3_trailing": _P3 + "SELECT run_id, strftime(day, '%Y-%m-%d') AS day, total_7, total_30, round(total_7 / 7, 6) AS avg_7, round(total_30 / 30, 6) AS avg_30 FROM totals",
    "p4_found": """
WITH last AS (
  SELECT *, row_number() OVER (PARTITION BY reading_id ORDER BY recv_at DESC) AS n FROM mbo_full_book_1s
), r AS (
  SELECT symbol, session_date, ts::TIMESTAMP AS ts, reading_id, floor(epoch_us(ts) / 1000000)::BIGINT AS sec,
         coalesce(best_bid::VARCHAR <> 'nan' AND "close"::VARCHAR <> 'nan' AND volume IS NOT NULL, false) AS usable
  FROM last WHERE n = 1 AND ts IS NOT NULL
), slots AS (
  SELECT symbol, session_date, unnest(generate_series(lo, hi)) AS slot
  FROM (SELECT symbol, session_date, min(sec) AS lo, max(sec) AS hi FROM r GROUP BY ALL)
), missing AS (
  SELECT * FROM slots s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.usable AND r.symbol = s.symbol AND r.session_date = s.session_date AND r.sec = s.slot)
)
SELECT m.symbol, m.slot::BIGINT AS slot, (CASE WHEN m.slot * 1000000 - epoch_us(u.ts) <= 30000000 THEN u.reading_id ELSE -1 END)::BIGINT AS reading_id
FROM (SELECT *, make_timestamp(slot * 1000000) AS at FROM missing) m
ASOF LEFT JOIN (SELECT * FROM r WHERE usable) u ON m.symbol = u.symbol AND m.session_date = u.session_date AND m.at >= u.ts
""",
    "p4_series": _P4_SERIES,
    "p6_found": """
WITH last AS (
  SELECT *, row_number() OVER (PARTITION BY instrument_id, session_date ORDER BY loaded_at DESC) AS n FROM options_5m_contracts
), f AS (
  SELECT instrument_id, session_date,
         last_value(expiry IGNORE NULLS) OVER w AS expiry, last_value(round(strike * 100) IGNORE NULLS) OVER w AS strike
  FROM last WHERE n = 1 WINDOW w AS (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), c AS (
  SELECT *, lag(expiry) OVER w AS e0, lag(strike) OVER w AS s0, row_number() OVER w AS n
  FROM f WHERE expiry IS NOT NULL OR strike IS NOT NULL WINDOW w AS (PARTITION BY instrument_id ORDER BY session_date)
), v AS (SELECT * FROM c WHERE n = 1 OR e0 IS DISTINCT FROM expiry OR s0 IS DISTINCT FROM strike)
SELECT instrument_id, strftime(session_date, '%Y-%m-%d') AS valid_from,
       coalesce(strftime(lead(session_date) OVER (PARTITION BY instrument_id ORDER BY session_date), '%Y-%m-%d'), '9999-12-31') AS valid_to
FROM v
""",
    "p7_found": _P7,
    "p7_revisions": _P7.split("), final AS (")[0] + """), hours AS (
  SELECT *, CASE WHEN arr::TIMESTAMP <= midnight THEN 0 ELSE ceil((epoch_us(arr) - epoch_us(midnight)) / 3600000000.0) END::BIGINT AS arrival FROM ok
), cells AS (SELECT series, day, snapshot_type, arrival, count(*) AS n FROM hours GROUP BY ALL
), held AS (
  SELECT c.series, c.day, c.snapshot_type, c.arrival, arg_max(h.oi, struct_pack(a := h.snapshot_time, b := h.snapshot_id)) AS oi
  FROM cells c JOIN hours h ON c.series IS NOT DISTINCT FROM h.series AND c.day = h.day AND c.snapshot_type = h.snapshot_type AND h.arrival <= c.arrival GROUP BY c.series, c.day, c.snapshot_type, c.arrival, h.instrument_id
), totals AS (SELECT series, day, snapshot_type, arrival, sum(oi) AS total FROM held GROUP BY ALL)
SELECT t.series, strftime(t.day, '%Y-%m-%d') AS day, t.snapshot_type, t.arrival, t.total::BIGINT AS oi_total, (sum(c.n) OVER (PARTITION BY t.series, t.day, t.snapshot_type ORDER BY t.arrival))::BIGINT AS publications
FROM totals t JOIN cells c ON t.series IS NOT DISTINCT FROM c.series AND t.day = c.day AND t.snapshot_type = c.snapshot_type AND t.arrival = c.arrival
""",
}
