"""Queries of bars, books, joins, metrics, rules, regimes and simulation, with their SQL.

Every query runs over its whole tables. Times come out as epoch seconds and
days as text, so that both engines agree on types.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.calendar import in_window, minute_of_day, trade_date
from quantloom.functions.market import fine
from quantloom.operators import bars, book, changes, combine, folds, indicators, joins, options, patterns, profile, regimes, report, rules, simulate
from quantloom.plans import core_queries
from quantloom.session import kept, table

RTH = (870, 1260)  # 14:30 to 21:00 UTC, regular hours of the winter sessions
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _sec(c: Column | str) -> Column:
    return F.unix_seconds(c)


def _bars(spark: SparkSession, d: str) -> DataFrame:
    b = bars.clean_bars(table(spark, d, "candles_1m"))
    return b.withColumns({"day": trade_date(F.col("minute"), 22), "rth": in_window(F.col("minute"), *RTH, closed=False)})


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return report.latest_trades(table(spark, d, "trades"))


B = """
bars AS (
  SELECT *, (minute + INTERVAL 2 HOUR)::DATE AS day, (hour(minute) * 60 + minute(minute)) BETWEEN 870 AND 1259 AS rth FROM (
    SELECT symbol, date_trunc('minute', ts::TIMESTAMP + INTERVAL 30 SECOND) AS minute, open, high, low, "close", volume,
           row_number() OVER (PARTITION BY symbol, date_trunc('minute', ts::TIMESTAMP + INTERVAL 30 SECOND) ORDER BY candle_id) AS n
    FROM candles_1m WHERE ts IS NOT NULL AND "close" IS NOT NULL AND "close"::VARCHAR <> 'nan') WHERE n = 1)
"""
T = """
tr AS (
  SELECT *, strptime(substr(replace(date, '-', ''), 1, 8), '%Y%m%d')::DATE AS day FROM (
    SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY saved_at DESC) AS n FROM trades)
  WHERE n = 1 AND date IS NOT NULL AND ticks IS NOT NULL AND ticks::VARCHAR <> 'nan')
"""


@query(f"""WITH {B} SELECT symbol, epoch(time_bucket(INTERVAL 15 MINUTE, minute))::BIGINT AS bucket, arg_min(open, minute) AS open, max(high) AS high, min(low) AS low,
arg_max("close", minute) AS close, sum(volume)::BIGINT AS volume FROM bars GROUP BY ALL""")
def bars_ohlcv(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d)
    bucket = F.window("minute", "15 minutes")["start"]
    g = b.groupBy("symbol", bucket.alias("bucket")).agg(F.min_by("open", "minute").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "minute").alias("close"), F.sum("volume").alias("volume"))
    return g.withColumn("bucket", _sec("bucket"))


@query("""WITH e AS (SELECT symbol, session_date, seq, action, side, px, sz, ts, row_number() OVER (PARTITION BY symbol, session_date, seq ORDER BY ts_recv DESC) AS n FROM order_feed)
SELECT symbol, strftime(session_date, '%Y-%m-%d') AS day, epoch(date_trunc('minute', ts::TIMESTAMP))::BIGINT AS minute, px / 1e9 AS price,
sum(CASE WHEN upper(side) = 'B' THEN sz ELSE 0 END)::BIGINT AS buy, sum(CASE WHEN upper(side) = 'A' THEN sz ELSE 0 END)::BIGINT AS sell
FROM e WHERE n = 1 AND action = 'T' GROUP BY ALL""")
def volume_at_price(spark: SparkSession, d: str) -> DataFrame:
    t = _changes(spark, d).where("action = 'T'").select("symbol", _day("session_date").alias("day"), _sec(F.date_trunc("minute", "ts")).alias("minute"), (F.col("px") / 1e9).alias("price"), "sz", "side")
    return bars.volume_at_price(t, ["symbol", "day", "minute"], "price", "sz", "side")


@query("""WITH e AS (SELECT symbol, session_date, seq, action, side, px, sz, ts, row_number() OVER (PARTITION BY symbol, session_date, seq ORDER BY ts_recv DESC) AS n FROM order_feed),
t AS (SELECT *, date_trunc('minute', ts::TIMESTAMP) AS m FROM e WHERE n = 1 AND action = 'T')
SELECT symbol, strftime(session_date, '%Y-%m-%d') AS day, epoch(m)::BIGINT AS minute, arg_min(px, seq) / 1e9 AS open, max(px) / 1e9 AS high, min(px) / 1e9 AS low, arg_max(px, seq) / 1e9 AS close, sum(sz)::BIGINT AS volume,
sum(CASE WHEN upper(side) = 'B' THEN sz ELSE 0 END)::BIGINT AS buy_volume, sum(CASE WHEN upper(side) = 'A' THEN sz ELSE 0 END)::BIGINT AS sell_volume FROM t GROUP BY symbol, session_date, m""")
def tape_bars(spark: SparkSession, d: str) -> DataFrame:
    t = _changes(spark, d).where("action = 'T'").withColumn("price", F.col("px") / 1e9)
    g = bars.bars(t, ["symbol", "session_date"], F.date_trunc("minute", "ts"), "price", "sz", ["seq"], "side")
    return g.select("symbol", _day("session_date").alias("day"), _sec("bucket").alias("minute"), "open", "high", "low", "close", "volume", "buy_volume", "sell_volume")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "order_feed")
    spec = changes.Feed(["symbol", "session_date"], "order_id", "seq", "ts_recv", F.lit(0), "sz", ["side", "px", "action", "ts"])
    return changes.latest_copies(feed, spec).select(F.col("t0").alias("symbol"), F.col("t1").alias("session_date"), "seq", F.col("p3").alias("ts"), F.col("p2").alias("action"), F.col("p0").alias("side"), F.col("p1").alias("px"), F.col("amount").alias("sz"), F.col("key").alias("order_id"))


@query("""WITH v AS (SELECT underlying, snapshot_time::DATE AS day, series, count(*) AS v FROM options_oi_snapshot GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY underlying, day ORDER BY v DESC, series) AS n FROM v)
SELECT underlying, strftime(day, '%Y-%m-%d') AS day, max(CASE WHEN n = 1 THEN series END) AS front, max(CASE WHEN n = 1 THEN v END)::BIGINT AS front_volume,
coalesce(max(CASE WHEN n = 2 THEN v END), 0)::BIGINT AS second_volume, coalesce(max(CASE WHEN n = 2 THEN v END), 0) > 0.2 * max(CASE WHEN n = 1 THEN v END) AS is_roll_day FROM r WHERE n <= 2 GROUP BY underlying, day""")
def front_and_roll(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "options_oi_snapshot").select("underlying", F.to_date("snapshot_time").alias("day"), "series", F.lit(1).alias("one"))
    return bars.front_and_roll(t, ["underlying", "day"], "series", "one").withColumn("day", _day("day"))


@query(f"""WITH {B}, s AS (SELECT symbol, day, unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS minute FROM (SELECT symbol, day, min(minute) AS lo, max(minute) AS hi FROM bars GROUP BY ALL)),
f AS (SELECT s.symbol, s.day, s.minute, b.open, b.high, b.low, b.volume, b."close" IS NULL AS filled,
last_value(b."close" IGNORE NULLS) OVER (PARTITION BY s.symbol, s.day ORDER BY s.minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
FROM s LEFT JOIN bars b USING (symbol, day, minute))
SELECT symbol, epoch(minute)::BIGINT AS minute, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, c AS close, coalesce(volume, 0)::BIGINT AS volume, filled FROM f""")
def spine_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    g = bars.dense_bars(_bars(spark, d).drop("rth"), ["symbol", "day"])
    return g.select("symbol", _sec("minute").alias("minute"), "open", "high", "low", "close", "volume", "filled")


@query(f"""WITH {B}, x AS (SELECT *, (high + low + "close") / 3 AS p FROM bars), c AS (
SELECT symbol, minute, rth, sum(volume) OVER w AS v, sum(p * volume) OVER w AS pv, sum(p * p * volume) OVER w AS ppv,
sum(CASE WHEN rth THEN volume ELSE 0 END) OVER w AS rv, sum(CASE WHEN rth THEN p * volume ELSE 0 END) OVER w AS rpv
FROM x WINDOW w AS (PARTITION BY symbol, day ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, epoch(minute)::BIGINT AS minute, round(pv / nullif(v, 0), 4) AS vwap, round(sqrt(greatest(ppv / nullif(v, 0) - (pv / nullif(v, 0)) * (pv / nullif(v, 0)), 0)), 2) AS vwap_sd,
CASE WHEN rth THEN round(rpv / nullif(rv, 0), 4) END AS rth_vwap FROM c""")
def anchored_vwap_bands(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d)
    x = indicators.anchored_vwap(b, ["symbol", "day"], "minute", "vwap")
    x = indicators.anchored_vwap(x, ["symbol", "day"], "minute", "rth_vwap", F.col("rth"))
    return x.select("symbol", _sec("minute").alias("minute"), F.round("vwap", 4).alias("vwap"), F.round("vwap_sd", 2).alias("vwap_sd"), F.round("rth_vwap", 4).alias("rth_vwap"))


@query(f"""WITH {B} SELECT symbol, strftime(day, '%Y-%m-%d') AS day, arg_min(open, minute) AS globex_open, max(high) AS globex_high, min(low) AS globex_low, arg_max("close", minute) AS globex_close, sum(volume)::BIGINT AS globex_volume,
arg_min(open, minute) FILTER (WHERE rth) AS rth_open, max(high) FILTER (WHERE rth) AS rth_high, min(low) FILTER (WHERE rth) AS rth_low, arg_max("close", minute) FILTER (WHERE rth) AS rth_close, coalesce(sum(volume) FILTER (WHERE rth), 0)::BIGINT AS rth_volume FROM bars GROUP BY symbol, day""")
def session_statistics(spark: SparkSession, d: str) -> DataFrame:
    return bars.session_statistics(_bars(spark, d), ["symbol", "day"], "minute", F.col("rth")).withColumn("day", _day("day"))


@query(f"""WITH {B} SELECT symbol, epoch(minute)::BIGINT AS minute, "close" AS close FROM bars b WHERE EXISTS (SELECT 1 FROM bars x WHERE x.symbol = b.symbol AND x.day = b.day AND x.rth)""")
def valid_sessions(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d)
    return bars.valid_sessions(b, ["symbol", "day"], F.col("rth")).select("symbol", _sec("minute").alias("minute"), "close")


@query(f"""WITH {B}, r AS (SELECT symbol, day, min(low) AS lo, max(high) AS hi FROM bars WHERE rth GROUP BY ALL)
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, lo, hi, CASE WHEN lo >= 1000 AND hi <= 2000 THEN 'CONTAINED' WHEN hi >= 1000 AND lo <= 2000 THEN 'TOUCHED' ELSE 'OUTSIDE' END AS verdict FROM r""")
def price_window(spark: SparkSession, d: str) -> DataFrame:
    return bars.price_window(_bars(spark, d), ["symbol", "day"], F.col("rth"), 1000, 2000).withColumn("day", _day("day"))


@query("""WITH p AS (SELECT DISTINCT print_id, instrument_id, ts_event FROM option_trades WHERE ts_event IS NOT NULL)
SELECT p.print_id, c.candle_id FROM p JOIN (SELECT DISTINCT instrument_id, underlying FROM options_5m_contracts QUALIFY count(DISTINCT underlying) OVER (PARTITION BY instrument_id) = 1) u USING (instrument_id)
ASOF LEFT JOIN (SELECT symbol, ts, min(candle_id) AS candle_id FROM candles_1m WHERE "close" IS NOT NULL AND "close"::VARCHAR <> 'nan' GROUP BY ALL) c ON u.underlying = c.symbol AND p.ts_event >= c.ts""")
def asof_spot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "option_trades").where("ts_event IS NOT NULL").select("print_id", "instrument_id", "ts_event").distinct()
    one = table(spark, d, "options_5m_contracts").groupBy("instrument_id").agg(F.min("underlying").alias("symbol"), F.countDistinct("underlying").alias("n")).where("n = 1").drop("n")
    c = table(spark, d, "candles_1m").where("close IS NOT NULL AND NOT isnan(close)").groupBy("symbol", "ts").agg(F.min("candle_id").alias("candle_id"))
    return joins.asof(p.join(one, "instrument_id"), c, ["symbol"], "ts_event", "ts", ["candle_id"]).select("print_id", "candle_id")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A label at each half hour of a session: the side of the last close against the session's first."""
    b = _bars(spark, d)
    first = F.first("close").over(Window.partitionBy("symbol", "day").orderBy("minute"))
    x = b.withColumn("first", first).groupBy("symbol", "day", F.window("minute", "30 minutes")["end"].alias("ts")).agg(F.max_by("close", "minute").alias("c"), F.max("first").alias("f"))
    return x.select(F.col("symbol").alias("asset"), "day", "ts", F.when(F.col("c") > F.col("f"), "up").when(F.col("c") < F.col("f"), "down").otherwise("flat").alias("state"))


_SNAP = f"""{B}, fb AS (SELECT *, first_value("close") OVER (PARTITION BY symbol, day ORDER BY minute) AS f FROM bars),
sn AS (SELECT symbol AS asset, day, time_bucket(INTERVAL 30 MINUTE, minute) + INTERVAL 30 MINUTE AS ts, arg_max("close", minute) AS c, max(f) AS f FROM fb GROUP BY ALL),
st AS (SELECT asset, day, ts, CASE WHEN c > f THEN 'up' WHEN c < f THEN 'down' ELSE 'flat' END AS state FROM sn)"""


@query(f"""WITH {_SNAP}, {T} SELECT trade_id, CASE WHEN s.state IS NOT NULL AND s.day = tr.day AND tr.entry_time::TIMESTAMP - s.ts <= INTERVAL 30 MINUTE THEN s.state ELSE 'unknown' END AS regime
FROM tr ASOF LEFT JOIN st s ON tr.asset = s.asset AND tr.entry_time::TIMESTAMP >= s.ts""")
def asof_labels(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d).select("trade_id", "asset", "day", "entry_time")
    return joins.regime_labels(t, _snapshots(spark, d), "asof", date="day", asset=["asset"]).select("trade_id", "regime")


@query(f"""WITH {_SNAP}, {T}, f AS (SELECT asset, day, arg_max(state, ts) AS state FROM st GROUP BY ALL)
SELECT trade_id, coalesce(f.state, 'unknown') AS regime FROM tr LEFT JOIN f USING (asset, day)""")
def final_labels(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d).select("trade_id", "asset", "day", "entry_time")
    return joins.regime_labels(t, _snapshots(spark, d), "final", date="day", asset=["asset"]).select("trade_id", "regime")


@query(f"""WITH {_SNAP}, {T}, f AS (SELECT asset, day, arg_max(state, ts) AS state FROM st WHERE ts <= day::TIMESTAMP + INTERVAL 15 HOUR GROUP BY ALL)
SELECT trade_id, coalesce(f.state, 'unknown') AS regime FROM tr LEFT JOIN f USING (asset, day)""")
def exact_labels(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d).select("trade_id", "asset", "day", "entry_time")
    at = F.col("day").cast("timestamp") + F.expr("INTERVAL 15 HOURS")
    return joins.regime_labels(t, _snapshots(spark, d), "exact", date="day", asset=["asset"], at=at).select("trade_id", "regime")


@query("""WITH v AS (SELECT instrument_id, activation_date, max(struct_pack(s := strike, e := expiry)) AS x FROM options_5m_contracts WHERE activation_date IS NOT NULL AND strike IS NOT NULL AND expiry IS NOT NULL GROUP BY ALL),
f AS (SELECT DISTINCT snapshot_id, instrument_id, snapshot_time::DATE AS day FROM options_oi_snapshot),
n AS (SELECT instrument_id, arg_max(x.s, activation_date) AS strike FROM v GROUP BY ALL)
SELECT f.snapshot_id, coalesce(v.x.s, n.strike) AS strike FROM f ASOF LEFT JOIN v ON f.instrument_id = v.instrument_id AND f.day >= v.activation_date LEFT JOIN n ON f.instrument_id = n.instrument_id""")
def temporal_scd2_lookup(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "options_5m_contracts").where("activation_date IS NOT NULL AND strike IS NOT NULL AND expiry IS NOT NULL").groupBy("instrument_id", "activation_date").agg(F.max(F.struct("strike", "expiry")).alias("x")).select("instrument_id", "activation_date", "x.strike", "x.expiry")
    f = table(spark, d, "options_oi_snapshot").select("snapshot_id", "instrument_id", F.to_date("snapshot_time").alias("day")).distinct()
    return joins.temporal(f, v, "instrument_id", "day", "activation_date", ["strike"]).select("snapshot_id", "strike")


@query(f"""WITH {T}, sp AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM candles_1m GROUP BY ALL)
SELECT trade_id, epoch(sp.lo)::BIGINT AS valid_from FROM tr JOIN sp ON tr.asset = sp.symbol AND tr.entry_time >= sp.lo AND tr.entry_time < sp.hi""")
def interval_symbol_map(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "candles_1m").groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).withColumn("valid_from", _sec("lo"))
    return joins.interval(_trades(spark, d).select("trade_id", "asset", "entry_time"), spans.withColumnRenamed("symbol", "asset").select("asset", "lo", "hi", "valid_from"), "asset", "entry_time", "lo", "hi", ["valid_from"]).select("trade_id", "valid_from")


@query("""SELECT DISTINCT instrument_id FROM options_oi_snapshot o WHERE NOT EXISTS (SELECT 1 FROM option_trades t WHERE t.instrument_id = o.instrument_id)""")
def anti_semi_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "options_oi_snapshot").select("instrument_id").distinct().join(table(spark, d, "option_trades").select("instrument_id").distinct(), "instrument_id", "left_anti")


@query("""WITH k AS (SELECT *, lower(trim(snapshot_type)) AS kind FROM options_oi_snapshot WHERE open_interest IS NOT NULL AND snapshot_type IS NOT NULL)
SELECT kind, instrument_id, arg_max(open_interest, struct_pack(a := snapshot_time, b := snapshot_id))::BIGINT AS open_interest FROM k GROUP BY ALL""")
def latest_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "options_oi_snapshot").where("open_interest IS NOT NULL AND snapshot_type IS NOT NULL").withColumn("kind", F.lower(F.trim("snapshot_type")))
    return options.latest_publication(p, ["kind", "instrument_id"], F.struct("snapshot_time", "snapshot_id"), ["open_interest"]).withColumn("open_interest", F.col("open_interest").cast("long"))


_PRINT = """pr AS (SELECT *, (CASE WHEN bid_px >= ask_px THEN CASE upper(side) WHEN 'B' THEN 1 WHEN 'A' THEN -1 ELSE 0 END WHEN price >= ask_px THEN 1 WHEN price <= bid_px THEN -1 ELSE 0 END) AS ag FROM (
SELECT *, row_number() OVER (PARTITION BY print_id ORDER BY ts_recv) AS n FROM option_trades) WHERE n = 1 AND ts_event IS NOT NULL AND price IS NOT NULL AND price::VARCHAR <> 'nan')"""


@query(f"""WITH {_PRINT} SELECT instrument_id, epoch(time_bucket(INTERVAL 5 MINUTE, ts_event::TIMESTAMP))::BIGINT AS bucket, arg_min(price, struct_pack(a := ts_event, b := print_id)) AS open, max(price) AS high, min(price) AS low,
arg_max(price, struct_pack(a := ts_event, b := print_id)) AS close, sum(size)::BIGINT AS volume, sum(CASE WHEN ag > 0 THEN size ELSE 0 END)::BIGINT AS buy_volume, sum(CASE WHEN ag < 0 THEN size ELSE 0 END)::BIGINT AS sell_volume, sum(-ag * size)::BIGINT AS flow FROM pr GROUP BY ALL""")
def option_bars(spark: SparkSession, d: str) -> DataFrame:
    g = options.five_minute(options.classified(table(spark, d, "option_trades")))
    return g.select("instrument_id", _sec("bucket").alias("bucket"), "open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "flow")


@query("""WITH k AS (SELECT *, lower(trim(snapshot_type)) AS kind, snapshot_time::DATE AS day FROM options_oi_snapshot WHERE open_interest IS NOT NULL), b AS (
SELECT instrument_id, day, arg_max(open_interest, struct_pack(a := snapshot_time, b := snapshot_id)) FILTER (WHERE kind = 'evening') AS e, arg_max(open_interest, struct_pack(a := snapshot_time, b := snapshot_id)) FILTER (WHERE kind = 'morning') AS m FROM k WHERE kind IN ('evening', 'morning') GROUP BY ALL)
SELECT instrument_id, strftime(day, '%Y-%m-%d') AS day, e::BIGINT AS evening, m::BIGINT AS morning, last_value(coalesce(m, e) IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS in_force FROM b""")
def open_interest_in_force(spark: SparkSession, d: str) -> DataFrame:
    g = options.open_interest_in_force(table(spark, d, "options_oi_snapshot"))
    return g.select("instrument_id", _day("day").alias("day"), *[F.col(c).cast("long").alias(c) for c in ("evening", "morning", "in_force")])


@query("""WITH e AS (SELECT DISTINCT underlying, session_date AS day, expiry::DATE AS e FROM options_5m_contracts WHERE expiry IS NOT NULL AND underlying IS NOT NULL AND expiry::DATE >= session_date),
r AS (SELECT *, row_number() OVER (PARTITION BY underlying, day ORDER BY e) AS n FROM e)
SELECT underlying, strftime(day, '%Y-%m-%d') AS day, strftime(max(CASE WHEN n = 1 THEN e END), '%Y-%m-%d') AS front, strftime(max(CASE WHEN n = 2 THEN e END), '%Y-%m-%d') AS second FROM r GROUP BY underlying, day""")
def front_expiry(spark: SparkSession, d: str) -> DataFrame:
    g = options.front_expiry(table(spark, d, "options_5m_contracts"), "session_date")
    return g.select("underlying", *[_day(c).alias(c) for c in ("day", "front", "second")])


_CELL = """dl AS (SELECT run_id, day, sum(ticks) AS d, count(*) AS n, sum(greatest(ticks, 0)) AS w, sum(greatest(-ticks, 0)) AS l, count(*) FILTER (ticks > 1) AS wins, count(*) FILTER (ticks >= -1) AS be FROM tr GROUP BY ALL),
ce AS (SELECT run_id, sum(d) AS s, sum(n) AS n, sum(w) AS w, sum(l) AS l, sum(wins) AS wins, sum(be) AS be, avg(d) AS mu, stddev_samp(d) AS sd, sum(d * d) AS sq, count(*) AS k, min(day) AS lo, max(day) AS hi FROM dl GROUP BY ALL),
cd AS (SELECT *, greatest(k, (SELECT count(*) FROM generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY) g(x) WHERE isodow(x) < 6))::DOUBLE AS nd FROM ce)"""


@query(f"""WITH {T}, {_CELL} SELECT run_id, s AS total_ticks, n::BIGINT AS total_trades, round(s / n, 6) AS avg_trade, CASE WHEN l > 0 THEN round(w / l, 6) ELSE 'inf'::DOUBLE END AS profit_factor, round(100.0 * wins / n, 6) AS win_rate, round(100.0 * be / n, 6) AS win_rate_be,
CASE WHEN k >= 2 AND sd > 0 THEN round(mu / sd * sqrt(252), 4) END AS sharpe_trade, CASE WHEN nd >= 2 AND (sq - s * s / nd) > 0 THEN round(s / nd / sqrt((sq - s * s / nd) / (nd - 1)) * sqrt(252), 4) END AS sharpe_daily FROM cd""")
def cell_metrics_8(spark: SparkSession, d: str) -> DataFrame:
    c = report.cells(_trades(spark, d), ["run_id"], "ticks", "day", 1.0)
    return c.select("run_id", "total_ticks", "total_trades", *[F.round(x, 6).alias(x) for x in ("avg_trade", "profit_factor", "win_rate", "win_rate_be")], *[F.round(x, 4).alias(x) for x in ("sharpe_trade", "sharpe_daily")])


@query(f"""WITH {T}, c AS (SELECT *, sum(ticks) OVER w AS cum, ticks > 0 AS won, row_number() OVER w AS rn, row_number() OVER (PARTITION BY run_id, ticks > 0 ORDER BY exit_time NULLS FIRST, trade_id) AS rw FROM tr WINDOW w AS (PARTITION BY run_id ORDER BY exit_time NULLS FIRST, trade_id)),
p AS (SELECT *, max(cum) OVER (PARTITION BY run_id ORDER BY exit_time NULLS FIRST, trade_id) AS pk, CASE WHEN abs(entry_price - sl) > 0 THEN abs(tp - entry_price) / abs(entry_price - sl) END AS rp, CASE WHEN abs(entry_price - sl) > 0 THEN pnl_points / abs(entry_price - sl) END AS rr FROM c),
st AS (SELECT run_id, coalesce(max(n) FILTER (won), 0) AS mw, coalesce(max(n) FILTER (NOT won), 0) AS ml FROM (SELECT run_id, won, rn - rw AS g, count(*) AS n FROM c GROUP BY ALL) GROUP BY ALL)
SELECT run_id, sum(ticks) AS total_ticks, round(avg(ticks), 4) AS avg_trade, round(coalesce(avg(ticks) FILTER (ticks > 0), 0), 4) AS avg_win, round(coalesce(avg(ticks) FILTER (ticks < 0), 0), 4) AS avg_loss, count(*)::BIGINT AS total_trades, round(avg((ticks > 0)::INT), 4) AS win_rate,
round(quantile_cont(rp, 0.5), 4) AS median_rr_planned, round(avg(rr), 4) AS avg_rr_realised, min(cum - pk) AS max_drawdown, max(pk) AS max_peak, max(mw)::BIGINT AS max_consec_wins, max(ml)::BIGINT AS max_consec_losses,
count(*) FILTER (direction = 'long')::BIGINT AS long_trades FROM p JOIN st USING (run_id) GROUP BY run_id""")
def trade_report(spark: SparkSession, d: str) -> DataFrame:
    r = report.trade_report(_trades(spark, d), ["run_id"], ["exit_time", "trade_id"])
    return r.select("run_id", "total_ticks", *[F.round(c, 4).alias(c) for c in ("avg_trade", "avg_win", "avg_loss")], "total_trades", *[F.round(c, 4).alias(c) for c in ("win_rate", "median_rr_planned", "avg_rr_realised")], "max_drawdown", "max_peak", "max_consec_wins", "max_consec_losses", "long_trades")


@query(f"""WITH {T} SELECT exit_reason, count(ticks)::BIGINT AS trades, round(avg(ticks), 1) AS avg_ticks, round(sum(ticks), 0)::BIGINT AS total_ticks FROM tr GROUP BY ALL""")
def exit_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return report.exit_breakdown(_trades(spark, d), [])


@query(f"""WITH {T} SELECT CASE WHEN grouping(direction) = 1 THEN 'All entries' ELSE direction END AS entry, count(*)::BIGINT AS trades, count(*) FILTER (ticks > 0)::BIGINT AS wins, count(*) FILTER (ticks < 0)::BIGINT AS losses, sum(ticks) AS total_ticks, round(avg(ticks), 6) AS avg_ticks,
round(sum(greatest(ticks, 0)) / sum(greatest(-ticks, 0)), 6) AS profit_factor FROM tr WHERE direction IS NOT NULL GROUP BY GROUPING SETS ((direction), ())""")
def entry_breakdown_all_row(spark: SparkSession, d: str) -> DataFrame:
    return report.typed_breakdown(_trades(spark, d), "direction").withColumns({c: F.round(c, 6) for c in ("avg_ticks", "profit_factor")})


DAY_TYPES = ["holiday", "fomc", "cpi", "nfp", "ppi", "other_high_impact", "normal"]


@query(f"""WITH {T}, l AS (SELECT unnest({DAY_TYPES!r}) AS day_type) SELECT day_type, count(trade_id)::BIGINT AS trades, count(*) FILTER (ticks > 0)::BIGINT AS wins, count(*) FILTER (ticks < 0)::BIGINT AS losses, coalesce(sum(ticks), 0) AS total_ticks, round(avg(ticks), 6) AS avg_ticks FROM l LEFT JOIN tr USING (day_type) GROUP BY day_type""")
def bucket_breakdown_dense(spark: SparkSession, d: str) -> DataFrame:
    return report.dense_breakdown(_trades(spark, d), "day_type", DAY_TYPES).drop("place").withColumn("avg_ticks", F.round("avg_ticks", 6))


@query("""WITH e AS (SELECT ts::TIMESTAMP::DATE AS day, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS r FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, min(r)::INT AS rank FROM e GROUP BY day""")
def day_bucket_priority(spark: SparkSession, d: str) -> DataFrame:
    r = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 3).otherwise(4)
    return table(spark, d, "events").groupBy(_day(F.to_date("ts")).alias("day")).agg(F.min(r).alias("rank"))


@query(f"""WITH {T}, u AS (SELECT DISTINCT run_id, day FROM tr), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY day) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM u), c AS (SELECT run_id, day AS cut FROM r WHERE i = floor((n + 1) / 2))
SELECT run_id, (CASE WHEN tr.day <= c.cut THEN 1 ELSE 2 END)::INT AS half, count(*)::BIGINT AS trades, sum(ticks) AS total_ticks FROM tr JOIN c USING (run_id) GROUP BY ALL""")
def median_split_halves(spark: SparkSession, d: str) -> DataFrame:
    return report.split_halves(_trades(spark, d), ["run_id"], "day").groupBy("run_id", "half").agg(F.count(F.lit(1)).alias("trades"), F.sum("ticks").alias("total_ticks"))


@query(f"""WITH {T}, u AS (SELECT DISTINCT day FROM tr), r AS (SELECT day, row_number() OVER (ORDER BY day) <= greatest(least(floor(count(*) OVER () * 0.7), count(*) OVER () - 1), 1) AS i FROM u)
SELECT run_id, count(*) FILTER (i)::BIGINT AS n_is, count(*) FILTER (NOT i)::BIGINT AS n_oos, coalesce(sum(ticks) FILTER (i), 0) AS total_is, coalesce(sum(ticks) FILTER (NOT i), 0) AS total_oos FROM tr JOIN r USING (day) GROUP BY ALL""")
def pool_is_oos_split(spark: SparkSession, d: str) -> DataFrame:
    return report.sample_split(_trades(spark, d), ["run_id"], "day", "ticks", 0.7)


@query(f"""WITH {T}, dl AS (SELECT asset, day, sum(ticks) AS d FROM tr WHERE asset IS NOT NULL GROUP BY ALL), n AS (SELECT count(DISTINCT day)::DOUBLE AS n FROM dl), m AS (SELECT asset, sum(d) AS s, sum(d * d) AS q FROM dl GROUP BY ALL),
p AS (SELECT a.asset AS a, b.asset AS b, sum(a.d * b.d) AS p FROM dl a JOIN dl b ON a.day = b.day AND a.asset < b.asset GROUP BY ALL)
SELECT a, b, round(coalesce((n * coalesce(p, 0) - x.s * y.s) / nullif(sqrt((n * x.q - x.s * x.s) * (n * y.q - y.s * y.s)), 0), 0), 6) AS corr FROM (SELECT x.asset AS a, y.asset AS b FROM m x JOIN m y ON x.asset < y.asset) LEFT JOIN p USING (a, b) JOIN m x ON a = x.asset JOIN m y ON b = y.asset, n""")
def corr_matrix_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return report.correlations(_trades(spark, d).where("asset IS NOT NULL"), "asset", "day", "ticks").withColumn("corr", F.round("corr", 6))


_FINAL = f"""{_SNAP}, f AS (SELECT asset, day, arg_max(state, ts) AS state FROM st GROUP BY ALL)"""


@query(f"""WITH {_FINAL}, s AS (SELECT *, lag(state) OVER w AS previous, day - lag(day) OVER w AS gap FROM f WINDOW w AS (PARTITION BY asset ORDER BY day)), c AS (SELECT asset, previous, state, count(*) AS n FROM s WHERE gap <= 5 GROUP BY ALL)
SELECT asset, previous, state, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY asset, previous), 6) AS probability FROM c""")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    f = _snapshots(spark, d).groupBy("asset", "day").agg(F.max_by("state", "ts").alias("state"))
    return report.transitions(f, ["asset"], "day", "state").withColumn("probability", F.round("probability", 6))


@query(f"""WITH {T}, x AS (SELECT abs(tp - entry_price) / abs(entry_price - sl) AS p, pnl_points / abs(entry_price - sl) AS r FROM tr WHERE abs(entry_price - sl) > 0),
s AS (SELECT 'planned' AS series, p AS rr FROM x UNION ALL SELECT 'realised', r FROM x UNION ALL SELECT 'won', r FROM x WHERE r > 0 UNION ALL SELECT 'even', r FROM x WHERE r = 0)
SELECT series, floor(rr / 0.25)::BIGINT AS bin, count(*)::BIGINT AS n FROM s WHERE rr IS NOT NULL GROUP BY ALL""")
def rr_histogram(spark: SparkSession, d: str) -> DataFrame:
    return report.histogram(report.reward_risk(_trades(spark, d)), "series", "rr", 0.25)


@query(f"""WITH {T}, m AS (SELECT asset, day_type, count(*) AS n, sum(ticks) AS t FROM tr WHERE asset IS NOT NULL AND day_type IS NOT NULL GROUP BY ALL)
SELECT a.asset, b.day_type, m.n::BIGINT AS trades, m.t AS total_ticks FROM (SELECT DISTINCT asset FROM m) a CROSS JOIN (SELECT DISTINCT day_type FROM m) b LEFT JOIN m USING (asset, day_type)""")
def dense_heatmap_grid(spark: SparkSession, d: str) -> DataFrame:
    m = _trades(spark, d).where("asset IS NOT NULL AND day_type IS NOT NULL").groupBy("asset", "day_type").agg(F.count(F.lit(1)).alias("trades"), F.sum("ticks").alias("total_ticks"))
    return report.dense_grid(m, "asset", "day_type")


@query(f"""WITH {B}, x AS (SELECT symbol, day, minute, volume / nullif(high - low, 0) AS v, high, "close" - lag("close") OVER (PARTITION BY symbol, day ORDER BY minute) AS dc FROM bars)
SELECT symbol, epoch(minute)::BIGINT AS minute, CASE WHEN count(v) OVER w = 20 THEN round(avg(v) OVER w, 4) END AS density, CASE WHEN count(high) OVER p = 10 THEN max(high) OVER p END AS prior_high, CASE WHEN count(dc) OVER w = 20 THEN round(stddev_samp(dc) OVER w, 4) END AS change_sd
FROM x WINDOW w AS (PARTITION BY symbol, day ORDER BY minute ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p AS (PARTITION BY symbol, day ORDER BY minute ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def rolling_baselines(spark: SparkSession, d: str) -> DataFrame:
    k = ["symbol", "day"]
    x = _bars(spark, d).withColumns({"v": F.when(F.col("high") != F.col("low"), F.col("volume") / F.when(F.col("high") != F.col("low"), F.col("high") - F.col("low"))), "dc": F.col("close") - F.lag("close").over(Window.partitionBy(*k).orderBy("minute"))})
    return x.select("symbol", _sec("minute").alias("minute"), F.round(indicators.full_window(F.col("v"), k, "minute", 20), 4).alias("density"), indicators.previous_extreme(F.col("high"), k, "minute", 10).alias("prior_high"), F.round(indicators.full_window(F.col("dc"), k, "minute", 20, F.stddev_samp), 4).alias("change_sd"))


_RET = f"""{B}, rt AS (SELECT *, CASE WHEN epoch(minute) - epoch(lag(minute) OVER w) = 60 AND "close" > 0 AND lag("close") OVER w > 0 THEN ln("close" / lag("close") OVER w) END AS r FROM bars WINDOW w AS (PARTITION BY symbol, day ORDER BY minute))"""


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return regimes.returns(_bars(spark, d), ["symbol", "day"])


def _vol(spark: SparkSession, d: str) -> DataFrame:
    clock = minute_of_day(F.col("minute") + F.expr("INTERVAL 2 HOURS"))
    return regimes.realised(_returns(spark, d), ["symbol", "day"], clock, 30)


_VOL = f"""{_RET}, rv AS (SELECT symbol, day, minute, (floor((hour(minute + INTERVAL 2 HOUR) * 60 + minute(minute + INTERVAL 2 HOUR)) / 30) + 1)::INT * 30 AS clock, sum(coalesce(r * r, 0)) OVER w AS ss, count(r) OVER w AS n FROM rt WINDOW w AS (PARTITION BY symbol, day ORDER BY minute)),
vo AS (SELECT symbol, day, clock, arg_max(ss, minute) AS ss, max(n) AS n FROM rv GROUP BY ALL), lv AS (SELECT symbol, day, clock, n, CASE WHEN n > 0 AND ss > 0 THEN ln(sqrt(ss / n)) END AS l FROM vo)"""


@query(f"""WITH {_VOL} SELECT symbol, strftime(day, '%Y-%m-%d') AS day, clock::INT AS clock, n::BIGINT AS n, round(l, 6) AS ln_vol FROM lv""")
def realised_vol_clock(spark: SparkSession, d: str) -> DataFrame:
    return _vol(spark, d).select("symbol", _day("day").alias("day"), "clock", "n", F.round("ln_vol", 6).alias("ln_vol"))


@query(f"""WITH {_VOL}, h AS (SELECT a.symbol, a.day, a.clock, any_value(a.l) AS l, list(b.l) FILTER (b.l IS NOT NULL) AS past FROM (SELECT *, row_number() OVER (PARTITION BY symbol, clock ORDER BY day) AS i FROM lv) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, clock ORDER BY day) AS i FROM lv) b ON a.symbol = b.symbol AND a.clock = b.clock AND b.i BETWEEN a.i - 20 AND a.i - 1 GROUP BY ALL),
c AS (SELECT *, list_median(past) AS ce FROM h), s AS (SELECT *, list_median(list_transform(past, lambda x: abs(x - ce))) * 1.4826 AS sc FROM c)
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, clock::INT AS clock, round(ce, 6) AS center, CASE WHEN len(past) >= 2 AND sc > 0 THEN round((l - ce) / sc, 4) END AS z FROM s""")
def realised_vol_clock_z(spark: SparkSession, d: str) -> DataFrame:
    z = regimes.robust_z(_vol(spark, d), ["symbol", "clock"], "day", "ln_vol", 20)
    return z.select("symbol", _day("day").alias("day"), "clock", F.round("center", 6).alias("center"), F.round("z", 4).alias("z"))


@query(f"""WITH {_RET}, b AS (SELECT *, sum(r) OVER w AS bq, count(r) OVER w AS bn FROM rt WINDOW w AS (PARTITION BY symbol, day ORDER BY minute ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
m AS (SELECT symbol, day, count(r) AS n, avg(r) AS mu, count(*) FILTER (r <> 0) AS mv FROM rt GROUP BY ALL),
a AS (SELECT symbol, day, m.n, m.mv, sum((r - mu) * (r - mu)) AS s1, count(*) FILTER (bn = 5) AS nb, sum((bq - 5 * mu) * (bq - 5 * mu)) FILTER (bn = 5) AS sq FROM b JOIN m USING (symbol, day) GROUP BY ALL)
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, n::BIGINT AS n, nb::BIGINT AS blocks, CASE WHEN n >= 30 AND mv >= 30 AND nb >= 2 AND s1 > 0 THEN round(sq / (5 * nb * (1 - 5.0 / n)) / (s1 / (n - 1)), 5) END AS vr FROM a""")
def variance_ratio(spark: SparkSession, d: str) -> DataFrame:
    v = regimes.variance_ratio(_returns(spark, d), ["symbol", "day"], 5)
    return v.select("symbol", _day("day").alias("day"), "n", "blocks", F.round("vr", 5).alias("vr"))


@query(f"""WITH {_RET}, f AS (SELECT *, first_value("close") OVER (PARTITION BY symbol, day ORDER BY minute) AS f FROM rt), x AS (SELECT *, abs("close" - f - lag("close" - f) OVER (PARTITION BY symbol, day ORDER BY minute)) AS dd, "close" - f AS s FROM f)
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, CASE WHEN count(*) >= 30 AND count(*) FILTER (r IS NOT NULL AND dd > 0) >= 30 THEN round(abs(arg_max(s, minute) - arg_min(s, minute)) / nullif(sum(dd) FILTER (r IS NOT NULL), 0), 6) END AS er FROM x GROUP BY symbol, day""")
def efficiency_ratio(spark: SparkSession, d: str) -> DataFrame:
    x = _returns(spark, d).withColumn("f", F.first("close").over(Window.partitionBy("symbol", "day").orderBy("minute")))
    e = regimes.efficiency(x, ["symbol", "day"], F.col("close") - F.col("f"))
    return e.select("symbol", _day("day").alias("day"), "n", F.round("er", 6).alias("er"))


@query(f"""WITH {_RET}, x AS (SELECT symbol, day, minute, "close" AS c, r, lag("close") OVER w AS lv, CASE WHEN r IS NOT NULL THEN "close" - lag("close") OVER w END AS y, first_value("close") OVER w AS f FROM rt WINDOW w AS (PARTITION BY symbol, day ORDER BY minute)),
k AS (SELECT *, lag(y) OVER (PARTITION BY symbol, day ORDER BY minute) AS d FROM x), a AS (SELECT symbol, day, count(*)::DOUBLE AS n, var_pop(lv - f) AS vl, var_pop(d) AS vd, covar_pop(lv - f, d) AS ld, covar_pop(lv - f, y) AS ly, covar_pop(d, y) AS dy, var_pop(y) AS vy, count(*) FILTER (y <> 0) AS mv FROM k WHERE y IS NOT NULL AND lv IS NOT NULL AND d IS NOT NULL GROUP BY ALL),
b AS (SELECT *, vl * vd - ld * ld AS det, (vd * ly - ld * dy) / nullif(vl * vd - ld * ld, 0) AS bl, (vl * dy - ld * ly) / nullif(vl * vd - ld * ld, 0) AS bd FROM a), v AS (SELECT *, (vy - bl * ly - bd * dy) / nullif(n - 3, 0) * vd / nullif(det, 0) AS var FROM b)
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, n::BIGINT AS n, CASE WHEN n >= 30 AND mv >= 30 AND det > 1e-18 AND var > 0 THEN round(bl / sqrt(var), 4) END AS adf_t FROM v""")
def adf_closed_form(spark: SparkSession, d: str) -> DataFrame:
    x = _returns(spark, d).withColumn("f", F.first("close").over(Window.partitionBy("symbol", "day").orderBy("minute")))
    return regimes.adf(x, ["symbol", "day"], F.col("close") - F.col("f")).withColumns({"day": _day("day"), "adf_t": F.round("adf_t", 4)})


@query()
def hurst_exponents(spark: SparkSession, d: str) -> DataFrame:
    r = _returns(spark, d)
    return regimes.hurst_variance(r, ["symbol", "day"]).join(regimes.hurst_rescaled(r.drop("rth"), ["symbol", "day"]), ["symbol", "day"]).withColumn("day", _day("day"))


@query(SQL["realised_vol_clock_z"].replace("SELECT symbol, strftime(day, '%Y-%m-%d') AS day, clock::INT AS clock, round(ce, 6) AS center, CASE", ", zz AS (SELECT symbol, day, clock, CASE").replace("AS z FROM s", "AS z FROM s)") + """,
p AS (SELECT *, row_number() OVER w AS pos, CASE WHEN z > 1 THEN 1 WHEN z < -1 THEN -1 WHEN z < 0.5 AND z > -0.5 THEN 0 END AS code FROM zz WINDOW w AS (PARTITION BY symbol ORDER BY day, clock)),
q AS (SELECT *, last_value(code IGNORE NULLS) OVER w AS c, max(CASE WHEN code IS NOT NULL THEN pos END) OVER w AS pc, max(CASE WHEN code IS NULL AND z >= 0.5 THEN pos END) OVER w AS pu, max(CASE WHEN code IS NULL AND z <= -0.5 THEN pos END) OVER w AS pd FROM p WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, clock::INT AS clock, z, CASE WHEN z IS NULL THEN 'unknown' WHEN c = 1 AND coalesce(pd < pc, true) THEN 'high' WHEN c = -1 AND coalesce(pu < pc, true) THEN 'low' ELSE 'normal' END AS state FROM q""")
def hysteresis_labels(spark: SparkSession, d: str) -> DataFrame:
    z = regimes.robust_z(_vol(spark, d), ["symbol", "clock"], "day", "ln_vol", 20).select("symbol", "day", "clock", F.round("z", 4).alias("z"))
    return folds.hysteresis(z, ["symbol"], ["day", "clock"], "z").withColumn("day", _day("day"))


@query(f"""WITH {B}, x AS (SELECT symbol, day, sum(volume * (high + low + "close") / 3) OVER w AS pv, sum(volume) OVER w AS v, minute, open, "close" AS c, volume FROM bars WHERE rth WINDOW w AS (PARTITION BY symbol, day ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, round(pv / nullif(v, 0), 6) AS vw, row_number() OVER o AS pos, count(*) OVER (PARTITION BY symbol, day) AS n FROM x WINDOW o AS (PARTITION BY symbol, day ORDER BY minute)),
s AS (SELECT *, coalesce(last_value(CASE WHEN vw IS NULL OR volume = 0 THEN NULL WHEN c > vw THEN 1 WHEN c < vw THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS side FROM k WHERE n >= 2),
u AS (SELECT *, CASE WHEN pos = 1 THEN 0 ELSE coalesce(lag(side) OVER (PARTITION BY symbol, day ORDER BY minute), 0) END AS dur FROM s),
g AS (SELECT *, sum(CASE WHEN dur <> coalesce(pd, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tn FROM (SELECT *, lag(dur) OVER (PARTITION BY symbol, day ORDER BY minute) AS pd, lead(open) OVER (PARTITION BY symbol, day ORDER BY minute) AS no FROM u)),
t AS (SELECT symbol, day, tn, dur, arg_min(open, minute) AS e, min(minute) AS em, max(minute) AS xm, arg_max(struct_pack(no := no, c := c), minute) AS z FROM g WHERE dur <> 0 GROUP BY ALL)
SELECT symbol, epoch(em)::BIGINT AS entry_minute, CASE WHEN dur > 0 THEN 'long' ELSE 'short' END AS direction, e AS entry_price, coalesce(z.no, z.c) AS exit_price, CASE WHEN z.no IS NULL THEN 'eod' ELSE 'vwap_flip' END AS exit_reason, round(dur * (coalesce(z.no, z.c) - e), 6) AS pnl_points FROM t""")
def vwap_trend_trades(spark: SparkSession, d: str) -> DataFrame:
    x = indicators.anchored_vwap(_bars(spark, d).where("rth"), ["symbol", "day"], "minute", "vwap").withColumn("vwap", F.round("vwap", 6))
    t = rules.vwap_trend(x.select("symbol", "day", "minute", "open", "high", "low", "close", "volume", "vwap"), ["symbol", "day"], "vwap")
    return t.select("symbol", _sec("entry_minute").alias("entry_minute"), "direction", "entry_price", "exit_price", "exit_reason", F.round("pnl_points", 6).alias("pnl_points"))


_ORB = f"""{B}, r AS (SELECT *, row_number() OVER w AS pos, lead(open) OVER w AS no, lead(minute) OVER w AS nm, count(*) OVER d AS cnt, min(minute) OVER d AS st FROM bars WHERE rth WINDOW w AS (PARTITION BY symbol, day ORDER BY minute), d AS (PARTITION BY symbol, day)),
pa AS (SELECT * FROM (VALUES %s) v(combo, range_minutes, reward)), ea AS (SELECT r.*, pa.*, minute < st + to_minutes(range_minutes) AS early FROM r, pa),
hl AS (SELECT *, max(high) FILTER (early) OVER d AS hi, min(low) FILTER (early) OVER d AS lo FROM ea WINDOW d AS (PARTITION BY combo, symbol, day)),
go AS (SELECT *, NOT early AND pos < cnt AND hi > lo AS ok, "close" > hi AND "close" > open AS up, "close" < lo AND "close" < open AS dn FROM hl),
sg AS (SELECT combo, symbol, day, min(pos) AS sp, arg_min(up, pos) AS lg, arg_min(no, pos) AS ep, arg_min(nm, pos) AS em FROM go WHERE ok AND (up OR dn) GROUP BY ALL),
xx AS (SELECT go.*, lg, ep, em, CASE WHEN lg THEN ep - (hi - lo) ELSE ep + (hi - lo) END AS sl, CASE WHEN lg THEN ep + (hi - lo) * reward ELSE ep - (hi - lo) * reward END AS tp, minute >= em + INTERVAL 120 MINUTE AS late FROM go JOIN sg USING (combo, symbol, day) WHERE pos > sp),
ht AS (SELECT *, CASE WHEN lg THEN low <= sl ELSE high >= sl END AS sx, CASE WHEN lg THEN high >= tp ELSE low <= tp END AS tx, CASE WHEN lg THEN high >= ep ELSE low <= ep END AS ev FROM xx),
ag AS (SELECT combo, range_minutes, reward, symbol, day, any_value(lg) AS lg, any_value(ep) AS ep, any_value(em) AS em, any_value(sl) AS sl, any_value(tp) AS tp, min(pos) FILTER (sx AND NOT late) AS s1, min(pos) FILTER (tx AND NOT late) AS t1, min(pos) FILTER (late) AS ou, min(pos) FILTER (sx AND late) AS s2, min(pos) FILTER (ev AND late) AS t2,
  arg_min(minute, pos) FILTER (sx AND NOT late) AS s1m, arg_min(minute, pos) FILTER (tx AND NOT late) AS t1m, arg_min(minute, pos) FILTER (late) AS oum, arg_min("close", pos) FILTER (late) AS ouc, arg_min(minute, pos) FILTER (sx AND late) AS s2m, arg_min(minute, pos) FILTER (ev AND late) AS t2m, max(minute) AS enm, arg_max("close", pos) AS enc FROM ht GROUP BY ALL),
rs AS (SELECT *, CASE WHEN s1 IS NOT NULL AND (t1 IS NULL OR s1 <= t1) THEN 'sl' WHEN t1 IS NOT NULL THEN 'tp' WHEN ou IS NULL THEN 'eod' WHEN CASE WHEN lg THEN ouc > ep ELSE ouc < ep END THEN 'timeout_profit' WHEN s2 IS NOT NULL AND (t2 IS NULL OR s2 <= t2) THEN 'sl_late' WHEN t2 IS NOT NULL THEN 'tp_even' ELSE 'eod' END AS rr FROM ag),
orb AS (SELECT combo, range_minutes, reward, symbol, day, CASE WHEN lg THEN 'long' ELSE 'short' END AS direction, em AS entry_minute, CASE rr WHEN 'sl' THEN s1m WHEN 'tp' THEN t1m WHEN 'timeout_profit' THEN oum WHEN 'sl_late' THEN s2m WHEN 'tp_even' THEN t2m ELSE enm END AS exit_minute, ep AS entry_price,
  CASE rr WHEN 'sl' THEN sl WHEN 'sl_late' THEN sl WHEN 'tp' THEN tp WHEN 'tp_even' THEN ep WHEN 'timeout_profit' THEN ouc ELSE enc END AS exit_price, sl, CASE WHEN rr IN ('sl_late', 'tp_even') OR (rr = 'eod' AND ou IS NOT NULL) THEN ep ELSE tp END AS tp, replace(replace(rr, 'sl_late', 'sl'), 'tp_even', 'tp') AS exit_reason FROM rs),
ot AS (SELECT *, CASE direction WHEN 'long' THEN exit_price - entry_price ELSE entry_price - exit_price END AS pnl_points FROM orb)"""


@query("WITH " + _ORB % "(0, 15, 2.0::DOUBLE)" + " SELECT symbol, strftime(day, '%Y-%m-%d') AS day, direction, epoch(entry_minute)::BIGINT AS entry_minute, epoch(exit_minute)::BIGINT AS exit_minute, entry_price, exit_price, sl, tp, exit_reason, pnl_points FROM ot")
def orb_trades(spark: SparkSession, d: str) -> DataFrame:
    t = rules.opening_range(_bars(spark, d).where("rth").drop("rth"), ["symbol", "day"])
    return t.withColumns({"day": _day("day"), "entry_minute": _sec("entry_minute"), "exit_minute": _sec("exit_minute")})


@query("WITH " + _ORB % "(0, 5, 1.0::DOUBLE), (1, 5, 2.0::DOUBLE), (2, 15, 1.0::DOUBLE), (3, 15, 2.0::DOUBLE), (4, 30, 1.0::DOUBLE), (5, 30, 2.0::DOUBLE)" + """, dl AS (SELECT combo, range_minutes, reward, day, sum(pnl_points) AS d, count(*) AS n, sum(greatest(pnl_points, 0)) AS w, sum(greatest(-pnl_points, 0)) AS l, count(*) FILTER (pnl_points > 0) AS wins FROM ot GROUP BY ALL)
SELECT combo::INT AS combo, range_minutes::INT AS range_minutes, reward, round(sum(d), 4) AS total_ticks, sum(n)::BIGINT AS total_trades, round(sum(d) / sum(n), 6) AS avg_trade, CASE WHEN sum(l) > 0 THEN round(sum(w) / sum(l), 6) ELSE 'inf'::DOUBLE END AS profit_factor, round(100.0 * sum(wins) / sum(n), 6) AS win_rate FROM dl GROUP BY ALL""")
def orb_sweep(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d).where("rth").drop("rth")
    axes = rules.combinations({"range_minutes": [5, 15, 30], "reward": [1.0, 2.0]})
    t = rules.sweep(b, axes, rules.opening_range, ["symbol", "day"])
    c = report.cells(t, ["combo", "range_minutes", "reward"], "pnl_points", "day")
    return c.select("combo", "range_minutes", "reward", F.round("total_ticks", 4).alias("total_ticks"), "total_trades", *[F.round(x, 6).alias(x) for x in ("avg_trade", "profit_factor", "win_rate")])


@query(f"""WITH {B}, x AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY symbol, day ORDER BY minute))
SELECT symbol, epoch(minute)::BIGINT AS minute, CASE WHEN low > h2 THEN 'bull' ELSE 'bear' END AS gap, CASE WHEN low > h2 THEN h2 ELSE high END AS gap_low, CASE WHEN low > h2 THEN low ELSE l2 END AS gap_high FROM x WHERE low > h2 OR high < l2""")
def price_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rules.gaps(_bars(spark, d), ["symbol", "day"]).where("gap IS NOT NULL").select("symbol", _sec("minute").alias("minute"), "gap", "gap_low", "gap_high")


@query(f"""WITH RECURSIVE {T}, o AS (SELECT run_id, ticks, entry_time AS e, exit_time AS x, row_number() OVER (PARTITION BY run_id ORDER BY entry_time, exit_time, trade_id) AS n FROM tr WHERE entry_time IS NOT NULL AND exit_time IS NOT NULL),
w AS (SELECT run_id, n, x AS l, 1 AS k, ticks AS t FROM o WHERE n = 1 UNION ALL
SELECT o.run_id, o.n, CASE WHEN o.e >= w.l THEN o.x ELSE w.l END, w.k + (o.e >= w.l)::INT, w.t + CASE WHEN o.e >= w.l THEN o.ticks ELSE 0 END FROM w JOIN o ON o.run_id = w.run_id AND o.n = w.n + 1)
SELECT run_id, arg_max(k, n)::BIGINT AS kept, arg_max(t, n) AS total_ticks FROM w GROUP BY run_id""")
def no_overlap_walk(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d).where("entry_time IS NOT NULL AND exit_time IS NOT NULL").select("run_id", "trade_id", "entry_time", "exit_time", "ticks")
    k = folds.no_overlap(t, ["run_id"], "entry_time", "exit_time", ["trade_id"])
    return k.groupBy("run_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("ticks").alias("total_ticks"))


def _sized(spark: SparkSession, d: str, rule) -> DataFrame:
    t = _trades(spark, d).where("exit_time IS NOT NULL").select("run_id", "trade_id", "day", "exit_time", "ticks", "pnl_points", fine(F.col("entry_price")).alias("entry_price"), fine(F.col("sl")).alias("sl"))
    return folds.sized(t, ["run_id"], ["exit_time", "trade_id"], rule)


def _dollars_sql(facts: str, size: str) -> str:
    """SQL of the metrics of trades sized one after the other: facts is one row a run, size the contracts at equity eq."""
    columns = "final_equity total avg_trade avg_win avg_loss largest_win largest_loss max_dd_dollars max_dd_pct max_peak win_rate cost_drag sharpe_daily sharpe_trade profit_factor calmar".split()
    return f"""WITH RECURSIVE {T}, o AS (SELECT run_id, trade_id, day, ticks, pnl_points, entry_price, sl, row_number() OVER (PARTITION BY run_id ORDER BY exit_time, trade_id) AS n FROM tr WHERE exit_time IS NOT NULL), fa AS ({facts}),
z AS (SELECT run_id, 0::BIGINT AS n, 100000.0::DOUBLE AS eq, 0.0::DOUBLE AS c, 0.0::DOUBLE AS g, NULL::DATE AS day FROM (SELECT DISTINCT run_id FROM o) UNION ALL
SELECT run_id, n, eq + ticks * 12.5::DOUBLE * c, c, ticks * 12.5::DOUBLE * c, day FROM (SELECT o.run_id, o.n, z.eq, o.ticks, o.day, {size} AS c FROM z JOIN o ON o.run_id = z.run_id AND o.n = z.n + 1 JOIN fa ON fa.run_id = o.run_id)),
y AS (SELECT *, 100000 + sum(g) OVER w AS e FROM z WHERE n > 0 WINDOW w AS (PARTITION BY run_id ORDER BY n)), p AS (SELECT *, max(e) OVER (PARTITION BY run_id ORDER BY n) AS pk FROM y),
dy AS (SELECT run_id, avg(d) AS m, stddev_samp(d) AS s FROM (SELECT run_id, day, sum(g) AS d FROM y GROUP BY ALL) GROUP BY run_id),
a AS (SELECT run_id, arg_max(e, n) AS final_equity, sum(g) AS total, avg(g) AS avg_trade, coalesce(avg(g) FILTER (g > 0), 0) AS avg_win, coalesce(avg(g) FILTER (g < 0), 0) AS avg_loss, max(g) AS largest_win, min(g) AS largest_loss, min(e - pk) AS max_dd_dollars, min(CASE WHEN pk > 0 THEN (e - pk) / pk * 100 ELSE 0 END) AS max_dd_pct, max(pk) AS max_peak,
count(*) FILTER (c > 0) AS total_trades, coalesce(avg((g > 0)::INT) FILTER (c > 0), 0) AS win_rate, count(*) FILTER (c <= 0) AS skipped, 0.0::DOUBLE AS cost_drag, coalesce(avg(g) / nullif(stddev_samp(g), 0) * sqrt(count(DISTINCT day)), 0) AS sharpe_trade, coalesce(sum(g) FILTER (c > 0 AND g > 0), 0) AS w, coalesce(-sum(g) FILTER (c > 0 AND g < 0), 0) AS l FROM p GROUP BY run_id),
b AS (SELECT a.*, coalesce(dy.m / nullif(dy.s, 0) * sqrt(252.0::DOUBLE), 0) AS sharpe_daily, CASE WHEN l > 0 THEN w / l WHEN w > 0 THEN 'Infinity'::DOUBLE ELSE 0 END AS profit_factor, CASE WHEN max_dd_dollars < 0 THEN total / abs(max_dd_dollars) ELSE 'Infinity'::DOUBLE END AS calmar FROM a JOIN dy USING (run_id))
SELECT run_id, total_trades::BIGINT AS total_trades, skipped::BIGINT AS skipped, {", ".join(f"round({c}, 4) AS {c}" for c in columns)} FROM b"""


def _dollars(sized: DataFrame) -> DataFrame:
    m = report.dollar_metrics(sized, ["run_id"], ["exit_time", "trade_id"])
    return m.withColumns({c: F.round(c, 4) for c, kind in m.dtypes if kind == "double"})


@query(_dollars_sql("SELECT run_id, r, coalesce(greatest(p - (1 - p) / (w / r), 0) * 0.25::DOUBLE, 0) AS share FROM (SELECT run_id, count(*) FILTER (ticks > 0)::DOUBLE / count(*) AS p, avg(ticks) FILTER (ticks > 0) AS w, -avg(ticks) FILTER (ticks < 0) AS r FROM o GROUP BY run_id)", "coalesce(greatest(round(floor(z.eq * fa.share / (fa.r * 12.5::DOUBLE) / 0.1::DOUBLE) * 0.1::DOUBLE, 1), 0), 0)"))
def kelly_sizing(spark: SparkSession, d: str) -> DataFrame:
    return _dollars(_sized(spark, d, folds.kelly_rule()))


@query(_dollars_sql("SELECT run_id, arg_min(ticks / pnl_points, n) FILTER (pnl_points <> 0) AS pp FROM o GROUP BY run_id", "CASE WHEN abs(o.entry_price - o.sl) * fa.pp * 12.5::DOUBLE > 0 THEN round(floor(z.eq * 0.01::DOUBLE / (abs(o.entry_price - o.sl) * fa.pp * 12.5::DOUBLE) / 0.1::DOUBLE) * 0.1::DOUBLE, 1) ELSE 0 END"))
def risk_sizing(spark: SparkSession, d: str) -> DataFrame:
    return _dollars(_sized(spark, d, folds.risk_rule()))


@query(f"""WITH {T}, s AS (SELECT *, ticks * 12.5 * 1.5 AS g, (1 * 2.25 + 5 * 0.62) * 2 AS cm, (CASE WHEN ticks < 0 THEN 2 ELSE 1 END) * 12.5 * 1.5 AS sl2 FROM tr WHERE exit_time IS NOT NULL)
SELECT trade_id, round(cm, 6)::DOUBLE AS commission, round(sl2, 6)::DOUBLE AS slippage, round(100000 + sum(g) OVER w, 4) AS equity_gross, round(100000 + sum(g - cm) OVER w, 4) AS equity_commission, round(100000 + sum(g - sl2) OVER w, 4) AS equity_slippage, round(100000 + sum(g - cm - sl2) OVER w, 4) AS equity_net
FROM s WINDOW w AS (PARTITION BY run_id ORDER BY exit_time, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def equity_four_curves(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d).where("exit_time IS NOT NULL").withColumns({"contracts": F.lit(1.5), "trade_pnl": F.col("ticks") * 12.5 * 1.5})
    c = report.with_costs(t, ["run_id"], ["exit_time", "trade_id"], 100_000.0, 1, 12.5, 2.25, 0.62)
    return c.select("trade_id", F.round("commission", 6).alias("commission"), F.round("slippage", 6).alias("slippage"), *[F.round(x, 4).alias(x) for x in ("equity_gross", "equity_commission", "equity_slippage", "equity_net")])


@query(f"""WITH {T}, n AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY trade_id) - 1 AS k, count(*) OVER (PARTITION BY run_id) AS c, ticks * 12.5 AS p FROM tr), r AS (SELECT DISTINCT run_id, c FROM n),
g AS (SELECT run_id, path, step, (((((path * 7919 + step * 104729 + 11) % 2147483647) * 48271 + 11) % 2147483647 * 48271 + 7) % 2147483647) % c AS k FROM range(400) a(path), range(1, 51) b(step), r),
e AS (SELECT run_id, path, step, sum(p) OVER (PARTITION BY run_id, path ORDER BY step) + 100000 AS q FROM g JOIN n USING (run_id, k))
SELECT run_id, step::INT AS step, unnest([5.0, 50.0, 95.0])::DOUBLE AS percentile, round(unnest([quantile_cont(q, 0.05), quantile_cont(q, 0.5), quantile_cont(q, 0.95)]), 4) AS equity FROM e GROUP BY run_id, step""")
def mc_percentile_bands_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Percentile bands of the bootstrapped equity of every run."""
    t = _trades(spark, d).select("run_id", "trade_id", (F.col("ticks") * 12.5).alias("p"))
    return simulate.fixed_by_run(t, ["run_id"], ["trade_id"], "p", 400, 50, 11, 100_000.0, [5.0, 50.0, 95.0]).withColumn("equity", F.round("equity", 4))


@query()
def mc_kelly_paths(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d).select("run_id", "exit_time", "trade_id", "ticks")
    paths = simulate.sized_by_run(t, ["run_id"], ["exit_time", "trade_id"], "ticks", lambda e, i: (e * 0.0001 / 1.25).round(1), 400, 60, 100_000.0, 12.5, 7)
    return simulate.final_statistics(paths, ["run_id"], 100_000.0, 0.5)


@query()
def mc_stopped_paths(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d).select("run_id", "exit_time", "trade_id", (F.col("ticks") * 12.5).alias("p"))
    return simulate.outcome_rates(simulate.stopped_by_run(t, ["run_id"], ["exit_time", "trade_id"], "p", 1000, 120, 50_000.0, 7, 3000.0, 2000.0, 2500.0, 0.5), ["run_id"])


@query(f"""WITH {T}, {B}, st AS (SELECT symbol AS asset, day, arg_max("close", minute) - arg_min(open, minute) AS x FROM bars GROUP BY ALL), dl AS (SELECT asset, day, sum(ticks) AS y FROM tr GROUP BY ALL), p AS (SELECT * FROM st JOIN dl USING (asset, day))
SELECT asset, count(*)::BIGINT AS n, round(regr_slope(y, x), 6) AS beta, round(regr_intercept(y, x), 4) AS alpha, round(regr_r2(y, x), 6) AS r2 FROM p GROUP BY asset HAVING count(*) >= 3 AND var_pop(x) > 0""")
def alpha_beta(spark: SparkSession, d: str) -> DataFrame:
    s = bars.session_statistics(_bars(spark, d), ["symbol", "day"], "minute", F.col("rth")).select(F.col("symbol").alias("asset"), "day", (F.col("globex_close") - F.col("globex_open")).alias("x"))
    y = _trades(spark, d).groupBy("asset", "day").agg(F.sum("ticks").alias("y"))
    e = report.exposure(s.join(y, ["asset", "day"]), ["asset"], "day")
    return e.select("asset", "n", F.round("beta", 6).alias("beta"), F.round("alpha", 4).alias("alpha"), F.round("r2", 6).alias("r2"))


@query("""WITH a AS (SELECT DISTINCT session_date AS d FROM options_5m_contracts), b AS (SELECT DISTINCT snapshot_time::DATE AS d FROM options_oi_snapshot), u AS (SELECT d, 'both' AS part FROM (SELECT d FROM a INTERSECT SELECT d FROM b) UNION ALL SELECT d, 'first only' FROM (SELECT d FROM a EXCEPT SELECT d FROM b) UNION ALL SELECT d, 'second only' FROM (SELECT d FROM b EXCEPT SELECT d FROM a))
SELECT strftime(d, '%Y-%m-%d') AS day, part FROM u""")
def set_algebra_dates(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "options_5m_contracts").select(F.col("session_date").alias("d")).distinct()
    b = table(spark, d, "options_oi_snapshot").select(F.to_date("snapshot_time").alias("d")).distinct()
    parts = [(a.intersect(b), "both"), (a.subtract(b), "first only"), (b.subtract(a), "second only")]
    out = [x.select(_day("d").alias("day"), F.lit(n).alias("part")) for x, n in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH {B}, h AS (SELECT symbol, day, sum(volume) AS v, max(high) - min(low) AS w FROM bars GROUP BY ALL), r AS (SELECT symbol, v, w, rank() OVER (PARTITION BY symbol ORDER BY v) + (count(*) OVER (PARTITION BY symbol, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY symbol ORDER BY w) + (count(*) OVER (PARTITION BY symbol, w) - 1) / 2.0 AS rw FROM h)
SELECT symbol, count(*)::BIGINT AS n, round(corr(rv, rw), 6) AS rho FROM r GROUP BY symbol HAVING var_pop(rv) > 0 AND var_pop(rw) > 0""")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    h = _bars(spark, d).groupBy("symbol", "day").agg(F.sum("volume").alias("v"), (F.max("high") - F.min("low")).alias("w"))
    mean_rank = lambda c: F.rank().over(Window.partitionBy("symbol").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("symbol", c)) - 1) / 2.0
    r = h.withColumns({"rv": mean_rank("v"), "rw": mean_rank("w")}).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("rv", "rw").alias("c"), F.var_pop("rv").alias("a"), F.var_pop("rw").alias("b")).where("a > 0 AND b > 0")
    return r.select("symbol", "n", F.round(F.col("c") / F.sqrt(F.col("a") * F.col("b")), 6).alias("rho"))


@query("""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session_date, seq ORDER BY ts_recv DESC) AS n FROM order_feed) WHERE n = 1),
l AS (SELECT *, sum((action = 'R')::INT) OVER w AS life, max(floor(epoch_us(ts) / 1000000)) OVER w AS sec FROM f WINDOW w AS (PARTITION BY symbol, session_date ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT *, sum((action IN ('A', 'M'))::INT) OVER (PARTITION BY symbol, session_date, life, order_id ORDER BY seq) AS epoch FROM l WHERE action IN ('A', 'M', 'C', 'F') AND order_id IS NOT NULL),
x AS (SELECT *, first_value(upper(side)) OVER w AS o_side, first_value(px) OVER w AS o_px, greatest(first_value(sz) OVER w - sum(CASE WHEN action IN ('C', 'F') THEN sz ELSE 0 END) OVER w, 0) AS lft
FROM o WHERE epoch > 0 WINDOW w AS (PARTITION BY symbol, session_date, life, order_id, epoch ORDER BY seq)),
y AS (SELECT *, lft - coalesce(lag(lft) OVER (PARTITION BY symbol, session_date, life, order_id, epoch ORDER BY seq), 0) AS delta, lag(o_side) OVER w AS p_side, lag(o_px) OVER w AS p_px, lag(lft) OVER w AS p_lft FROM x WINDOW w AS (PARTITION BY symbol, session_date, life, order_id ORDER BY seq)),
c AS (SELECT symbol, session_date, life, sec, o_side AS side, o_px AS px, delta FROM y WHERE delta <> 0 UNION ALL SELECT symbol, session_date, life, sec, p_side, p_px, -p_lft FROM y WHERE action IN ('A', 'M') AND p_lft > 0),
p AS (SELECT symbol, session_date, life, sec, side, px, sum(delta) AS delta FROM c GROUP BY ALL)
SELECT symbol, strftime(session_date, '%Y-%m-%d') AS session_date, life::BIGINT AS life, sec::BIGINT AS sec, side, px, (sum(delta) OVER (PARTITION BY symbol, session_date, life, side, px ORDER BY sec))::BIGINT AS size FROM p""")
def book_depth_by_second(spark: SparkSession, d: str) -> DataFrame:
    return book.depth_by_second(_changes(spark, d)).withColumn("session_date", _day("session_date"))


def _resting(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "order_feed").withColumn("side", F.upper("side"))
    return changes.current_state(feed, changes.order_feed(feed))


_REST = core_queries.SQL["p1_found"].replace("SELECT s.order_id, s.side, s.px,", ", rest AS (SELECT s.symbol, s.session_date, s.side, s.px,") + ")"
_DEPTH = _REST + ", lv AS (SELECT symbol, session_date, side, px / 1e9 AS price, sum(sz)::BIGINT AS size, count(*)::BIGINT AS orders FROM rest GROUP BY symbol, session_date, side, px)"


@query(_DEPTH + " SELECT symbol, strftime(session_date, '%Y-%m-%d') AS session_date, side, price, size, orders FROM lv")
def book_final_depth(spark: SparkSession, d: str) -> DataFrame:
    return book.final_depth(_resting(spark, d)).withColumn("session_date", _day("session_date"))


@query(_DEPTH + """, q AS (SELECT symbol, session_date, max(price) FILTER (side = 'B') AS bb, min(price) FILTER (side = 'A') AS ba FROM lv GROUP BY ALL),
n AS (SELECT lv.*, price >= coalesce(bb, ba) - 10 AND price <= coalesce(ba, bb) + 10 AS near FROM lv JOIN q USING (symbol, session_date)), b AS (SELECT symbol, session_date, side, quantile_cont(size, 0.5) * 3 AS least FROM n WHERE near GROUP BY ALL)
SELECT symbol, strftime(session_date, '%Y-%m-%d') AS session_date, side, price, size, orders, near FROM n LEFT JOIN b USING (symbol, session_date, side) WHERE near OR size >= least""")
def book_cropped(spark: SparkSession, d: str) -> DataFrame:
    return book.cropped(book.final_depth(_resting(spark, d)), 40, 0.25, 3.0).withColumn("session_date", _day("session_date"))


@query("""SELECT n_name AS nation, r_name AS region, count(*)::BIGINT AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "customers")


@query()
def value_areas(spark: SparkSession, d: str) -> DataFrame:
    levels = _changes(spark, d).where("action = 'T'").select("symbol", _day("session_date").alias("day"), (F.col("px") / 1e9).alias("price"), F.col("sz").alias("volume"))
    return profile.profiles(levels, ["symbol", "day"])


@query(f"""WITH {T} SELECT asset, count(*)::BIGINT AS trades, sum(ticks) AS total_ticks FROM tr WHERE direction = 'long' AND exit_reason IN ('target', 'stop') GROUP BY asset""")
def filter_chain(spark: SparkSession, d: str) -> DataFrame:
    return _trades(spark, d).where("direction = 'long'").where(F.col("exit_reason").isin("target", "stop")).groupBy("asset").agg(F.count(F.lit(1)).alias("trades"), F.sum("ticks").alias("total_ticks"))


@query(f"""WITH {B}, x AS (SELECT *, "close" - lag("close") OVER w AS dc FROM bars WINDOW w AS (PARTITION BY symbol, day ORDER BY minute))
SELECT symbol, epoch(minute)::BIGINT AS minute, sum(CASE WHEN dc > 0 THEN volume WHEN dc < 0 THEN -volume ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cvd FROM x""")
def cumulative_delta(spark: SparkSession, d: str) -> DataFrame:
    dc = F.col("close") - F.lag("close").over(Window.partitionBy("symbol", "day").orderBy("minute"))
    x = _bars(spark, d).withColumns({"buy_volume": F.when(dc > 0, F.col("volume")).otherwise(0), "sell_volume": F.when(dc < 0, F.col("volume")).otherwise(0)})
    return indicators.cumulative_delta(x, ["symbol", "day"], "minute").select("symbol", _sec("minute").alias("minute"), "cvd")


@query(f"""WITH {T} SELECT run_id, strftime(day, '%Y-%m-%d') AS day, sum(ticks) AS ticks, isodow(day)::INT AS weekday FROM tr GROUP BY ALL""")
def daily_totals(spark: SparkSession, d: str) -> DataFrame:
    return _trades(spark, d).groupBy("run_id", "day").agg(F.sum("ticks").alias("ticks")).select("run_id", _day("day").alias("day"), "ticks", (F.weekday("day") + 1).alias("weekday"))


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity)::DOUBLE AS quantity, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.sum("l_quantity").cast("double").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PRINT}, b AS (SELECT instrument_id, time_bucket(INTERVAL 5 MINUTE, ts_event::TIMESTAMP) AS bk, sum(-ag * size) AS f FROM pr GROUP BY ALL)
SELECT instrument_id, epoch(bk)::BIGINT AS bucket, sum(f) OVER (PARTITION BY instrument_id, (bk + INTERVAL 2 HOUR)::DATE ORDER BY bk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session_flow FROM b""")
def dealer_flow(spark: SparkSession, d: str) -> DataFrame:
    return options.five_minute(options.classified(table(spark, d, "option_trades"))).select("instrument_id", _sec("bucket").alias("bucket"), "session_flow")


@query(f"""WITH {_PRINT} SELECT print_id, size::INT AS size, (hour(ts_event::TIMESTAMP) * 60 + minute(ts_event::TIMESTAMP)) BETWEEN 870 AND 1260 AS rth FROM pr WHERE CASE WHEN (hour(ts_event::TIMESTAMP) * 60 + minute(ts_event::TIMESTAMP)) BETWEEN 870 AND 1260 THEN size >= 10 ELSE size >= 5 END""")
def large_prints(spark: SparkSession, d: str) -> DataFrame:
    p = options.classified(table(spark, d, "option_trades")).withColumn("rth", in_window(F.col("ts_event"), *RTH))
    return bars.large_prints(p, "size", F.col("rth"), 10, 5).select("print_id", "size", "rth")


@query("""SELECT underlying, arg_max(multiplier, struct_pack(n := n, m := -multiplier))::INT AS multiplier FROM (SELECT underlying, multiplier, count(*) AS n FROM options_oi_snapshot WHERE multiplier <> 0 GROUP BY ALL) GROUP BY underlying""")
def modal_multiplier(spark: SparkSession, d: str) -> DataFrame:
    return options.modal_multiplier(table(spark, d, "options_oi_snapshot"))


@query("""WITH n AS (SELECT max(snapshot_time) AS now FROM options_oi_snapshot), e AS (SELECT instrument_id, max(expiry) AS expiry FROM options_5m_contracts WHERE expiry IS NOT NULL GROUP BY ALL)
SELECT instrument_id, epoch(expiry)::BIGINT AS expiry, -1 AS open_interest FROM e, n WHERE expiry <= now AND instrument_id IN (SELECT instrument_id FROM options_oi_snapshot)""")
def expiry_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return options.tombstones(table(spark, d, "options_oi_snapshot"), table(spark, d, "options_5m_contracts")).withColumn("expiry", _sec("expiry"))


@query(f"""WITH {T}, {B}, st AS (SELECT symbol AS asset, day, arg_max("close", minute) - arg_min(open, minute) AS x FROM bars GROUP BY ALL), dl AS (SELECT asset, day, sum(ticks) AS y FROM tr GROUP BY ALL), p AS (SELECT * FROM st JOIN dl USING (asset, day)),
f AS (SELECT asset, count(*) AS n, avg(x) AS mx, var_pop(x) AS vx, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, regr_r2(y, x) AS r2 FROM p GROUP BY asset HAVING count(*) >= 3 AND var_pop(x) > 0),
r AS (SELECT *, y - alpha - beta * x AS u FROM p JOIN f USING (asset)), l AS (SELECT *, lag(u, 1) OVER w AS u1, lag(u * x, 1) OVER w AS v1, lag(u, 2) OVER w AS u2, lag(u * x, 2) OVER w AS v2, lag(u, 3) OVER w AS u3, lag(u * x, 3) OVER w AS v3, lag(u, 4) OVER w AS u4, lag(u * x, 4) OVER w AS v4, lag(u, 5) OVER w AS u5, lag(u * x, 5) OVER w AS v5 FROM r WINDOW w AS (PARTITION BY asset ORDER BY day)),
m AS (SELECT asset, sum((u) * (u)) + 0.8333333333333334 * coalesce(sum((u) * u1 + u1 * (u)), 0) + 0.6666666666666667 * coalesce(sum((u) * u2 + u2 * (u)), 0) + 0.5 * coalesce(sum((u) * u3 + u3 * (u)), 0) + 0.33333333333333337 * coalesce(sum((u) * u4 + u4 * (u)), 0) + 0.16666666666666663 * coalesce(sum((u) * u5 + u5 * (u)), 0) AS m00, sum((u) * (u * x)) + 0.8333333333333334 * coalesce(sum((u) * v1 + u1 * (u * x)), 0) + 0.6666666666666667 * coalesce(sum((u) * v2 + u2 * (u * x)), 0) + 0.5 * coalesce(sum((u) * v3 + u3 * (u * x)), 0) + 0.33333333333333337 * coalesce(sum((u) * v4 + u4 * (u * x)), 0) + 0.16666666666666663 * coalesce(sum((u) * v5 + u5 * (u * x)), 0) AS m01, sum((u * x) * (u)) + 0.8333333333333334 * coalesce(sum((u * x) * u1 + v1 * (u)), 0) + 0.6666666666666667 * coalesce(sum((u * x) * u2 + v2 * (u)), 0) + 0.5 * coalesce(sum((u * x) * u3 + v3 * (u)), 0) + 0.33333333333333337 * coalesce(sum((u * x) * u4 + v4 * (u)), 0) + 0.16666666666666663 * coalesce(sum((u * x) * u5 + v5 * (u)), 0) AS m10, sum((u * x) * (u * x)) + 0.8333333333333334 * coalesce(sum((u * x) * v1 + v1 * (u * x)), 0) + 0.6666666666666667 * coalesce(sum((u * x) * v2 + v2 * (u * x)), 0) + 0.5 * coalesce(sum((u * x) * v3 + v3 * (u * x)), 0) + 0.33333333333333337 * coalesce(sum((u * x) * v4 + v4 * (u * x)), 0) + 0.16666666666666663 * coalesce(sum((u * x) * v5 + v5 * (u * x)), 0) AS m11 FROM l GROUP BY asset),
b AS (SELECT *, (vx + mx * mx) / (n * vx) AS a, -mx / (n * vx) AS b, 1.0::DOUBLE / (n * vx) AS c FROM f JOIN m USING (asset))
SELECT asset, n::BIGINT AS n, round(beta, 6) AS beta, round(alpha, 4) AS alpha, round(r2, 6) AS r2, round(alpha / sqrt(greatest(a * a * m00 + a * b * (m01 + m10) + b * b * m11, 0)), 4) AS t_alpha, round(beta / sqrt(greatest(b * b * m00 + b * c * (m01 + m10) + c * c * m11, 0)), 4) AS t_beta FROM b""")
def exposure_hac(spark: SparkSession, d: str) -> DataFrame:
    s = bars.session_statistics(_bars(spark, d), ["symbol", "day"], "minute", F.col("rth")).select(F.col("symbol").alias("asset"), "day", (F.col("globex_close") - F.col("globex_open")).alias("x"))
    y = _trades(spark, d).groupBy("asset", "day").agg(F.sum("ticks").alias("y"))
    e = report.exposure(s.join(y, ["asset", "day"]), ["asset"], "day")
    return e.select("asset", "n", F.round("beta", 6).alias("beta"), F.round("alpha", 4).alias("alpha"), F.round("r2", 6).alias("r2"), F.round("t_alpha", 4).alias("t_alpha"), F.round("t_beta", 4).alias("t_beta"))


@query()
def combined_selection(spark: SparkSession, d: str) -> DataFrame:
    """Greedy choice of assets whose trades, taken together, gain most without overlap."""
    t = _trades(spark, d).where("entry_time IS NOT NULL AND exit_time IS NOT NULL AND asset IS NOT NULL")
    t = kept(t.select(F.col("asset").cast("string").alias("vid"), "entry_time", "exit_time", "trade_id", "ticks", "day"))
    ids = [r.vid for r in t.select("vid").distinct().orderBy("vid").collect()]  # as many as assets
    by: dict = {}
    totals = None
    if t.count() <= combine.MOST_ROWS:
        for r in t.select("vid", F.unix_micros("entry_time").alias("e"), F.unix_micros("exit_time").alias("x"), "trade_id", "ticks").collect():
            by.setdefault(r.vid, []).append((r.e, r.x, r.trade_id, r.ticks))
    else:
        totals = combine.spark_totals(t, ids, "entry_time", "exit_time", ["trade_id"], "ticks")
    pairs = {(r.a, r.b): r["corr"] for r in report.correlations(t, "vid", "day", "ticks").collect()}
    corr = np.array([[1.0 if a == b else pairs.get((min(a, b), max(a, b)), 0.0) for b in ids] for a in ids])
    path = combine.choose([combine.Variant(i, "", sorted(by.get(i, []))) for i in ids], corr, 50.0, 8, 2, totals=totals)
    return spark.createDataFrame([(p["k"], p["stage"], ",".join(sorted(p["members"])), p["total"]) for p in path], "k int, stage string, members string, total double")


@query()
def mc_regime_switching(spark: SparkSession, d: str) -> DataFrame:
    """Bands of every run and asset, its days following the chain of the asset."""
    states = ["down", "flat", "up"]
    f = _snapshots(spark, d).groupBy("asset", "day").agg(F.max_by("state", "ts").alias("state"))
    steps = report.transitions(f, ["asset"], "day", "state").groupBy("asset")
    steps = steps.agg(*[F.max(F.when((F.col("previous") == a) & (F.col("state") == b), F.col("probability"))).alias(f"step_{x}_{y}") for x, a in enumerate(states) for y, b in enumerate(states)])
    chain = f.groupBy("asset").agg(*[F.count_if(F.col("state") == a).alias(f"start_{x}") for x, a in enumerate(states)]).join(steps, "asset", "left")
    t = _trades(spark, d).select("run_id", "trade_id", "asset", "day", "entry_time", (F.col("ticks") * 12.5).alias("p"))
    labels = joins.regime_labels(t, _snapshots(spark, d), "final", date="day", asset=["asset"]).select("run_id", "asset", "trade_id", "p", "regime")
    return simulate.switching_by_run(labels.join(chain, "asset", "left"), ["run_id", "asset"], ["trade_id"], "p", "regime", states, 400, 60, 100_000.0, 7, [5.0, 50.0, 95.0])


@query()
def inverse_gap_trades(spark: SparkSession, d: str) -> DataFrame:
    t = patterns.inverse_gap_trades(_bars(spark, d).drop("rth"), ["symbol", "day"], 5)
    return t.withColumns({"day": _day("day"), "entry_minute": _sec("entry_minute"), "exit_minute": _sec("exit_minute")})


@query(f"""WITH {B}, r AS (SELECT *, min(minute) OVER d AS s, row_number() OVER (PARTITION BY symbol, day ORDER BY minute) AS pos FROM bars WINDOW d AS (PARTITION BY symbol, day)),
g AS (SELECT *, max(high) FILTER (minute < s + INTERVAL 30 MINUTE) OVER d AS hi, min(low) FILTER (minute < s + INTERVAL 30 MINUTE) OVER d AS lo FROM r WINDOW d AS (PARTITION BY symbol, day)),
k AS (SELECT *, min(CASE WHEN minute >= s + INTERVAL 30 MINUTE AND "close" > hi THEN pos END) OVER d AS u, min(CASE WHEN minute >= s + INTERVAL 30 MINUTE AND "close" < lo THEN pos END) OVER d AS dn FROM g WINDOW d AS (PARTITION BY symbol, day)),
m AS (SELECT *, u IS NOT NULL AND (dn IS NULL OR u <= dn) AS lg, least(u, dn) AS ap FROM k WHERE least(u, dn) IS NOT NULL)
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, CASE WHEN lg THEN 'long' ELSE 'short' END AS direction, epoch(min(minute) FILTER (pos = ap))::BIGINT AS breakout,
epoch(min(minute) FILTER (pos > ap AND pos <= ap + 60 AND CASE WHEN lg THEN low <= hi ELSE high >= lo END))::BIGINT AS retest FROM m GROUP BY symbol, day, lg""")
def breakout_retest(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol", "day")
    b = _bars(spark, d).withColumn("s", F.min("minute").over(w))
    early = F.col("minute") < F.col("s") + F.expr("INTERVAL 30 MINUTES")
    b = b.withColumns({"hi": F.max(F.when(early, F.col("high"))).over(w), "lo": F.min(F.when(early, F.col("low"))).over(w)})
    t = patterns.breakout_retest(b, ["symbol", "day"], F.col("hi"), F.col("lo"), F.col("s") + F.expr("INTERVAL 30 MINUTES"), F.col("hi"), F.col("lo"))
    return t.select("symbol", _day("day").alias("day"), "direction", _sec("breakout").alias("breakout"), _sec("retest").alias("retest"))
