"""Queries of settlements, option chains and regime detectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.calendar import in_window, local, minute_of_day, session_start, trade_date
from quantloom.operators import bars, book, chain, detectors, joins, options, pool, report, settlement
from quantloom.plans import market_queries
from quantloom.plans.market_queries import _PRINT, _RET, SQL, B, T, _bars, _changes, _day, _sec, _trades, query
from quantloom.session import table

_OPEN = """ok AS (SELECT *, snapshot_time::DATE AS session, lower(trim(snapshot_type)) AS kind FROM options_oi_snapshot WHERE instrument_id IS NOT NULL AND lower(trim(snapshot_type)) IN ('evening', 'morning') AND (expiry IS NULL OR snapshot_time <= expiry) AND arrived_at::TIMESTAMP < (snapshot_time::DATE + 8)::TIMESTAMP)"""


@query(f"""WITH {_OPEN}, l AS (SELECT instrument_id, session, kind, arg_max(open_interest, struct_pack(a := snapshot_time, b := snapshot_id, c := open_interest)) AS oi FROM ok WHERE open_interest IS NOT NULL GROUP BY ALL),
s AS (SELECT instrument_id, session, max(struct_pack(f := coalesce(settlement_is_final, false), t := snapshot_time, p := settlement_price)) AS x FROM ok WHERE settlement_price IS NOT NULL AND settlement_price::VARCHAR <> 'nan' GROUP BY ALL)
SELECT instrument_id, strftime(session, '%Y-%m-%d') AS session, kind, oi AS open_interest, x.p AS settlement_price, x.f AS is_final FROM l LEFT JOIN s USING (instrument_id, session)""")
def interest_with_settlement(spark: SparkSession, d: str) -> DataFrame:
    return settlement.interest_with_settlement(table(spark, d, "options_oi_snapshot")).withColumn("session", _day("session"))


@query("""WITH st AS (SELECT DISTINCT underlying, snapshot_time::DATE AS session FROM options_oi_snapshot WHERE settlement_is_final AND underlying IS NOT NULL), p AS (SELECT snapshot_id, underlying, min(snapshot_time::DATE) AS day FROM options_oi_snapshot WHERE underlying IS NOT NULL AND snapshot_time IS NOT NULL GROUP BY ALL)
SELECT snapshot_id, strftime(max(session), '%Y-%m-%d') AS session FROM p LEFT JOIN st ON p.underlying = st.underlying AND st.session < p.day GROUP BY snapshot_id, p.underlying""")
def reference_sessions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "options_oi_snapshot").where("underlying IS NOT NULL AND snapshot_time IS NOT NULL").withColumn("day", F.to_date("snapshot_time"))
    settled = t.where("settlement_is_final").select("underlying", F.col("day").alias("session")).distinct()
    pubs = t.groupBy("snapshot_id", "underlying").agg(F.min("day").alias("day"))
    return settlement.reference_sessions(pubs, settled, ["underlying"], "day").select("snapshot_id", _day("session").alias("session"))


_CHAIN = f"""WITH {_PRINT}, ex AS (SELECT instrument_id AS i, max(expiry)::TIMESTAMP AS x FROM options_5m_contracts WHERE expiry IS NOT NULL AND instrument_id IS NOT NULL GROUP BY ALL),
al AS (SELECT instrument_id AS i, print_id, ts_event::TIMESTAMP AS t, time_bucket(INTERVAL 5 MINUTE, ts_event::TIMESTAMP) AS b, price, size, ag, bid_px, ask_px, coalesce(upper(side) = 'N', false) AS leg FROM pr LEFT JOIN ex ON instrument_id = i WHERE x IS NULL OR ts_event::TIMESTAMP <= x),
g AS (SELECT i, b, arg_min(price, struct_pack(a := t, p := print_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, struct_pack(a := t, p := print_id)) AS close, sum(size) AS volume, sum(CASE WHEN ag > 0 THEN size ELSE 0 END) AS buy_volume, sum(CASE WHEN ag < 0 THEN size ELSE 0 END) AS sell_volume,
  arg_max(struct_pack(bid := bid_px, ask := ask_px), struct_pack(a := t, p := print_id)) AS q, sum(-ag * size) AS flow FROM al WHERE NOT leg GROUP BY i, b),
l AS (SELECT i, b, sum(size) AS sv, sum(CASE WHEN ag > 0 THEN size ELSE 0 END) AS sb, sum(CASE WHEN ag < 0 THEN size ELSE 0 END) AS ss, sum(-ag * size) AS sf FROM al WHERE leg GROUP BY i, b),
pu AS (SELECT instrument_id AS i, (snapshot_time::TIMESTAMP + INTERVAL 2 HOUR)::DATE AS session, lower(trim(snapshot_type)) AS kind, max(struct_pack(t := snapshot_time::TIMESTAMP, id := snapshot_id, oi := open_interest::BIGINT)) AS m FROM options_oi_snapshot
  WHERE instrument_id IS NOT NULL AND open_interest IS NOT NULL AND lower(trim(snapshot_type)) IN ('evening', 'morning') GROUP BY ALL),
pb AS (SELECT pu.i, session, kind, m.t AS t, m.oi AS oi, time_bucket(INTERVAL 5 MINUTE, m.t) AS b, x FROM pu LEFT JOIN ex ON pu.i = ex.i WHERE x IS NULL OR m.t <= x),
en AS (SELECT greatest((SELECT max(ts_event) FROM option_trades), (SELECT max(snapshot_time) FROM options_oi_snapshot))::TIMESTAMP AS e),
ks AS (SELECT i, b, 0 AS k FROM g UNION ALL SELECT i, b, 1 FROM pb WHERE x IS NULL OR b < x UNION ALL SELECT i, b, 2 FROM l UNION ALL SELECT i, time_bucket(INTERVAL 5 MINUTE, x + INTERVAL 1 SECOND), 3 FROM ex, en WHERE x <= e),
ke AS (SELECT i, b, min(k) AS k FROM ks GROUP BY i, b),
r AS (SELECT i, b, k, (b + INTERVAL 2 HOUR)::DATE AS session, g.* EXCLUDE (i, b), sv, sb, ss, coalesce(flow, 0) AS fl, coalesce(sf, 0) AS sfl FROM (SELECT * FROM ke QUALIFY k < 3 OR lag(b) OVER (PARTITION BY i ORDER BY b) IS NOT NULL) LEFT JOIN g USING (i, b) LEFT JOIN l USING (i, b)),
w AS (SELECT *, sum(fl) OVER u AS cf, sum(sfl) OVER u AS csf, -sum(fl + sfl) OVER (PARTITION BY i, session ORDER BY b) AS net, last_value(q IGNORE NULLS) OVER (PARTITION BY i ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qq FROM r WINDOW u AS (PARTITION BY i ORDER BY b)),
se AS (SELECT session, row_number() OVER (ORDER BY session) AS nth FROM (SELECT DISTINCT session FROM r)), tt AS (SELECT i, nth, session, -sum(fl + sfl) AS nt FROM r JOIN se USING (session) GROUP BY ALL),
o AS (SELECT w.*, (SELECT max(struct_pack(t := pb.t, k := pb.kind, s := pb.session, oi := pb.oi)) FROM pb WHERE pb.i = w.i AND pb.t < w.b + INTERVAL 5 MINUTE) AS p, EXISTS (SELECT 1 FROM pb WHERE pb.i = w.i AND pb.session = w.session AND pb.kind = 'evening' AND pb.t < w.b + INTERVAL 5 MINUTE) AS landed,
  (SELECT nt FROM tt JOIN se s2 ON s2.session = w.session WHERE tt.i = w.i AND tt.nth = s2.nth - 1) AS nb FROM w)
SELECT i AS instrument_id, epoch(b)::BIGINT AS bucket, CASE k WHEN 0 THEN 'traded' WHEN 1 THEN 'interest' WHEN 2 THEN 'spread' ELSE 'expired' END AS kind, open, high, low, close, coalesce(volume, 0)::BIGINT AS volume, coalesce(buy_volume, 0)::BIGINT AS buy_volume, coalesce(sell_volume, 0)::BIGINT AS sell_volume,
coalesce(sv, 0)::BIGINT AS spread_volume, coalesce(sb, 0)::BIGINT AS spread_buy_volume, coalesce(ss, 0)::BIGINT AS spread_sell_volume, qq.bid AS bid, qq.ask AS ask, q IS NULL AS is_stale_quote, (CASE WHEN k = 3 THEN -1 ELSE p.oi END)::BIGINT AS open_interest,
k <> 3 AND coalesce(p.k = 'morning' AND p.s = session, false) AS is_morning_update, (CASE WHEN k = 3 THEN -1 ELSE p.oi + net + CASE WHEN landed THEN 0 ELSE coalesce(nb, 0) END END)::BIGINT AS daily_estimated_oi, cf::BIGINT AS dealer_oi_flow, csf::BIGINT AS dealer_oi_flow_spread FROM o"""


@query(_CHAIN)
def option_chain_rows(spark: SparkSession, d: str) -> DataFrame:
    """Prints without a stated side stand for legs of spreads, which the table does not name."""
    prints = options.classified(table(spark, d, "option_trades"))
    leg = F.coalesce(F.upper("side") == "N", F.lit(False))
    rows = chain.chain_rows(prints.where(~leg), table(spark, d, "options_oi_snapshot"), table(spark, d, "options_5m_contracts"), prints.where(leg))
    return rows.withColumns({"bucket": _sec("bucket"), "open_interest": F.col("open_interest").cast("long")})


def _z(out: str, src: str, by: list[str], value: str) -> str:
    """SQL of robust_z() by session number: by.., nth, v, ce, sc, z."""
    cols, same = ", ".join(f"a.{c}" for c in by), " AND ".join(f"a.{c} = b.{c}" for c in by)
    past = f"SELECT {cols}, a.nth, any_value(a.{value}) AS v, list(b.{value}) FILTER (b.{value} IS NOT NULL) AS past FROM {src} a LEFT JOIN {src} b ON {same} AND b.nth BETWEEN a.nth - 120 AND a.nth - 1 GROUP BY {cols}, a.nth"
    scaled = f"SELECT *, list_median(list_transform(past, lambda x: abs(x - ce))) * 1.4826 AS s0 FROM (SELECT *, list_median(past) AS ce FROM ({past}))"
    return f"{out} AS (SELECT * EXCLUDE (past, s0), CASE WHEN len(past) >= 2 AND s0 > 0 THEN s0 END AS sc, CASE WHEN len(past) >= 2 AND s0 > 0 THEN (v - ce) / s0 END AS z FROM ({scaled}))"


def _states(src: str, by: str, score: str, names: tuple[str, str, str] = detectors.STATES) -> str:
    """SQL of chained_states() over src (by, nth, clock, score): the CTEs up to st."""
    return f"""le AS (SELECT {by}, nth, arg_max({score} IS NOT NULL, clock) AS ended FROM {src} GROUP BY ALL), lr AS (SELECT *, NOT coalesce(lag(ended) OVER (PARTITION BY {by} ORDER BY nth), false) AS reset FROM le), lc AS (SELECT *, sum(reset::INT) OVER (PARTITION BY {by} ORDER BY nth) AS chain FROM lr),
hp AS (SELECT s.*, reset, chain, row_number() OVER w AS pos, CASE WHEN {score} > 1 THEN 1 WHEN {score} < -1 THEN -1 WHEN {score} < 0.5 AND {score} > -0.5 THEN 0 END AS code FROM {src} s JOIN lc USING ({by}, nth) WINDOW w AS (PARTITION BY s.{by}, chain ORDER BY s.nth, s.clock)),
hq AS (SELECT *, last_value(code IGNORE NULLS) OVER w AS c, max(CASE WHEN code IS NOT NULL THEN pos END) OVER w AS pc, max(CASE WHEN code IS NULL AND {score} >= 0.5 THEN pos END) OVER w AS pu, max(CASE WHEN code IS NULL AND {score} <= -0.5 THEN pos END) OVER w AS pd FROM hp WINDOW w AS (PARTITION BY {by}, chain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
st AS (SELECT *, CASE WHEN {score} IS NULL THEN 'unknown' WHEN c = 1 AND coalesce(pd < pc, true) THEN '{names[0]}' WHEN c = -1 AND coalesce(pu < pc, true) THEN '{names[2]}' ELSE '{names[1]}' END AS state FROM hq)"""


_SUMS = f"""{_RET}, k AS (SELECT symbol, day, minute, r, (hour(minute + INTERVAL 2 HOUR) * 60 + minute(minute + INTERVAL 2 HOUR)) AS clk FROM rt),
rs AS (SELECT symbol, day, minute, (floor(clk / 30) + 1)::INT * 30 AS clock, sum(coalesce(r * r, 0)) OVER w AS ss, count(r) OVER w AS n, sum(CASE WHEN clk >= 990 AND clk < 1380 THEN coalesce(r * r, 0) ELSE 0 END) OVER w AS rss, count(CASE WHEN clk >= 990 AND clk < 1380 THEN r END) OVER w AS rn,
  sum(CASE WHEN clk < 990 THEN coalesce(r * r, 0) ELSE 0 END) OVER w AS oss, count(CASE WHEN clk < 990 THEN r END) OVER w AS onn FROM k WINDOW w AS (PARTITION BY symbol, day ORDER BY minute)),
sc AS (SELECT symbol, day, clock, arg_max(ss, minute) AS ss, max(n) AS n, arg_max(rss, minute) AS rss, max(rn) AS rn, arg_max(oss, minute) AS oss, max(onn) AS onn FROM rs GROUP BY ALL),
sn AS (SELECT symbol, day, clock, n, rn, dense_rank() OVER (PARTITION BY symbol ORDER BY day) AS nth, CASE WHEN n > 0 AND ss > 0 THEN ln(sqrt(ss / n)) END AS lg, CASE WHEN rn > 0 AND rss > 0 THEN ln(sqrt(rss / rn)) END AS lr, CASE WHEN onn > 0 AND oss > 0 THEN ln(sqrt(oss / onn)) END AS lo FROM sc)"""


@query(f"""WITH {_SUMS}, da AS (SELECT symbol, nth, arg_max_null(lr, clock) AS ld, arg_max_null(lo, clock) AS lo FROM sn GROUP BY ALL),
fc AS (SELECT *, (avg(ld) OVER (PARTITION BY symbol ORDER BY nth RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) + avg(ld) OVER (PARTITION BY symbol ORDER BY nth RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) + avg(ld) OVER (PARTITION BY symbol ORDER BY nth RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)) / 3 AS f FROM da),
{_z("zd", "fc", ["symbol"], "ld")}, {_z("zo", "fc", ["symbol"], "lo")}, {_z("zg", "sn", ["symbol", "clock"], "lg")}, {_z("zr", "sn", ["symbol", "clock"], "lr")},
j AS (SELECT sn.*, zo.z AS z_on, zg.z AS z_gbx, zr.z AS z_rth, (f - zd.ce) / zd.sc AS zf FROM sn JOIN fc USING (symbol, nth) JOIN zd USING (symbol, nth) JOIN zo USING (symbol, nth) JOIN zg USING (symbol, clock, nth) JOIN zr USING (symbol, clock, nth)),
w AS (SELECT *, CASE WHEN z_on IS NOT NULL THEN 60.0::DOUBLE ELSE 0 END AS wo, CASE WHEN z_rth IS NOT NULL THEN rn::DOUBLE ELSE 0 END AS wr FROM j),
ob AS (SELECT *, CASE WHEN clock >= 990 THEN (coalesce(z_on, 0) * wo + coalesce(z_rth, 0) * wr) / nullif(wo + wr, 0) ELSE z_gbx END AS zob, CASE WHEN clock >= 990 THEN wo + wr WHEN z_gbx IS NOT NULL THEN n ELSE 0 END AS ev FROM w),
bl AS (SELECT *, CASE WHEN zob IS NOT NULL AND zf IS NOT NULL THEN ev / (ev + 30) * zob + (1 - ev / (ev + 30)) * zf ELSE coalesce(zob, zf) END AS vz, CASE WHEN zob IS NOT NULL AND zf IS NOT NULL THEN ev / (ev + 30) WHEN zob IS NOT NULL THEN 1 WHEN zf IS NOT NULL THEN 0 ELSE ev / (ev + 30) END AS bw FROM ob),
kn AS (SELECT *, CASE WHEN least(nth - 1, 120) >= 6 THEN vz END AS known FROM bl), {_states("kn", "symbol", "known")}
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, clock::INT AS clock, n::BIGINT AS n, round(vz, 4) AS vol_z, round(zob, 4) AS vol_z_obs, round(zf, 4) AS vol_z_fcst, round(bw, 6)::DOUBLE AS vol_blend_w, state AS vol_state, reset AS chain_reset FROM st""")
def vol_regime_days(spark: SparkSession, d: str) -> DataFrame:
    """Horizons of 1, 3 and 5 sessions and labels from the seventh session on, as the tables hold only weeks."""
    clock = minute_of_day(F.col("minute") + F.expr("INTERVAL 2 HOURS"))
    v = detectors.volatility(_bars(spark, d), ["symbol"], clock, 990, 1380, 30, 120, (1, 3, 5), 5, 60.0, 30.0)
    return v.withColumns({"day": _day("day"), **{c: F.round(c, 4) for c in ("vol_z", "vol_z_obs", "vol_z_fcst")}, "vol_blend_w": F.round("vol_blend_w", 6)})


_MEASURES = ("variance_ratio", "efficiency_ratio", "adf_closed_form")


@query(f"""WITH v AS ({SQL["variance_ratio"]}), e AS ({SQL["efficiency_ratio"]}), a AS ({SQL["adf_closed_form"]}),
m AS (SELECT symbol, day, 1440 AS clock, vr, er, adf_t, dense_rank() OVER (PARTITION BY symbol ORDER BY day) AS nth FROM (SELECT symbol, day, vr FROM v) FULL JOIN (SELECT symbol, day, er FROM e) USING (symbol, day) FULL JOIN (SELECT symbol, day, adf_t FROM a) USING (symbol, day)),
{_z("z1", "m", ["symbol", "clock"], "vr")}, {_z("z2", "m", ["symbol", "clock"], "er")}, {_z("z3", "m", ["symbol", "clock"], "adf_t")},
j AS (SELECT m.*, z1.z AS za, z2.z AS zb, z3.z AS zc, (z1.z IS NOT NULL)::INT + (z2.z IS NOT NULL)::INT + (z3.z IS NOT NULL)::INT AS measures FROM m JOIN z1 USING (symbol, clock, nth) JOIN z2 USING (symbol, clock, nth) JOIN z3 USING (symbol, clock, nth)),
s AS (SELECT *, (coalesce(za, 0) + coalesce(zb, 0) + coalesce(zc, 0)) / nullif(measures, 0) AS score FROM j), kn AS (SELECT *, CASE WHEN nth > 5 THEN score END AS known FROM s), {_states("kn", "symbol", "known", ("trending", "neutral", "reverting"))}
SELECT symbol, day, round(za, 4) AS z_vr, round(zb, 4) AS z_er, round(zc, 4) AS z_adf_t, round(score, 4) AS score, measures, state, reset AS chain_reset FROM st""")
def reversion_regime_days(spark: SparkSession, d: str) -> DataFrame:
    v, e, a = (market_queries.QUERIES[q](spark, d) for q in _MEASURES)
    m = v.select("symbol", "day", "vr").join(e.select("symbol", "day", "er"), ["symbol", "day"], "full").join(a.select("symbol", "day", "adf_t"), ["symbol", "day"], "full").withColumn("clock", F.lit(1440))
    r = detectors.reversion(m, ["symbol"], {"vr": 1.0, "er": 1.0, "adf_t": 1.0}, 120, 5)
    return r.drop("clock").withColumns({c: F.round(c, 4) for c in ("z_vr", "z_er", "z_adf_t", "score")})


@query(f"""WITH {_RET}, k AS (SELECT symbol, day, minute, "close" AS c, (floor((hour(minute + INTERVAL 2 HOUR) * 60 + minute(minute + INTERVAL 2 HOUR)) / 30) + 1)::INT * 30 AS clock, first_value("close") OVER (PARTITION BY symbol, day ORDER BY minute) AS f FROM rt),
s AS (SELECT symbol, day, clock, sign(arg_max(c, minute) - any_value(f)) AS m, dense_rank() OVER (PARTITION BY symbol ORDER BY day) AS nth FROM k GROUP BY symbol, day, clock),
e AS (SELECT symbol, nth, (arg_max(m, clock) > 0)::INT AS up FROM s GROUP BY ALL), u AS (SELECT symbol, nth, avg(up) OVER (PARTITION BY symbol ORDER BY nth RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) AS up_ratio FROM e)
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, clock::INT AS clock, CASE WHEN m > 0 THEN 'up' WHEN m < 0 THEN 'down' ELSE 'flat' END AS state, round(up_ratio, 6) AS up_ratio FROM s JOIN u USING (symbol, nth)""")
def session_direction(spark: SparkSession, d: str) -> DataFrame:
    clock = minute_of_day(F.col("minute") + F.expr("INTERVAL 2 HOURS"))
    return detectors.session_direction(_bars(spark, d), ["symbol"], clock).withColumns({"day": _day("day"), "up_ratio": F.round("up_ratio", 6)})


@query(f"""WITH RECURSIVE {T}, o AS (SELECT run_id, day, ticks, entry_time AS e, exit_time AS x, row_number() OVER (PARTITION BY run_id ORDER BY entry_time, exit_time, asset, trade_id) AS n FROM tr WHERE entry_time IS NOT NULL AND exit_time IS NOT NULL AND asset IS NOT NULL AND run_id IS NOT NULL),
w AS (SELECT run_id, n, x AS l, true AS k FROM o WHERE n = 1 UNION ALL SELECT o.run_id, o.n, CASE WHEN o.e >= w.l THEN o.x ELSE w.l END, o.e >= w.l FROM w JOIN o ON o.run_id = w.run_id AND o.n = w.n + 1),
d AS (SELECT run_id, day, sum(ticks) AS d, count(*) AS n FROM o JOIN w USING (run_id, n) WHERE k GROUP BY ALL), e AS (SELECT *, sum(d) OVER (PARTITION BY run_id ORDER BY day) AS e FROM d), p AS (SELECT *, max(e) OVER (PARTITION BY run_id ORDER BY day) AS p FROM e)
SELECT run_id, sum(d) AS total_ticks, CASE WHEN count(*) >= 2 AND stddev_samp(d) > 0 THEN round(avg(d) / stddev_samp(d) * sqrt(252.0), 6) END AS sharpe_daily, min(e - p) AS max_dd_ticks, round(min(CASE WHEN p > 0 THEN (e - p) / p END) * 100, 6) AS max_dd_pct, sum(n)::BIGINT AS n_trades, count(*)::BIGINT AS n_days FROM p GROUP BY run_id""")
def combined_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The assets of every run taken together without overlap."""
    t = _trades(spark, d).where("entry_time IS NOT NULL AND exit_time IS NOT NULL AND asset IS NOT NULL AND run_id IS NOT NULL")
    t = t.select(F.concat_ws(" ", F.col("run_id"), F.col("asset")).alias("vid"), "run_id", "trade_id", "entry_time", "exit_time", "ticks", "day")
    sets = t.select("run_id", "vid").distinct().withColumnRenamed("run_id", "set_id")
    e = pool.evaluate(t.drop("run_id"), sets, "set_id", "entry_time", "exit_time", ["trade_id"])
    return e.withColumnRenamed("set_id", "run_id").withColumns({"sharpe_daily": F.round("sharpe_daily", 6), "max_dd_pct": F.round("max_dd_pct", 6)})


@query(f"""WITH {T}, v AS (SELECT *, run_id::VARCHAR || ' · ' || coalesce(direction, 'unknown') || ' · exit=' || coalesce(exit_reason, 'none') AS vid, coalesce(direction, 'unknown') AS kind FROM tr WHERE run_id IS NOT NULL AND day_type IN ('none', 'fomc', 'cpi')),
u AS (SELECT DISTINCT day FROM v), r AS (SELECT day, row_number() OVER (ORDER BY day) <= greatest(least(floor(count(*) OVER () * 0.7), count(*) OVER () - 1), 1) AS ins FROM u),
c AS (SELECT vid, kind, count(*) FILTER (ins) AS n_is, count(*) FILTER (NOT ins) AS n_oos, coalesce(sum(ticks) FILTER (ins), 0) AS total_is FROM v JOIN r USING (day) GROUP BY ALL)
SELECT vid, kind, n_is::BIGINT AS n_is, n_oos::BIGINT AS n_oos, total_is FROM c WHERE n_is >= CASE kind WHEN 'long' THEN 4 WHEN 'short' THEN 3 ELSE 1 END""")
def variant_pool(spark: SparkSession, d: str) -> DataFrame:
    """Variants by direction and exit rule with enough in-sample trades for their kind."""
    v = pool.variants(_trades(spark, d).withColumnRenamed("exit_reason", "exit"), "run_id", "direction", ["exit"], {"day_type": ["none", "fomc", "cpi"]})
    p = pool.floored(pool.in_sample(v, "day", 0.7), "direction", {"long": 4, "short": 3}, 1)
    return p.groupBy("vid", F.coalesce("direction", F.lit("unknown")).alias("kind")).agg(F.count_if("in_sample").alias("n_is"), F.count_if(~F.col("in_sample")).alias("n_oos"), F.coalesce(F.sum(F.when(F.col("in_sample"), F.col("ticks"))), F.lit(0.0)).alias("total_is"))


@query(f"""WITH g AS ({SQL["asof_labels"]}), {T} SELECT trade_id, run_id, sum(ticks) OVER (PARTITION BY run_id ORDER BY exit_time NULLS FIRST, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_ticks
FROM tr JOIN g USING (trade_id) WHERE direction IN ('long', 'short') AND day_type IN ('none', 'fomc') AND regime IN ('up', 'flat') AND exit_reason IN ('target', 'stop', 'timeout')""")
def filtered_trades(spark: SparkSession, d: str) -> DataFrame:
    """Direction, day type, regime at entry and exit rule, one after the other; totals of what is left."""
    t = _trades(spark, d).drop("cumulative_ticks").join(market_queries.QUERIES["asof_labels"](spark, d), "trade_id")
    stages = [("direction", ["long", "short"]), ("day_type", ["none", "fomc"]), ("regime", ["up", "flat"]), ("exit_reason", ["target", "stop", "timeout"])]
    return pool.filtered(t, stages, ["run_id"], ["exit_time", "trade_id"]).select("trade_id", "run_id", "cumulative_ticks")


@query(f"""WITH {B}, sp AS (SELECT symbol, day, min(minute) AS lo, max(minute) AS hi FROM bars GROUP BY ALL), {T} SELECT trade_id, strftime(sp.day, '%Y-%m-%d') AS session FROM tr JOIN sp ON tr.asset = sp.symbol AND tr.entry_time::TIMESTAMP >= sp.lo AND tr.entry_time::TIMESTAMP < sp.hi""")
def interval_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The session, of many a symbol, that a trade was entered in."""
    spans = _bars(spark, d).groupBy(F.col("symbol").alias("asset"), "day").agg(F.min("minute").alias("lo"), F.max("minute").alias("hi")).withColumnRenamed("day", "session")
    t = _trades(spark, d).select("trade_id", "asset", "entry_time")
    return joins.interval(t, spans, "asset", "entry_time", "lo", "hi", ["session"]).select("trade_id", _day("session").alias("session"))


@query(f"""WITH {_PRINT}, n AS (SELECT instrument_id, min(underlying) AS underlying, min(series) AS series FROM options_5m_contracts GROUP BY ALL), v AS (SELECT underlying, ts_event::TIMESTAMP::DATE AS day, series, sum(size) AS v FROM pr JOIN n USING (instrument_id) WHERE underlying IS NOT NULL AND series IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY underlying, day ORDER BY v DESC, series) AS k FROM v)
SELECT underlying, strftime(day, '%Y-%m-%d') AS day, max(CASE WHEN k = 1 THEN series END) AS front, max(CASE WHEN k = 1 THEN v END)::BIGINT AS front_volume, coalesce(max(CASE WHEN k = 2 THEN v END), 0)::BIGINT AS second_volume, coalesce(max(CASE WHEN k = 2 THEN v END), 0) > 0.2 * max(CASE WHEN k = 1 THEN v END) AS is_roll_day FROM r WHERE k <= 2 GROUP BY underlying, day""")
def front_by_volume(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "options_5m_contracts").groupBy("instrument_id").agg(F.min("underlying").alias("underlying"), F.min("series").alias("series"))
    p = options.classified(table(spark, d, "option_trades")).join(names, "instrument_id").where("underlying IS NOT NULL AND series IS NOT NULL").withColumn("day", F.to_date("ts_event"))
    return bars.front_and_roll(p, ["underlying", "day"], "series", "size").withColumn("day", _day("day"))


@query("""SELECT DISTINCT c.instrument_id, strftime(c.session_date, '%Y-%m-%d') AS day FROM options_5m_contracts c WHERE c.instrument_id IS NOT NULL AND c.session_date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM option_trades t WHERE t.instrument_id = c.instrument_id AND t.ts_event::TIMESTAMP::DATE = c.session_date)""")
def listed_without_prints(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "options_5m_contracts").where("instrument_id IS NOT NULL AND session_date IS NOT NULL").select("instrument_id", F.col("session_date").alias("day")).distinct()
    printed = table(spark, d, "option_trades").select("instrument_id", F.to_date("ts_event").alias("day")).distinct()
    return listed.join(printed, ["instrument_id", "day"], "left_anti").withColumn("day", _day("day"))


_LINE = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (\d{1,2}) (\d{2}:\d{2}) [A-Z]{3} (.+) (red|orange|yellow|grey)$"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '[\r\n]+')) AS line FROM documents), e AS (SELECT doc_id, regexp_extract(line, '{_LINE}', 1)::INT AS dom, lower(regexp_extract(line, '{_LINE}', 3)) AS event, regexp_extract(line, '{_LINE}', 4) AS impact FROM l WHERE regexp_matches(line, '{_LINE}')),
r AS (SELECT doc_id, dom, min(CASE WHEN impact = 'grey' THEN 1 WHEN impact = 'red' THEN CASE WHEN event LIKE '%fomc%' THEN 2 WHEN event LIKE '%cpi%' THEN 3 WHEN event LIKE '%non-farm employment change%' THEN 4 WHEN event LIKE '%ppi%' THEN 5 ELSE 6 END END) AS r FROM e GROUP BY ALL)
SELECT doc_id, dom, ['holiday', 'fomc', 'cpi', 'nfp', 'ppi', 'other_high_impact'][r] AS bucket FROM r WHERE r IS NOT NULL""")
def digest_day_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The bucket of each day of each calendar digest among the documents."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[\r\n]+")).alias("line")).where(F.col("line").rlike(_LINE))
    part = lambda i: F.regexp_extract("line", _LINE, i)
    events = lines.select(F.struct("doc_id", part(1).cast("int").alias("dom")).alias("day"), part(3).alias("event"), part(4).alias("impact"))
    return report.bucket_days(events, "day", F.col("event"), "impact").select("day.doc_id", "day.dom", "bucket")


_LADDER = SQL["book_depth_by_second"].replace("SELECT symbol, strftime(session_date, '%Y-%m-%d') AS session_date, life::BIGINT AS life, sec::BIGINT AS sec, side, px, (sum(delta) OVER (PARTITION BY symbol, session_date, life, side, px ORDER BY sec))::BIGINT AS size FROM p", """, z AS (SELECT symbol, session_date, life, sec, side, px, sum(delta) OVER w AS size, lead(sec) OVER w AS nx FROM p WINDOW w AS (PARTITION BY symbol, session_date, life, side, px ORDER BY sec)),
le AS (SELECT symbol, session_date, life, lead(min(sec)) OVER (PARTITION BY symbol, session_date ORDER BY life) AS e FROM l WHERE sec IS NOT NULL GROUP BY symbol, session_date, life), ac AS (SELECT DISTINCT symbol, session_date, sec FROM l WHERE sec IS NOT NULL),
ld AS (SELECT ac.symbol, ac.session_date, ac.sec, z.side, z.px, z.size FROM z JOIN le USING (symbol, session_date, life) JOIN ac ON ac.symbol = z.symbol AND ac.session_date = z.session_date AND ac.sec >= z.sec AND (coalesce(z.nx, le.e) IS NULL OR ac.sec < coalesce(z.nx, le.e)) WHERE z.size > 0),
tb AS (SELECT symbol, session_date, sec, max(px) FILTER (side = 'B') AS best_bid, min(px) FILTER (side = 'A') AS best_ask, count(*) FILTER (side = 'B') AS bid_levels, count(*) FILTER (side = 'A') AS ask_levels, coalesce(sum(size) FILTER (side = 'B'), 0) AS bid_size, coalesce(sum(size) FILTER (side = 'A'), 0) AS ask_size FROM ld GROUP BY ALL)""")


@query(f"""{_LADDER} SELECT symbol, strftime(session_date, '%Y-%m-%d') AS day, sec::BIGINT AS sec, best_bid, best_ask, bid_levels::BIGINT AS bid_levels, ask_levels::BIGINT AS ask_levels, bid_size::BIGINT AS bid_size, ask_size::BIGINT AS ask_size FROM tb""")
def book_touch_by_second(spark: SparkSession, d: str) -> DataFrame:
    t = book.touch_by_second(book.ladders(_changes(spark, d)))
    return t.withColumn("day", _day("session_date")).drop("session_date")


@query(f"""{_LADDER}, tp AS (SELECT symbol, session_date, floor(epoch_us(ts) / 1000000) AS sec, min(px) AS lo, max(px) AS hi FROM f WHERE action = 'T' AND ts IS NOT NULL GROUP BY ALL),
wn AS (SELECT tb.symbol, tb.session_date, tb.sec, least(coalesce(best_bid, best_ask), coalesce(lo, best_bid, best_ask)) - 2000000000 AS lo, greatest(coalesce(best_ask, best_bid), coalesce(hi, best_ask, best_bid)) + 2000000000 AS hi FROM tb LEFT JOIN tp USING (symbol, session_date, sec)),
nr AS (SELECT ld.*, px BETWEEN lo AND hi AS near FROM ld JOIN wn USING (symbol, session_date, sec)), md AS (SELECT symbol, session_date, side, sec, quantile_cont(size, 0.5) FILTER (near) AS m FROM nr GROUP BY ALL),
bs AS (SELECT symbol, session_date, side, sec, quantile_cont(m, 0.5) OVER (PARTITION BY symbol, session_date, side ORDER BY sec RANGE BETWEEN 299 PRECEDING AND 1 PRECEDING) AS baseline FROM md)
SELECT nr.symbol, strftime(nr.session_date, '%Y-%m-%d') AS day, nr.side, nr.sec::BIGINT AS sec, count(*) FILTER (near)::BIGINT AS near_levels, count(*) FILTER (NOT near)::BIGINT AS far_levels, any_value(baseline)::DOUBLE AS baseline FROM nr JOIN bs ON nr.symbol = bs.symbol AND nr.session_date = bs.session_date AND nr.side = bs.side AND nr.sec = bs.sec WHERE near OR size >= 3 * baseline GROUP BY nr.symbol, nr.session_date, nr.side, nr.sec""")
def book_cropped_by_second(spark: SparkSession, d: str) -> DataFrame:
    """Levels left by second and side: within eight ticks of the market, or three times the rolling baseline."""
    c = _changes(spark, d)
    tape = c.where("action = 'T' AND ts IS NOT NULL").select("symbol", "session_date", F.floor(F.unix_micros("ts") / 1_000_000).alias("sec"), "px")
    x = book.cropped_ladders(book.ladders(c), tape, 8, 250_000_000, 3.0, 300)
    g = x.groupBy("symbol", "session_date", "side", "sec").agg(F.count_if("near").alias("near_levels"), F.count_if(~F.col("near")).alias("far_levels"), F.max("baseline").alias("baseline"))
    return g.withColumn("day", _day("session_date")).drop("session_date")


_NY = f"""{B}, ny AS (SELECT symbol, minute, open, high, low, "close" AS c, volume, minute AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS lt FROM bars), nd AS (SELECT *, (lt + INTERVAL 6 HOUR)::DATE AS td, hour(lt) * 60 + minute(lt) BETWEEN 570 AND 959 AS reg FROM ny)"""


def _ny_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars with the trade date and regular hours of New York, daylight saving included."""
    b = _bars(spark, d).drop("day", "rth").withColumn("local", local(F.col("minute")))
    return b.withColumns({"day": trade_date(F.col("local"), 18), "rth": in_window(F.col("local"), 570, 960, closed=False)}).drop("local")


@query(f"""WITH {_NY} SELECT symbol, strftime(td, '%Y-%m-%d') AS day, arg_min(open, minute) AS globex_open, max(high) AS globex_high, min(low) AS globex_low, arg_max(c, minute) AS globex_close, sum(volume)::BIGINT AS globex_volume,
arg_min(open, minute) FILTER (reg) AS rth_open, max(high) FILTER (reg) AS rth_high, min(low) FILTER (reg) AS rth_low, arg_max(c, minute) FILTER (reg) AS rth_close, coalesce(sum(volume) FILTER (reg), 0)::BIGINT AS rth_volume FROM nd GROUP BY symbol, td""")
def ny_session_statistics(spark: SparkSession, d: str) -> DataFrame:
    return bars.session_statistics(_ny_bars(spark, d), ["symbol", "day"], "minute", F.col("rth")).withColumn("day", _day("day"))


@query(f"""WITH {_NY}, g AS (SELECT symbol, td, ((td - 1)::TIMESTAMP + INTERVAL 18 HOUR) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS st, unnest(range(1380)) AS slot FROM (SELECT DISTINCT symbol, td FROM nd)),
j AS (SELECT g.symbol, g.td, g.slot, open, high, low, c, volume, last_value(c IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f, first_value(c IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bk FROM g LEFT JOIN nd ON nd.symbol = g.symbol AND nd.td = g.td AND nd.minute = g.st + to_minutes(g.slot::INT) WINDOW w AS (PARTITION BY g.symbol, g.td ORDER BY slot))
SELECT symbol, strftime(td, '%Y-%m-%d') AS day, slot::INT AS slot, coalesce(open, f, bk) AS open, coalesce(high, f, bk) AS high, coalesce(low, f, bk) AS low, coalesce(f, bk) AS close, coalesce(volume, 0)::BIGINT AS volume, c IS NULL AS filled FROM j WHERE coalesce(f, bk) IS NOT NULL""")
def ny_session_grid(spark: SparkSession, d: str) -> DataFrame:
    b = _ny_bars(spark, d).withColumn("start", session_start(F.col("day")))
    return bars.session_grid(b, ["symbol", "day"], "start").drop("minute").withColumn("day", _day("day"))
