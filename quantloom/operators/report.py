"""Trade metrics: reports, parameter cells, breakdowns, costs, curves, exposure.

Undefined figures are null. A profit factor without losses is infinite as each
report defines it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.calendar import weekdays_between
from quantloom.functions.market import commission, ratio, slippage

YEAR = 252.0
INF = float("inf")


def latest_trades(df: DataFrame) -> DataFrame:
    """One row per trade_id, the copy saved last, with day (DATE); trades without day or ticks are left out."""
    from quantloom.operators.trailing import session_day

    names = ["run_id", "asset", "direction", "entry_time", "exit_time", "entry_price", "exit_price", "sl", "tp", "pnl_points", "ticks", "exit_reason", "day_type"]
    fields = F.struct(F.col("saved_at"), session_day(F.col("date")).alias("day"), *names)
    one = df.where("trade_id IS NOT NULL").groupBy("trade_id").agg(F.max(fields).alias("x"))
    return one.select("trade_id", "x.day", *[f"x.{n}" for n in names]).where("day IS NOT NULL AND ticks IS NOT NULL AND NOT isnan(ticks)")


def profit_factor(win: Column, loss: Column, when_no_trades_lose: Column) -> Column:
    """Gross win over gross loss, when_no_trades_lose without losses."""
    return F.when(loss > 0, win / F.when(loss > 0, loss)).otherwise(when_no_trades_lose)


def sharpe(mean: Column, sd: Column, n: Column | float = YEAR) -> Column:
    """mean / sd x sqrt(n), null where undefined."""
    return F.when(sd > 0, mean / F.when(sd > 0, sd) * F.sqrt(F.lit(n) if isinstance(n, float) else n))


def zero_filled(total: Column, squares: Column, n: Column) -> Column:
    """Daily Sharpe over n days of which those without trades count zero: from sums alone, no spine is built."""
    var = (squares - total * total / n) / F.when(n > 1, n - 1)
    return sharpe(total / n, F.sqrt(F.greatest(var, F.lit(0.0))))


def cells(df: DataFrame, keys: list[str], pnl: str, day: str, band: float = 0.0) -> DataFrame:
    """The eight metrics of each parameter cell, in two aggregations: by (cell, day), then by cell.

    win_rate counts pnl above the break-even band, win_rate_be pnl not below
    it, in percent; the profit factor is by sign and infinite without losses.
    """
    x = F.col(pnl)
    daily = df.groupBy(*keys, day).agg(
        F.sum(x).alias("d"), F.count(F.lit(1)).alias("n"), F.sum(F.greatest(x, F.lit(0.0))).alias("w"), F.sum(F.greatest(-x, F.lit(0.0))).alias("l"), F.count_if(x > band).alias("wins"), F.count_if(x >= -band).alias("wins_be"),
    )
    c = daily.groupBy(*keys).agg(
        F.sum("d").alias("total_ticks"), F.sum("n").alias("total_trades"), F.sum("w").alias("w"), F.sum("l").alias("l"), F.sum("wins").alias("wins"), F.sum("wins_be").alias("wins_be"),
        F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.sum(F.col("d") * F.col("d")).alias("sq"), F.count(F.lit(1)).alias("k"), F.min(day).alias("lo"), F.max(day).alias("hi"),
    )
    days = F.greatest(weekdays_between(F.col("lo"), F.col("hi")), F.col("k")).cast("double")
    return c.select(
        *keys, "total_ticks", "total_trades", (F.col("total_ticks") / F.col("total_trades")).alias("avg_trade"), profit_factor(F.col("w"), F.col("l"), F.lit(INF)).alias("profit_factor"),
        (100.0 * F.col("wins") / F.col("total_trades")).alias("win_rate"), (100.0 * F.col("wins_be") / F.col("total_trades")).alias("win_rate_be"),
        F.when(F.col("k") >= 2, sharpe(F.col("mean"), F.col("sd"))).alias("sharpe_trade"), F.when(days >= 2, zero_filled(F.col("total_ticks"), F.col("sq"), days)).alias("sharpe_daily"),
    )


def equity(df: DataFrame, keys: list[str], order: list[str], pnl: str, start: float = 0.0) -> DataFrame:
    """Adds cumulative (start + running sum), peak (from the first row on) and drawdown."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("cumulative", F.sum(pnl).over(w) + F.lit(start))
    out = out.withColumn("peak", F.max("cumulative").over(w))
    return out.withColumn("drawdown", F.col("cumulative") - F.col("peak"))


def streaks(df: DataFrame, keys: list[str], order: list[str], won: Column) -> DataFrame:
    """keys, max_consec_wins, max_consec_losses: longest runs; what is not won is lost."""
    rows = df.withColumn("_won", won)
    w, ww = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys, "_won").orderBy(*order)
    runs = rows.withColumn("_run", F.row_number().over(w) - F.row_number().over(ww)).groupBy(*keys, "_won", "_run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_won"), F.col("n"))), F.lit(0)).alias("max_consec_wins"), F.coalesce(F.max(F.when(~F.col("_won"), F.col("n"))), F.lit(0)).alias("max_consec_losses"))


def trade_report(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The full report of each group of trades (columns as latest_trades()).

    Drawdown and peak start at the first trade; calmar without a drawdown is
    infinite; the profit factor is infinite with wins only, zero without any.
    The daily Sharpe fills zeros on weekdays and counts traded weekend days.
    """
    x = F.col("ticks")
    stop = F.abs(F.col("entry_price") - F.col("sl"))
    minutes = (F.unix_micros("exit_time") - F.unix_micros("entry_time")) / 60e6
    curve = equity(df, keys, order, "ticks").withColumns({"rr_p": F.when(stop > 0, F.abs(F.col("tp") - F.col("entry_price")) / F.when(stop > 0, stop)), "rr_r": F.when(stop > 0, F.col("pnl_points") / F.when(stop > 0, stop)), "mins": minutes})
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    long_, short = F.col("direction") == "long", F.col("direction") == "short"
    base = curve.groupBy(*keys).agg(
        F.sum(x).alias("total_ticks"), F.avg(x).alias("avg_trade"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.max(win), F.lit(0.0)).alias("largest_win"), F.coalesce(F.min(loss), F.lit(0.0)).alias("largest_loss"),
        F.avg("rr_p").alias("avg_rr_planned"), F.percentile("rr_p", 0.5).alias("median_rr_planned"), F.avg("rr_r").alias("avg_rr_realised"), F.percentile("rr_r", 0.5).alias("median_rr_realised"),
        F.count(F.lit(1)).alias("total_trades"), F.avg((x > 0).cast("double")).alias("win_rate"), F.avg((x < 0).cast("double")).alias("loss_rate"), F.avg((x == 0).cast("double")).alias("breakeven_rate"),
        F.coalesce(F.sum(win), F.lit(0.0)).alias("w"), F.coalesce(-F.sum(loss), F.lit(0.0)).alias("l"), F.min("drawdown").alias("max_drawdown"), F.max("peak").alias("max_peak"),
        F.avg("mins").alias("avg_duration_min"), F.percentile("mins", 0.5).alias("median_duration_min"), F.count_if(long_).alias("long_trades"), F.count_if(short).alias("short_trades"),
        F.coalesce(F.avg(F.when(long_, (x > 0).cast("double"))), F.lit(0.0)).alias("long_winrate"), F.coalesce(F.avg(F.when(short, (x > 0).cast("double"))), F.lit(0.0)).alias("short_winrate"),
    )
    daily = df.groupBy(*keys, "day").agg(F.sum(x).alias("d"))
    d = daily.groupBy(*keys).agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("sq"), F.min("day").alias("lo"), F.max("day").alias("hi"), F.count_if(F.weekday("day") >= 5).alias("weekend"))
    days = (weekdays_between(F.col("lo"), F.col("hi")) + F.col("weekend")).cast("double")
    d = d.select(*keys, F.coalesce(sharpe(F.col("mean"), F.col("sd")), F.lit(0.0)).alias("sharpe_trade"), F.coalesce(F.when(days >= 2, zero_filled(F.col("s"), F.col("sq"), days)), F.lit(0.0)).alias("sharpe_daily"))
    out = base.join(d, keys).join(streaks(df, keys, order, x > 0), keys)
    out = out.withColumns({"profit_factor": profit_factor(F.col("w"), F.col("l"), F.when(F.col("w") > 0, INF).otherwise(0.0)), "calmar": F.when(F.col("max_drawdown") < 0, F.col("total_ticks") / F.abs(F.when(F.col("max_drawdown") < 0, F.col("max_drawdown")))).otherwise(INF)})
    return out.drop("w", "l")


def exit_breakdown(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, average (one decimal) and total (whole) ticks by exit reason."""
    return df.groupBy(*keys, "exit_reason").agg(F.count("ticks").alias("trades"), F.round(F.avg("ticks"), 1).alias("avg_ticks"), F.round(F.sum("ticks"), 0).cast("long").alias("total_ticks"))


def typed_breakdown(df: DataFrame, column: str) -> DataFrame:
    """One row per value of column and one over all of them (entry 'All entries'), by grouping sets."""
    x = F.col("ticks")
    g = df.where(F.col(column).isNotNull()).groupingSets([[F.col(column)], []], F.col(column)).agg(
        F.grouping(column).alias("all"), F.count(F.lit(1)).alias("trades"), F.count_if(x > 0).alias("wins"), F.count_if(x < 0).alias("losses"), F.sum(x).alias("total_ticks"), F.avg(x).alias("avg_ticks"), F.sum(F.greatest(x, F.lit(0.0))).alias("w"), F.sum(F.greatest(-x, F.lit(0.0))).alias("l")
    )
    return g.select(F.when(F.col("all") == 1, "All entries").otherwise(F.col(column)).alias("entry"), "trades", "wins", "losses", "total_ticks", "avg_ticks", profit_factor(F.col("w"), F.col("l"), F.when(F.col("w") > 0, INF).otherwise(0.0)).alias("profit_factor"))


def dense_breakdown(df: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """A row for every declared value of column, also for those without trades."""
    spark = df.sparkSession
    names = F.broadcast(spark.createDataFrame([(i, d) for i, d in enumerate(declared)], f"place int, {column} string"))  # as many rows as declared
    x = F.col("ticks")
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("trades"), F.count_if(x > 0).alias("wins"), F.count_if(x < 0).alias("losses"), F.sum(x).alias("total_ticks"), F.avg(x).alias("avg_ticks"))
    return names.join(g, column, "left").fillna(0, ["trades", "wins", "losses"]).fillna(0.0, ["total_ticks"])


def reward_risk(df: DataFrame) -> DataFrame:
    """series, rr of each trade with a stop: planned, realised, won (realised above 0), even (exactly 0)."""
    stop = F.abs(F.col("entry_price") - F.col("sl"))
    base = df.where(stop > 0).select((F.abs(F.col("tp") - F.col("entry_price")) / stop).alias("p"), (F.col("pnl_points") / stop).alias("r"))
    each = F.array(F.struct(F.lit("planned").alias("series"), F.col("p").alias("rr")), F.struct(F.lit("realised").alias("series"), F.col("r").alias("rr")), F.when(F.col("r") > 0, F.struct(F.lit("won").alias("series"), F.col("r").alias("rr"))), F.when(F.col("r") == 0, F.struct(F.lit("even").alias("series"), F.col("r").alias("rr"))))
    return base.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("x.*").where("rr IS NOT NULL")


def histogram(df: DataFrame, series: str, value: str, width: float) -> DataFrame:
    """series, bin, n: counts of equal bins on one shared scale, bin being the lower edge number."""
    return df.withColumn("bin", F.floor(F.col(value) / width).cast("long")).groupBy(series, "bin").agg(F.count(F.lit(1)).alias("n"))


#: More values than this are no axis of a grid.
MOST_AXIS = 10_000


def _axis(df: DataFrame, column: str) -> Column:
    """The distinct values of a column as one array, null among them; an error beyond MOST_AXIS."""
    one = df.select(column).distinct().agg(F.collect_list(F.struct(column)).alias("axis"))  # one row
    return one.select(F.when(F.size("axis") > MOST_AXIS, F.raise_error(F.lit(f"more than {MOST_AXIS} values on an axis")).cast(one.schema["axis"].dataType)).otherwise(F.col("axis"))).scalar()


def dense_grid(metrics: DataFrame, x: str, y: str) -> DataFrame:
    """metrics on the full grid of the x and y values there are; missing cells are null."""
    spine = metrics.select(x).distinct().select(x, F.explode(_axis(metrics, y)).alias("_y")).select(x, f"_y.{y}")
    return spine.join(metrics, [x, y], "left")


# Words that name the class of a red event, by rank; a day takes the best class of its events.
EVENT_CLASSES = {"fomc": ["fomc"], "cpi": ["cpi"], "nfp": ["non-farm employment change"], "ppi": ["ppi"]}
BUCKETS = ["holiday", *EVENT_CLASSES, "other_high_impact", "normal"]


def bucket_days(events: DataFrame, day: str, name: Column | str, impact: Column | str) -> DataFrame:
    """day, bucket: holiday (any grey event), else the best class of the day's red events.

    Classes are told by words in the names of red events only; a red event of
    no class is other_high_impact. Days without a grey or red event have no row
    (they are normal, see joins.with_default); null names are of no class.
    """
    t = F.lower(name)
    red = F.lit(len(EVENT_CLASSES) + 1)
    for i, words in reversed(list(enumerate(EVENT_CLASSES.values(), 1))):
        red = F.when(F.greatest(*[t.contains(w) for w in words], F.lit(False)), i).otherwise(red)
    kind = F.col(impact) if isinstance(impact, str) else impact
    rank = F.when(kind == "grey", 0).when(kind == "red", red)
    best = events.where(F.col(day).isNotNull()).groupBy(day).agg(F.min(rank).alias("r")).where("r IS NOT NULL")
    return best.select(day, F.element_at(F.array(*[F.lit(o) for o in BUCKETS]), F.col("r") + 1).alias("bucket"))


def split_halves(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """df with half (1, 2): days up to the lower median of the group's distinct days, and the rest."""
    days = df.select(*keys, day).distinct()
    n = days.withColumns({"i": F.row_number().over(Window.partitionBy(*keys).orderBy(day)), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    cut_day = n.where(F.col("i") == F.floor((F.col("n") + 1) / 2)).select(*keys, F.col(day).alias("_cut"))
    return df.join(cut_day, keys).withColumn("half", F.when(F.col(day) <= F.col("_cut"), 1).otherwise(2)).drop("_cut")


def sample_split(df: DataFrame, keys: list[str], day: str, pnl: str, fraction: float) -> DataFrame:
    """keys, n_is, n_oos, total_is, total_oos: in and out of sample at a quantile of all distinct days, clamped so that both have one."""
    days = df.select(day).distinct()
    ranked = days.withColumns({"i": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(day)), "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})  # one row per calendar day
    cutoff = F.greatest(F.least(F.floor(F.col("n") * fraction), F.col("n") - 1), F.lit(1))
    part = ranked.select(day, (F.col("i") <= cutoff).alias("_is"))
    x = F.col(pnl)
    return df.join(part, day).groupBy(*keys).agg(F.count_if("_is").alias("n_is"), F.count_if(~F.col("_is")).alias("n_oos"), F.coalesce(F.sum(F.when(F.col("_is"), x)), F.lit(0.0)).alias("total_is"), F.coalesce(F.sum(F.when(~F.col("_is"), x)), F.lit(0.0)).alias("total_oos"))


def correlations(df: DataFrame, member: str, day: str, pnl: str) -> DataFrame:
    """a, b, corr (a < b): Pearson correlation of daily totals, days without a trade counting zero; 0 where undefined.

    Every pair of members has a row, also one that shares no day: this is a
    matrix for up to MOST_AXIS members. From sums alone: products meet only on
    days both traded (a join on the day of one row per member and day), and the
    number of days is that of all distinct days. Rows without a member are left
    out; those without a day or gain count nothing.
    """
    daily = df.where(F.col(member).isNotNull() & F.col(day).isNotNull()).groupBy(member, day).agg(F.coalesce(F.sum(pnl), F.lit(0.0)).alias("_d"))
    n = daily.select(day).distinct().agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    m = daily.groupBy(member).agg(F.sum("_d").alias("_s"), F.sum(F.col("_d") * F.col("_d")).alias("_q"))
    a, b = daily.select(F.col(member).alias("a"), day, F.col("_d").alias("da")), daily.select(F.col(member).alias("b"), day, F.col("_d").alias("db"))
    products = a.join(b, day).where("a < b").groupBy("a", "b").agg(F.sum(F.col("da") * F.col("db")).alias("p"))
    pairs = m.select(F.col(member).alias("a"), F.col("_s").alias("sa"), F.col("_q").alias("qa"), F.explode(_axis(m, member)).alias("_b")).select("a", "sa", "qa", F.col(f"_b.{member}").alias("b")).where("a < b")
    full = pairs.join(m.select(F.col(member).alias("b"), F.col("_s").alias("sb"), F.col("_q").alias("qb")), "b").join(products, ["a", "b"], "left").withColumn("n", n)
    va, vb = F.col("n") * F.col("qa") - F.col("sa") * F.col("sa"), F.col("n") * F.col("qb") - F.col("sb") * F.col("sb")
    p = F.coalesce("p", F.lit(0.0))
    return full.select("a", "b", F.coalesce(F.when((va > 0) & (vb > 0), (F.col("n") * p - F.col("sa") * F.col("sb")) / F.sqrt(F.when(va > 0, va) * F.when(vb > 0, vb))), F.lit(0.0)).alias("corr"))


def transitions(df: DataFrame, keys: list[str], day: str, state: str, max_gap_days: int = 5) -> DataFrame:
    """keys, previous, state, n, probability: steps between consecutive days; unknown states and longer gaps break the chain."""
    w = Window.partitionBy(*keys).orderBy(day)
    steps = df.withColumns({"previous": F.lag(state).over(w), "_gap": F.datediff(day, F.lag(day).over(w))}).where((F.col("_gap") <= max_gap_days) & (F.col("previous") != "unknown") & (F.col(state) != "unknown"))
    counts = steps.groupBy(*keys, "previous", state).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "previous")))


def with_costs(df: DataFrame, keys: list[str], order: list[str], account: float, ticks: int, dollars_per_tick: float, full: float, micro: float | None) -> DataFrame:
    """Sized trades (contracts, trade_pnl) with commission, slippage and the four equity curves."""
    gross = F.col("trade_pnl")
    out = df.withColumns({"commission": commission(F.col("contracts"), full, micro), "slippage": slippage(gross, F.col("contracts"), ticks, dollars_per_tick)})
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    curve = lambda c: F.sum(c).over(w) + account
    return out.withColumns({"equity_gross": curve(gross), "equity_commission": curve(gross - F.col("commission")), "equity_slippage": curve(gross - F.col("slippage")), "equity_net": curve(gross - F.col("commission") - F.col("slippage"))})


def dollar_metrics(df: DataFrame, keys: list[str], order: list[str], day: str = "day", account: float = 100_000.0) -> DataFrame:
    """Eighteen dollar figures of each group of sized trades (contracts, trade_pnl, optionally gross_pnl).

    Only trades with contracts count in the number, win rate and profit
    factor. The daily Sharpe is over traded days, the trade Sharpe is by trade
    times the root of the number of days; both zero where undefined.
    """
    x = F.col("trade_pnl")
    gross = F.col("gross_pnl") if "gross_pnl" in df.columns else x
    taken = F.col("contracts") > 0
    curve = equity(df, keys, order, "trade_pnl", account)
    n = curve.groupBy(*keys).agg(
        F.max_by("cumulative", F.struct(*order)).alias("final_equity"), F.sum(x).alias("total"), F.avg(x).alias("avg_trade"), F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(x < 0, x)), F.lit(0.0)).alias("avg_loss"),
        F.max(x).alias("largest_win"), F.min(x).alias("largest_loss"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.countDistinct(day).alias("days"),
        F.min("drawdown").alias("max_dd_dollars"), F.min(F.when(F.col("peak") > 0, F.col("drawdown") / F.when(F.col("peak") > 0, F.col("peak")) * 100.0).otherwise(0.0)).alias("max_dd_pct"), F.max("peak").alias("max_peak"),
        F.count_if(taken).alias("total_trades"), F.coalesce(F.avg(F.when(taken, (x > 0).cast("double"))), F.lit(0.0)).alias("win_rate"), F.coalesce(F.sum(F.when(taken & (x > 0), x)), F.lit(0.0)).alias("w"), F.coalesce(-F.sum(F.when(taken & (x < 0), x)), F.lit(0.0)).alias("l"),
        F.count_if(~taken).alias("skipped"), (F.sum(gross) - F.sum(x)).alias("cost_drag"),
    )
    daily = df.groupBy(*keys, day).agg(F.sum(x).alias("d")).groupBy(*keys).agg(F.coalesce(sharpe(F.avg("d"), F.stddev_samp("d")), F.lit(0.0)).alias("sharpe_daily"))
    out = n.join(daily, keys).withColumns({
        "sharpe_trade": F.coalesce(sharpe(F.col("mean"), F.col("sd"), F.col("days").cast("double")), F.lit(0.0)),
        "profit_factor": profit_factor(F.col("w"), F.col("l"), F.when(F.col("w") > 0, INF).otherwise(0.0)),
        "calmar": F.when(F.col("max_dd_dollars") < 0, F.col("total") / F.abs(F.when(F.col("max_dd_dollars") < 0, F.col("max_dd_dollars")))).otherwise(INF),
    })
    return out.drop("mean", "sd", "days", "w", "l")


def exposure(points: DataFrame, keys: list[str], order: str, lags: int = 5) -> DataFrame:
    """keys, n, alpha, beta, t_alpha, t_beta, r2 of y on x with Newey-West errors; no row for fewer than three points or a constant x.

    The covariance is built from products of lagged scores with Bartlett
    weights, all by windows over the group's days.
    """
    fit = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")).where("n >= 3 AND vx > 0")
    fit = fit.withColumn("beta", F.col("cxy") / F.col("vx")).withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    rows = points.join(fit, keys).withColumn("u", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x"))
    rows = rows.withColumns({"s0": F.col("u"), "s1": F.col("u") * F.col("x")})
    w = Window.partitionBy(*keys).orderBy(order)
    sums = {f"g{i}{j}": F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in (0, 1) for j in (0, 1)}
    lagged = {f"l{k}_{i}": F.lag(f"s{i}", k).over(w) for k in range(1, lags + 1) for i in (0, 1)}
    rows = rows.withColumns(lagged)
    total = {}
    for i in (0, 1):
        for j in (0, 1):
            e = sums[f"g{i}{j}"]
            for k in range(1, lags + 1):
                b = 1 - k / (lags + 1)
                e = e + b * F.coalesce(F.sum(F.col(f"s{i}") * F.col(f"l{k}_{j}") + F.col(f"l{k}_{i}") * F.col(f"s{j}")), F.lit(0.0))
            total[f"m{i}{j}"] = e
    m = rows.groupBy(*keys, "n", "alpha", "beta", "mx", "vx", "cxy", "vy").agg(*[e.alias(k) for k, e in total.items()])
    # Bread: inverse of X'X for (1, x).
    n, mx, vx = F.col("n"), F.col("mx"), F.col("vx")
    a, b, c = (vx + mx * mx) / (n * vx), -mx / (n * vx), F.lit(1.0) / (n * vx)
    var_a = a * a * F.col("m00") + a * b * (F.col("m01") + F.col("m10")) + b * b * F.col("m11")
    var_b = b * b * F.col("m00") + b * c * (F.col("m01") + F.col("m10")) + c * c * F.col("m11")
    return m.select(*keys, "n", "alpha", (F.col("alpha") * YEAR).alias("alpha_ann"), "beta", ratio(F.col("alpha"), F.sqrt(F.greatest(var_a, F.lit(0.0)))).alias("t_alpha"), ratio(F.col("beta"), F.sqrt(F.greatest(var_b, F.lit(0.0)))).alias("t_beta"), F.coalesce(ratio(F.col("cxy") * F.col("cxy"), vx * F.col("vy")), F.lit(0.0)).alias("r2"))


def benchmark(stats: DataFrame, keys: list[str], day: str, tick: float) -> DataFrame:
    """keys, day, settle_move, rth_move in ticks; both null on a roll (another symbol than the day before) and where a price is missing."""
    w = Window.partitionBy(*keys).orderBy(day)
    px = F.coalesce("settlement", "close")
    roll = F.lag("symbol").over(w) != F.col("symbol")
    return stats.select(*keys, day, F.when(~F.coalesce(roll, F.lit(True)), (px - F.lag(px).over(w)) / tick).alias("settle_move"), F.when(~F.coalesce(roll, F.lit(False)), (F.col("rth_close") - F.col("rth_open")) / tick).alias("rth_move"))


def color_scale(cells: DataFrame, metric: str, count: str, least: int, gamma: float = 1.0) -> DataFrame:
    """cells with masked (fewer than `least` trades) and shade: the metric from 0 at the smallest to 1 at the largest finite value, to the power gamma.

    Values that are not finite have no shade; if all finite ones are equal,
    each is in the middle.
    """
    x = F.col(metric).cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    ends = cells.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    part = F.when(hi > lo, (finite - lo) / F.when(hi > lo, hi - lo)).otherwise(F.when(finite.isNotNull(), 0.5))
    return cells.withColumns({"masked": F.coalesce(F.col(count), F.lit(0)) < least, "shade": F.pow(part, F.lit(gamma))})


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, sd, deciles (10 to 90) of the values that are neither null nor NaN."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.percentile(value, F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("deciles"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agree (share of rows where two labels are equal), chance (what independent labels with these shares would reach) and lift (their ratio); unknown and null labels do not count."""
    ok = df.where(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND `{a}` <> 'unknown' AND `{b}` <> 'unknown'")
    counts = ok.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    each = counts.select(F.explode(F.array(F.struct(F.col("x").alias("s"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb"), F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0).alias("ok")), F.struct(F.col("y").alias("s"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"), F.lit(0).cast("long").alias("ok")))).alias("e")).select("e.*")
    by = each.groupBy("s").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("ok").alias("ok"))
    t = by.agg(F.sum("na").alias("n"), F.sum("ok").alias("ok"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("p"))
    n = F.col("n").cast("double")
    return t.select("n", ratio(F.col("ok").cast("double"), n).alias("agree"), ratio(F.col("p"), n * n).alias("chance"), ratio(F.col("ok") * n, F.col("p")).alias("lift"))


def change_rate(df: DataFrame, keys: list[str], order: list[str], clock: str, state: str) -> DataFrame:
    """clock, n, changes, rate: how often a label differs from the one before it in its group, by clock; unknown labels break the chain."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_before", F.lag(state).over(w)).where(f"_before <> 'unknown' AND `{state}` <> 'unknown'")
    g = x.groupBy(clock).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_before") != F.col(state)).alias("changes"))
    return g.withColumn("rate", F.col("changes") / F.col("n"))


def interval_variance(df: DataFrame, keys: list[str], clock: str, squares: str, count: str) -> DataFrame:
    """keys, clock, variance: mean square of the returns between a snapshot and the one before, from running sums of squares and counts; null without returns."""
    w = Window.partitionBy(*keys).orderBy(clock)
    ds, dn = (F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in (squares, count))
    return df.select(*keys, clock, F.when(dn > 0, ds / F.when(dn > 0, dn)).alias("variance"))
