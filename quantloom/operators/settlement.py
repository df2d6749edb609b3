"""Settlement prices and the open interest they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.joins import asof

# The statistic that is a settlement, the action of a new record, and the bits of its flags.
SETTLEMENT, ADDED, FINAL, ACTUAL, INTRADAY = 3, 1, 1, 2, 8


def final_settlements(stats: DataFrame) -> DataFrame:
    """symbol, date, settlement, is_actual: the official settlement of each outright symbol and session.

    stats: symbol, ts_ref, ts_recv, price, stat_type, stat_flags, update_action
    over all files. Counted are added, final records that are not intraday and
    have a price; spreads (a dash in the symbol) are left out. The session is
    the UTC day of ts_ref, as publication may trail it by days; of several the
    one received last holds (ties: the greatest price).
    """
    flag = lambda b: F.col("stat_flags").bitwiseAND(b) != 0
    ok = (F.col("stat_type") == SETTLEMENT) & (F.col("update_action") == ADDED) & flag(FINAL) & ~flag(INTRADAY) & F.col("price").isNotNull() & ~F.isnan(F.col("price").cast("double")) & F.col("ts_ref").isNotNull() & ~F.col("symbol").contains("-")
    one = stats.where(ok).groupBy("symbol", F.to_date("ts_ref").alias("date")).agg(F.max(F.struct("ts_recv", "price", flag(ACTUAL).alias("is_actual"))).alias("x"))
    return one.select("symbol", "date", F.col("x.price").alias("settlement"), "x.is_actual")


def best_ranked(df: DataFrame, by: list[str], final: Column, ts: str, columns: list[str]) -> DataFrame:
    """by, columns, is_final: of each group a final row before one that is not, among these the latest (ties: greatest content)."""
    return df.groupBy(*by).agg(F.max(F.struct(F.coalesce(final, F.lit(False)).alias("is_final"), F.col(ts).alias("_ts"), *columns)).alias("x")).select(*by, *[f"x.{c}" for c in columns], "x.is_final")


def one_to_one(left: DataFrame, right: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """left with columns of right, never losing a row; an error if a key comes twice on either side."""
    once = lambda df: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    sure = F.when(F.greatest("_n", F.coalesce("_m", F.lit(1))) > 1, F.raise_error(F.lit(f"a key of {', '.join(by)} is not unique")).cast("boolean")).otherwise(True)
    r = once(right.select(*by, *columns)).withColumnRenamed("_n", "_m")
    return once(left).join(r, by, "left").where(sure).drop("_n", "_m")


def reference_sessions(pubs: DataFrame, settled: DataFrame, by: list[str], day: str, ref: str | None = None) -> DataFrame:
    """pubs with session: ref where there is one, else the latest settled session strictly before the publication's day.

    settled: by.., session, one row per settled session. Null if there is none
    before. Rows keep their number.
    """
    x = pubs.withColumn("_at", F.col(day).cast("timestamp"))
    s = settled.select(*by, F.col("session").cast("timestamp").alias("_st"), F.col("session").alias("_inferred")).distinct()
    out = asof(x, s, by, "_at", "_st", ["_inferred"], strict=True).drop("_at")
    return out.withColumn("session", F.coalesce(*([F.col(ref)] if ref else []), F.col("_inferred"))).drop("_inferred")


def closed_out(pubs: DataFrame, session: str, arrived: str, days: int = 7) -> DataFrame:
    """The publications that came while their session was still open: up to `days` after its day's end."""
    return pubs.where(F.col(arrived) < F.date_add(F.col(session), days + 1).cast("timestamp"))


def interest_with_settlement(pubs: DataFrame, days: int = 7) -> DataFrame:
    """instrument_id, session, kind, open_interest, settlement_price, is_final: one row per published session and kind.

    pubs: options_oi_snapshot. A session stays open for `days` after its day;
    what arrives later is left out, and so is what was published after the
    contract's expiry. The latest publication of (contract, session, kind)
    holds. The settlement is the best ranked of the contract's session; null
    where none was published.
    """
    kind = F.lower(F.trim("snapshot_type"))
    ok = pubs.where("instrument_id IS NOT NULL AND snapshot_time IS NOT NULL AND arrived_at IS NOT NULL").withColumns({"session": F.to_date("snapshot_time"), "kind": kind}).where(F.col("kind").isin("evening", "morning") & (F.col("expiry").isNull() | (F.col("snapshot_time") <= F.col("expiry"))))
    ok = closed_out(ok, "session", "arrived_at", days)
    last = ok.where("open_interest IS NOT NULL").groupBy("instrument_id", "session", "kind").agg(F.max(F.struct("snapshot_time", "snapshot_id", "open_interest")).alias("x")).select("instrument_id", "session", "kind", "x.open_interest")
    priced = ok.where("settlement_price IS NOT NULL AND NOT isnan(settlement_price)")
    settled = best_ranked(priced, ["instrument_id", "session"], F.col("settlement_is_final"), "snapshot_time", ["settlement_price"])
    return last.join(settled, ["instrument_id", "session"], "left")
