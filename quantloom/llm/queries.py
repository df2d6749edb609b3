"""Queries of the subpackage: nearest matches, encoding, mixing and residue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import encode, mix, nearest, residue
from quantloom.llm.sql import SQL  # noqa: F401
from quantloom.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    sides = [
        nearest.left_side(table(spark, d, "trades"), "trade_id", "asset", "entry_time", "saved_at"),
        nearest.left_side(table(spark, d, "options_oi_snapshot"), "snapshot_id", "underlying", "snapshot_time", "arrived_at"),
        nearest.right_side(table(spark, d, "candles_1m"), "candle_id", "symbol", "ts", F.col("close").isNotNull() & ~F.isnan("close")),
    ]
    return nearest.match_bounded(spark, sides, 90).withColumnRenamed("match_id", "candle_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> mix.Mix:
    """The largest mix in which every source that has text takes its target share."""
    return mix.prepare(table(spark, d, "documents"), table(spark, d, "source_targets"), "exact")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.positions(_mix(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    m = _mix(spark, d)
    return mix.report(m, mix.positions(m))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p5_found, p8_ids, p9_mix, p9_shares, p10_found)}
