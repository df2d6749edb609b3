"""Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bar_stream(tape: DataFrame, keys: list[str], ts: str, price: str, size: str, width: str = "1 minute", delay: str = "30 seconds") -> DataFrame:
    """Tumbling OHLCV bars of a stream, each once its window is past the watermark."""
    at = F.struct(ts)
    w = tape.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys)
    return w.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(size).alias("volume")).select(*keys, F.col("window.start").alias("bucket"), "open", "high", "low", "close", "volume")


def once(stream: DataFrame, id_: str, ts: str, delay: str) -> DataFrame:
    """Each id once, as long as its repeats come within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_])


def session_close(stream: DataFrame, key: list[str], ts: str, value: Column, delay: str = "7 days") -> DataFrame:
    """key, day, value: the latest value of each day, given out when the day has been closed for the delay; what comes later is ignored."""
    s = stream.withWatermark(ts, delay).withColumn("_v", value)
    return s.groupBy(F.window(ts, "1 day"), *key).agg(F.max_by("_v", ts).alias("value")).select(*key, F.to_date("window.start").alias("day"), "value")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and reads what it wrote; folder is shared by the executors."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
