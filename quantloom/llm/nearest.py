"""Matching records by nearest time: a stateful streaming join.

Both sides come as one stream of (entity, time) records. State is kept by
bucket of (entity, time cell): a reference record is sent to the bucket of its
own cell and, near an edge, to the neighbour's within the tolerance, so a hot
entity is spread over its cells, every record finds all its candidates in one
bucket, and one call of the state function serves many cells at once. Both sides are
buffered; a left record is emitted once the watermark has passed its tolerance
horizon, when no nearer candidate can come any more, and candidates are evicted
once no open record can want them. Buffers are numpy arrays packed as bytes, one
state row per bucket; entities are told apart by 128 bits of hash.

A bounded input is replayed in slices of time: it is laid out once by ranges of
time, and the stream takes one slice after the other, so that no record is late
whatever order they came in, the watermark moves on with each slice, and the
state never holds more than the cells of two slices. A closing mark in the far
future moves it past every horizon in the end. Results go to a file sink in the
shared folder; a record that was sent again with other values is emitted again
with its version, and the reader keeps the latest version.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.session import remove, remove_at_exit, shared_dir

#: Far beyond any event, the time of the closing mark.
CLOSING = "2262-01-01 00:00:00"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "record_id bigint, version bigint, match_id bigint"
STATE = "left binary, right binary"
RIGHT = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("ts", "<i8"), ("id", "<i8")])
LEFT = np.dtype([*((n, RIGHT[n]) for n in RIGHT.names), ("version", "<i8")])


def left_side(df: DataFrame, record_id: str, entity: str, ts: str, version: str) -> DataFrame:
    """Records to match. One without entity or time is handed on: it matches nothing, but match_bounded() lets it hide earlier versions."""
    return df.select(F.lit(True).alias("is_left"), F.col(entity).alias("entity"), F.col(ts).alias("ts"), F.col(record_id).cast("long").alias("id"), F.unix_micros(version).alias("version"))


def right_side(df: DataFrame, match_id: str, entity: str, ts: str, counts: Column) -> DataFrame:
    """Reference records; those without entity, time or id, or that do not count, are left out."""
    return df.where(counts).select(F.lit(False).alias("is_left"), F.col(entity).alias("entity"), F.col(ts).alias("ts"), F.col(match_id).cast("long").alias("id"), F.lit(None).cast("long").alias("version")).where("entity IS NOT NULL AND ts IS NOT NULL AND id IS NOT NULL")


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The rows sorted by their fields, repeats left out."""
    rows = rows[np.lexsort([rows[n] for n in reversed(rows.dtype.names)])]
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for n in rows.dtype.names:
        new[1:] |= rows[n][1:] != rows[n][:-1]
    return rows[new]


def _axis(left: np.ndarray, right: np.ndarray, tolerance_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of both sides on one time axis, on which entities lie farther apart than the tolerance."""
    h1, h2 = (np.concatenate([left[n], right[n]]) for n in ("h1", "h2"))
    ts = np.concatenate([left["ts"], right["ts"]])
    order = np.lexsort((ts, h2, h1))
    h1, h2, ts = h1[order], h2[order], ts[order]
    step = np.zeros(len(ts), np.int64)
    other = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    step[1:] = np.where(other, 2 * tolerance_us + 2, ts[1:] - ts[:-1])
    place = np.empty(len(ts), np.int64)
    place[order] = np.cumsum(step)
    return place[: len(left)], place[len(left) :]


def nearest(left: np.ndarray, right: np.ndarray, tolerance_us: int) -> np.ndarray:
    """For each left record the id of the nearest right one of its entity within the tolerance, else -1.

    right is sorted by its fields. On a tie in distance the earlier record
    holds, of equal times the smaller id.
    """
    out = np.full(len(left), -1, np.int64)
    if not len(right) or not len(left):
        return out
    at, ref = _axis(left, right, tolerance_us)
    first = np.concatenate(([True], ref[1:] != ref[:-1]))
    ref, ids = ref[first], right["id"][first]
    after = np.searchsorted(ref, at, "left")
    lo, hi = np.clip(after - 1, 0, None), np.clip(after, None, len(ref) - 1)
    back = np.where(after > 0, at - ref[lo], np.iinfo(np.int64).max)
    ahead = np.where(after < len(ref), ref[hi] - at, np.iinfo(np.int64).max)
    pick, gap = np.where(back <= ahead, lo, hi), np.minimum(back, ahead)
    return np.where(gap <= tolerance_us, ids[pick], -1)


def _records(pdf: pd.DataFrame, kind: np.dtype) -> np.ndarray:
    out = np.empty(len(pdf), kind)
    for n in kind.names:
        out[n] = (pdf[n].fillna(-1) if n == "version" else pdf[n]).to_numpy(np.int64)
    return out


def _step(tolerance_us: int):
    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            held = state.get
            lefts, rights = [np.frombuffer(held[0], LEFT)], [np.frombuffer(held[1], RIGHT)]
        else:
            lefts, rights = [np.empty(0, LEFT)], [np.empty(0, RIGHT)]
        if not state.hasTimedOut:
            for pdf in pdfs:
                is_left = pdf["is_left"].to_numpy(bool)
                lefts.append(_records(pdf[is_left], LEFT))
                rights.append(_records(pdf[~is_left], RIGHT))
        left, right = _distinct(np.concatenate(lefts)), _distinct(np.concatenate(rights))
        passed = state.getCurrentWatermarkMs() * 1000
        due = left["ts"] + tolerance_us < passed
        if due.any():
            yield pd.DataFrame({"record_id": left["id"][due], "version": left["version"][due], "match_id": nearest(left[due], right, tolerance_us)})
        left = left[~due]
        # A candidate is wanted by open records and by those that may still come.
        oldest = min(passed, int(left["ts"].min())) if len(left) else passed
        right = right[right["ts"] >= oldest - tolerance_us]
        if not len(left) and not len(right):
            if state.exists:
                state.remove()
            return
        state.update((left.tobytes(), right.tobytes()))
        horizon = (int(left["ts"].min()) if len(left) else int(right["ts"].max())) + tolerance_us
        state.setTimeoutTimestamp(max(horizon // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return step


def stream(sides: list[DataFrame], tolerance_seconds: int, cell_seconds: int, delay: str, buckets: int | None = None) -> DataFrame:
    """The streaming join of left_side() and right_side() streams: record_id, version, match_id (-1: none).

    buckets: units of the state, by default two for each shuffle partition.
    """
    tolerance = tolerance_seconds * 1_000_000
    cell = cell_seconds * 1_000_000
    both = sides[0]
    for s in sides[1:]:
        both = both.unionByName(s)
    buckets = buckets or 2 * int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    us = F.unix_micros("ts")
    own = F.floor(us / cell).cast("long")
    lo, hi = F.floor((us - tolerance) / cell).cast("long"), F.floor((us + tolerance) / cell).cast("long")
    unit = lambda c: F.pmod(F.xxhash64("entity", c), F.lit(buckets)).cast("int")
    homes = F.when(F.col("is_left"), F.array(unit(own))).otherwise(F.array_distinct(F.transform(F.sequence(lo, hi), unit)))
    rows = both.withWatermark("ts", delay).withColumn("bucket", F.explode(homes))
    # One condition on both columns, so that it stays behind the watermark, which the closing mark is to move.
    rows = rows.where(F.when(F.col("entity").isNotNull(), F.col("ts").isNotNull()).otherwise(False))
    rows = rows.select("bucket", "ts", "is_left", F.xxhash64("entity").alias("h1"), F.xxhash64(F.lit(1), "entity").alias("h2"), us.alias("us"), "id", "version")
    rows = rows.withColumnsRenamed({"ts": "event_time", "us": "ts"})
    return rows.groupBy("bucket").applyInPandasWithState(_step(tolerance), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _make(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def _publish(spark: SparkSession, files: list, folder: str) -> None:
    """Move files into the folder that the stream watches; each appears at once and whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for f in files:
        f.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(f, path(f"{folder}/{f.getParent().getName()}-{f.getName()}"))


def _files(spark: SparkSession, folder: str) -> list:
    """The data files of a folder by name, which is the order of the partitions written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((f.getPath() for f in listed if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())


def match_bounded(
    spark: SparkSession, sides: list[DataFrame], tolerance_seconds: int = 90, cell_seconds: int = 24 * 3600, delay: str = "1 seconds", slice_rows: int = 50_000_000, least_slices: int = 4, buckets: int | None = None, report: dict | None = None
) -> DataFrame:
    """(record_id, match_id) of a bounded replay: runs the stream to its end and reads its result.

    sides are left_side() and right_side() frames of whole tables, rows in any
    order. They are replayed in slices of about slice_rows rows, at least
    least_slices. Of the versions of a record the latest holds; one without a
    match, entity or time hides earlier matches. Records without id are left
    out. Empty inputs give an empty result. buckets: see stream(). report takes
    the number of batches and the most state rows held.
    """
    both = sides[0]
    for x in sides[1:]:
        both = both.unionByName(x)
    base = f"{shared_dir(spark)}/nearest-{uuid.uuid4().hex}"
    timed = both.where("entity IS NOT NULL AND ts IS NOT NULL AND id IS NOT NULL")
    slices = max(least_slices, -(-timed.count() // slice_rows))
    width = max(1, spark.sparkContext.defaultParallelism)
    timed.repartitionByRange(slices * width, "ts").write.parquet(f"{base}/laid")
    mark = spark.range(1).select(F.lit(False).alias("is_left"), F.lit(None).cast(both.schema["entity"].dataType).alias("entity"), F.to_timestamp(F.lit(CLOSING)).alias("ts"), F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("version"))
    for n in (1, 2):  # the first moves the watermark, the second is the batch in which it has moved
        mark.coalesce(1).write.parquet(f"{base}/close{n}")
    laid = _files(spark, f"{base}/laid")
    steps = [laid[i : i + width] for i in range(0, len(laid), width)] + [_files(spark, f"{base}/close{n}") for n in (1, 2)]
    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.providerClass": ROCKS}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        _make(spark, f"{base}/in")
        _publish(spark, steps[0], f"{base}/in")
        out = stream([spark.readStream.schema(both.schema).parquet(f"{base}/in")], tolerance_seconds, cell_seconds, delay, buckets)
        query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    try:
        query.processAllAvailable()
        for files in steps[1:]:
            _publish(spark, files, f"{base}/in")
            query.processAllAvailable()
        if report is not None:
            held = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
            report |= {"batches": len(steps), "most_held": max(held, default=0)}
    finally:
        query.stop()
    for part in ("laid", "close1", "close2", "in", "state"):
        remove(spark, f"{base}/{part}")
    remove_at_exit(spark, base)
    found = spark.read.schema(OUT).parquet(f"{base}/out")
    blank = both.where("is_left AND id IS NOT NULL AND (entity IS NULL OR ts IS NULL)").select(F.col("id").alias("record_id"), F.coalesce("version", F.lit(-1)).alias("version"), F.lit(-1).cast("long").alias("match_id"))
    last = found.unionByName(blank).groupBy("record_id").agg(F.max(F.struct("version", "match_id")).alias("x"))
    return last.where("x.match_id >= 0").select("record_id", F.col("x.match_id").alias("match_id"))
