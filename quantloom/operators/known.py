"""Attributes as they were known at the time of an event.

A version of an entity's attributes has a valid time (what it speaks of) and a
recorded time (when it could first be seen). The plane of valid by recorded
time falls into disjoint rectangles, each owned by the version that is current
there: of those recorded by then and valid from then or before, the one with
the latest valid time, among these the one recorded last. A new version splits
the rectangle it falls into: the old owner keeps what lies before in recorded
time and below in valid time (``Plane``).

The plane is indexed by a grid of (valid cell, recorded cell). The shuffle unit
is (entity, cell), so a hot entity is spread over its cells: a version goes to
the cell of its valid and to that of its recorded time, an event likewise, and
of the rectangles that reach into an event's grid cell from cells that lie
before it both ways only the current one matters; it is carried in from a
summary with one row per grid cell. Within a cell the rectangles are grown in
recorded order and each event point is located among them by its valid time:
no pairs of versions and events are formed. The dynamic split of rectangles is
no window function, so that sweep runs on Arrow batches; it holds the open
rectangles of one cell only.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


class Plane:
    """The open rectangles of one cell, by valid time.

    Rectangle k is owned by versions[k], valid from starts[k] to starts[k + 1]
    and recorded from since[k] on.
    """

    __slots__ = ("ranks", "since", "starts", "versions")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.since: list[int] = []
        self.ranks: list[tuple] = []
        self.versions: list[int] = []

    def split(self, x: int, y: int, rank: tuple, version: int) -> tuple | None:
        """Enter a version at valid time x, recorded time y; returns the rectangle closed by it.

        Versions come in recorded order. (version, valid from, valid to or
        None, recorded from, recorded to), or None if nothing was there.
        """
        starts = self.starts
        k = bisect_right(starts, x) - 1
        if k < 0:
            starts.insert(0, x)
            self.since.insert(0, y)
            self.ranks.insert(0, rank)
            self.versions.insert(0, version)
            return None
        top = starts[k + 1] if k + 1 < len(starts) else None
        closed = (self.versions[k], starts[k], top, self.since[k], y)
        if starts[k] == x:
            if rank <= self.ranks[k]:
                return None
            self.since[k], self.ranks[k], self.versions[k] = y, rank, version
            return closed
        self.since[k] = y
        starts.insert(k + 1, x)
        self.since.insert(k + 1, y)
        self.ranks.insert(k + 1, rank)
        self.versions.insert(k + 1, version)
        return closed

    def locate(self, x: int) -> int | None:
        """The version that owns the open rectangle at valid time x."""
        k = bisect_right(self.starts, x) - 1
        return self.versions[k] if k >= 0 else None

    def open(self) -> list[tuple]:
        """What is still open: rectangles as of split(), recorded to None."""
        return [(v, s, self.starts[k + 1] if k + 1 < len(self.starts) else None, y, None) for k, (v, s, y) in enumerate(zip(self.versions, self.starts, self.since))]


def _walk(batches: Iterator[pa.RecordBatch], held: list[str], points: bool):
    """(batch, pool, hits, rectangles) per batch of rows sorted by e, c, y, versions before points.

    pool: columns `held` of the versions that hits and rectangles name by
    number. hits: (row of a point, version or None). rectangles: (e, c, version,
    valid from, to, recorded from, to), closed ones as they close.
    """
    plane, key, pool = Plane(), None, None
    for batch in batches:
        at = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("e", "c", "x", "y", "is_point", "v", "r", "id")}
        before = len(plane.versions)
        pool = [pa.concat_arrays([p, batch.column(batch.schema.get_field_index(c))]) if pool is not None else batch.column(batch.schema.get_field_index(c)) for c, p in zip(held, pool or [None] * len(held))]
        hits: list[tuple] = []
        rectangles: list[tuple] = []
        for i, (e, c, x, y, is_point, v, r, id_) in enumerate(zip(*at.values())):
            if (e, c) != key:
                if not points and key is not None:
                    rectangles += [(*key, *o) for o in plane.open()]
                plane, key = Plane(), (e, c)
            if is_point:
                hits.append((i, plane.locate(x)))
            else:
                closed = plane.split(x, y, (v, r, id_), before + i)
                if closed and not points and closed[3] < closed[4]:
                    rectangles.append((*key, *closed))
        yield batch, pool, hits, rectangles
        pool = [p.take(pa.array(plane.versions, pa.int64())) for p in pool]
        plane.versions = list(range(len(plane.versions)))
    if not points and key is not None:
        yield None, pool, [], [(*key, *o) for o in plane.open()]


def _located(rows: DataFrame, asked: list[str], held: list[str]) -> DataFrame:
    """The points of rows (is_point, e, c, x, y, columns) that lie in a rectangle: asked of the point and held of the version."""
    schema = rows.select(*asked, *held).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pool, hits, _ in _walk(batches, held, True):
            hits = [h for h in hits if h[1] is not None]
            if hits:
                row, version = pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())
                columns = [batch.column(batch.schema.get_field_index(c)).take(row) for c in asked] + [p.take(version) for p in pool]
                yield pa.RecordBatch.from_arrays(columns, names=[*asked, *held])

    return rows.mapInArrow(run, schema)


def _versions(df: DataFrame, entity: str, valid: str, recorded: str, id_: str, attributes: list[str]) -> DataFrame:
    rows = df.select(F.col(entity).alias("e"), F.unix_micros(valid).alias("v"), F.unix_micros(recorded).alias("r"), F.col(id_).alias("id"), *[F.col(a).alias(f"a{i}") for i, a in enumerate(attributes)])
    return rows.where("e IS NOT NULL AND v IS NOT NULL AND r IS NOT NULL AND id IS NOT NULL")


def _cell(us: Column | str, seconds: int) -> Column:
    return F.floor((F.col(us) if isinstance(us, str) else us) / (seconds * 1_000_000)).cast("long")


def _sorted(rows: DataFrame, *unit: str) -> DataFrame:
    return rows.repartition(*unit).sortWithinPartitions(*unit, "y", "is_point", "v", "r", "id")


def regions(df: DataFrame, entity: str, valid: str, recorded: str, id_: str, cell_seconds: int = DAY) -> DataFrame:
    """The rectangles by valid cell: entity, cell, id, valid_from, valid_to, recorded_from, recorded_to.

    Times in microseconds since 1970. valid_to null: to the end of the cell
    (and on, until a later cell has a version); recorded_to null: still
    current. Rectangles of an (entity, cell) are disjoint. Versions with a null
    entity, time or id are left out; repeats of a version give one rectangle.
    """
    v = _versions(df, entity, valid, recorded, id_, []).dropDuplicates(["e", "v", "r", "id"])
    rows = _sorted(v.select("*", _cell("v", cell_seconds).alias("c"), F.col("v").alias("x"), F.col("r").alias("y"), F.lit(False).alias("is_point")), "e", "c")
    out = rows.select("e", "c", "id", F.col("v").alias("valid_from"), F.col("v").alias("valid_to"), F.col("r").alias("recorded_from"), F.col("r").alias("recorded_to"))
    names, types = out.columns, rows.select("e").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity_type = None
        for batch, pool, _, found in _walk(batches, ["id"], False):
            entity_type = batch.schema.field("e").type if batch is not None else entity_type
            if found:
                e, c, version, *times = zip(*found)
                columns = [pa.array(e, entity_type), pa.array(c, pa.int64()), pool[0].take(pa.array(version, pa.int64())), *[pa.array(t, pa.int64()) for t in times]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"{n} bigint" for n in names[3:])
    found = rows.mapInArrow(run, f"e {types['e'].dataType.simpleString()}, c bigint, id {rows.schema['id'].dataType.simpleString()}, {fields}")
    return found.withColumnsRenamed({"e": entity, "c": "cell", "id": id_})


def known_at(
    events: DataFrame,
    event_id: str,
    event_time: str,
    versions: DataFrame,
    entity: str,
    valid: str,
    recorded: str,
    id_: str,
    attributes: list[str] | None = None,
    cell_seconds: int = DAY,
    event_valid: str | None = None,
) -> DataFrame:
    """(event_id, id_, attributes...): each event with the version known at its time.

    The event's point is (valid time asked for, time of the event). Of the
    versions of its entity recorded at or before the event's time and valid
    from the time asked for or before, the one with the latest valid time
    counts, among these the one recorded last (on a tie the larger id).
    event_valid: column with the valid time asked for; by default it is the
    event's time, moved on by as much as any version is valid ahead of its
    recording, so that whatever has been recorded counts.

    Events without an id, entity or time and events before the first record of
    their entity give no row. Repeats of an event give one row; if they differ
    in time, the latest holds. Attributes may be null or NaN and are handed on
    as they are. Empty tables give no rows.
    """
    attributes = attributes or []
    names = [f"a{i}" for i in range(len(attributes))]
    held = ["v", "r", "id", *names]
    v = _versions(versions, entity, valid, recorded, id_, attributes).select("*", _cell("v", cell_seconds).alias("vc"), _cell("r", cell_seconds).alias("rc"))
    if event_valid is None:
        ahead = v.agg(F.greatest(F.max(F.col("v") - F.col("r")), F.lit(0)).alias("ahead")).scalar()  # one row
        asked_for = F.unix_micros(event_time) + F.coalesce(ahead, F.lit(0))
    else:
        asked_for = F.unix_micros(event_valid)
    points = events.select(F.col(event_id).alias("event"), F.col(entity).alias("e"), asked_for.alias("x"), F.unix_micros(event_time).alias("y")).where("event IS NOT NULL AND e IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    points = points.select("*", _cell("x", cell_seconds).alias("vc"), _cell("y", cell_seconds).alias("rc"))
    nothing = [F.lit(None).cast(v.schema[c].dataType).alias(c) for c in held]
    no_event = F.lit(None).cast(points.schema["event"].dataType).alias("event")

    # The version current at the lower corner of each grid cell asked for, from one row per grid cell.
    tops = v.groupBy("e", "vc", "rc").agg(F.max(F.struct(*held)).alias("top")).select("e", F.col("vc").alias("x"), F.col("rc").alias("y"), "top.*", F.lit(None).cast("long").alias("to"), F.lit(False).alias("is_point"))
    asked = points.select("e", "vc", "rc").distinct().select("e", (F.col("vc") - 1).alias("x"), (F.col("rc") - 1).alias("y"), *nothing, F.col("vc").alias("to"), F.lit(True).alias("is_point"))
    corners = _sorted(tops.unionByName(asked).withColumn("c", F.lit(0).cast("long")), "e")
    carried = _located(corners, ["e", "to"], held)

    both = lambda a, b: F.explode(F.array_distinct(F.array(a, b))).alias("c")
    rows = (
        v.select("e", both("vc", "rc"), F.col("v").alias("x"), F.col("r").alias("y"), F.lit(False).alias("is_point"), no_event, *held)
        .unionByName(carried.select("e", F.col("to").alias("c"), F.col("v").alias("x"), F.col("r").alias("y"), F.lit(False).alias("is_point"), no_event, *held))
        .unionByName(points.select("e", both("vc", "rc"), "x", "y", F.lit(True).alias("is_point"), "event", *nothing))
    )
    located = _located(_sorted(rows, "e", "c"), ["event", "y"], held)
    one = located.groupBy("event").agg(F.max(F.struct("y", *held)).alias("at"))
    return one.select(F.col("event").alias(event_id), F.col("at.id").alias(id_), *[F.col(f"at.{n}").alias(a) for n, a in zip(names, attributes)])
