"""History of changing attributes from periodic snapshots.

Tree reduction: a snapshot is a run of one unit interval at its day. In round
k the runs of two neighbouring blocks of 2^k days meet; the right one is
absorbed if it shows the same payload as the run left of it. After as many
rounds as the days have bits, no two neighbouring runs are equal. The lower
rounds run by (entity, shard of days), so that an entity with very many
snapshots is spread; only the runs that remain are shuffled by entity for the
upper rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days up to 9999-12-31 have 22 bits; the lower rounds join blocks within 2^LOWER days.
LOWER, BITS = 8, 22
END = "9999-12-31"


def _rounds(runs: DataFrame, group: list[str], values: list[str], lo: int, hi: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy("pos")
    same: Column = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"left.{v}"))
    for k in range(lo, hi):
        runs = runs.withColumn("left", F.lag(F.struct("pos", *values)).over(order))
        meet = F.expr(f"shiftright(left.pos, {k + 1}) = shiftright(pos, {k + 1})")
        runs = runs.where(F.col("left").isNull() | ~(meet & same)).drop("left")
    return runs


def versions(df: DataFrame, entity: str, day: str, loaded: str, attributes: dict[str, Column]) -> DataFrame:
    """entity, valid_from, valid_to (STRING days), attributes: one row per version.

    Of the rows of an entity and day the one loaded last holds as a whole
    (ties: greatest content). A null attribute says nothing: the last known
    value stays. A version starts on the first day that shows another value
    and ends, exclusive, where the next starts; the last ends 9999-12-31. A
    return to former values is a new version; days without the entity change
    nothing; days before anything is known belong to no version. Rows without
    entity or day are left out. NaN counts as null.
    """
    names = [f"a{i}" for i in range(len(attributes))]
    clean = [c.alias(n) for n, c in zip(names, attributes.values())]
    rows = df.select(F.col(entity).alias("e"), F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).alias("pos"), F.struct(F.col(loaded).alias("at"), *clean).alias("x")).where("e IS NOT NULL AND pos IS NOT NULL")
    units = rows.groupBy("e", "pos", F.expr(f"shiftright(pos, {LOWER})").alias("shard")).agg(F.max("x").alias("x")).select("e", "shard", "pos", *[F.col(f"x.{n}").alias(n) for n in names])
    units = units.repartition("e", "shard")
    fill = Window.partitionBy("e", "shard").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    units = units.withColumns({n: F.last(n, True).over(fill) for n in names})
    runs = _rounds(units, ["e", "shard"], names, 0, LOWER).drop("shard")
    runs = runs.repartition("e")
    known = Window.partitionBy("e").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumns({n: F.last(n, True).over(known) for n in names}).where(" OR ".join(f"{n} IS NOT NULL" for n in names))
    # Filling across shards can make neighbours within a shard equal again, so all rounds run.
    runs = _rounds(runs, ["e"], names, 0, BITS)
    until = F.lead("pos").over(Window.partitionBy("e").orderBy("pos"))
    as_day = lambda c: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), c), "yyyy-MM-dd")
    return runs.select(F.col("e").alias(entity), as_day(F.col("pos")).alias("valid_from"), F.coalesce(as_day(until), F.lit(END)).alias("valid_to"), *[F.col(n).alias(a) for n, a in zip(names, attributes)])


def cents(c: Column) -> Column:
    """A price in whole cents; NaN and infinity give null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.round(c * 100) + 0.0)
