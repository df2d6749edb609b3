"""Irregular readings onto a regular grid of seconds.

A source's readings are cut into time shards; (source, shard) is the unit of
the shuffle, so a long or busy source is spread. Each shard owns the intervals
that end at its readings and gets the neighbouring readings it lacks (the
halo: two before, one after) from a summary with one row per shard, however
many empty shards lie between. An interval of up to max_gap seconds belongs to
a segment: its seconds are carried over and interpolated by a shape-preserving
monotone cubic (harmonic-mean slopes, so no overshoot). Longer intervals end a
segment; their seconds are marked once the carry runs out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fine(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def last_copies(df: DataFrame, id_: str, received: str, source: list[str], ts: str, values: list[str]) -> DataFrame:
    """s0.., ts, id, usable, v0..: of the copies of a reading the one received last.

    Copies received at the same instant are told apart by content. Readings
    without id, source or time are left out. Usable: every value is there,
    neither null nor NaN.
    """
    s = [f"s{i}" for i in range(len(source))]
    v = [f"v{i}" for i in range(len(values))]
    usable = F.lit(True)
    for c in values:
        usable = usable & _fine(c)
    rows = df.select(
        F.col(id_).alias("id"),
        F.struct(F.col(received).alias("at"), F.col(ts).alias("ts"), *[F.col(c).alias(a) for c, a in zip(source, s)], usable.alias("usable"), *[F.col(c).cast("double").alias(a) for c, a in zip(values, v)]).alias("x"),
    ).where("id IS NOT NULL")
    one = rows.groupBy("id").agg(F.max("x").alias("x")).select("id", "x.*").drop("at")
    return one.where(" AND ".join(f"{c} IS NOT NULL" for c in [*s, "ts"]))


def _second(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 1_000_000)


def _with_halo(readings: DataFrame, n_source: int, shard_seconds: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(readings with the shard's halo, sources without a usable reading, source columns).

    Each usable reading gets its neighbours p2, p1 (before) and n1 (after) as
    structs, whatever shard they lie in, and src_lo, src_hi: the times of the
    source's first and last reading, usable or not.
    """
    s = [f"s{i}" for i in range(n_source)]
    base = readings.withColumn("shard", F.floor(F.unix_micros("ts") / (shard_seconds * 1_000_000)).cast("int"))
    base = base.repartition(*[F.col(c) for c in [*s, "shard"]])
    reading = F.struct("ts", "id", *[c for c in readings.columns if c.startswith("v")])
    forward = Window.partitionBy(*s, "shard").orderBy("usable", "ts", "id")
    rows = base.withColumns({"p1": F.lag(reading, 1).over(forward), "p1_usable": F.lag("usable", 1).over(forward), "p2": F.lag(reading, 2).over(forward), "p2_usable": F.lag("usable", 2).over(forward), "n1": F.lead(reading, 1).over(forward)})
    # Unusable readings sort first: the neighbours of a usable one are usable or none.
    rows = rows.withColumns({"p1": F.when(F.col("p1_usable"), F.col("p1")), "p2": F.when(F.col("p2_usable"), F.col("p2"))}).drop("p1_usable", "p2_usable")
    tail = F.col("n1").isNull() & F.col("usable")
    summary = rows.groupBy(*s, "shard").agg(
        F.min(F.when(F.col("usable") & F.col("p1").isNull(), reading)).alias("first"),
        F.max(F.when(tail, reading)).alias("last"),
        F.max(F.when(tail, F.col("p1"))).alias("last2"),
        F.min("ts").alias("lo"),
        F.max("ts").alias("hi"),
    )
    order = Window.partitionBy(*s).orderBy("shard")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # The last two readings before a shard: those of one shard, or one each of two.
    summary = summary.withColumn("last_before", F.last("last", True).over(earlier))
    pair = F.when(F.col("last").isNotNull(), F.struct(F.col("last").alias("a"), F.coalesce("last2", "last_before").alias("b")))
    summary = summary.withColumns(
        {
            "before": F.last(pair, True).over(earlier),
            "after": F.last("first", True).over(Window.partitionBy(*s).orderBy(F.desc("shard")).rowsBetween(Window.unboundedPreceding, -1)),
            "src_lo": F.min("lo").over(Window.partitionBy(*s)),
            "src_hi": F.max("hi").over(Window.partitionBy(*s)),
            "src_last": F.max("last").over(Window.partitionBy(*s)),
            "nth": F.row_number().over(order),
        }
    )
    halo = summary.select(*s, "shard", "before", "after", "src_lo", "src_hi")
    rows = rows.where("usable").join(halo, [*s, "shard"])
    rows = rows.withColumns(
        {
            "p2": F.when(F.col("p1").isNull(), F.col("before.b")).otherwise(F.coalesce("p2", "before.a")),
            "p1": F.coalesce("p1", "before.a"),
            "n1": F.coalesce("n1", "after"),
        }
    ).drop("before", "after")
    return rows, summary.where("nth = 1 AND src_last IS NULL").select(*s, "src_lo", "src_hi"), s


def _slope(y0: Column, y1: Column, h: Column) -> Column:
    return F.when(h > 0, (y1 - y0) / F.when(h > 0, h))


def _inner_tangent(d0: Column, d1: Column, h0: Column, h1: Column) -> Column:
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 > 0, (w0 + w1) / (w0 / F.when(d0 != 0, d0) + w1 / F.when(d1 != 0, d1))).otherwise(0.0)


def _end_tangent(d0: Column, d1: Column, h0: Column, h1: Column) -> Column:
    m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(m) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0).otherwise(m)


def _cubic(y0: Column, y1: Column, m0: Column, m1: Column, h: Column) -> list[Column]:
    """Coefficients, lowest first, of the cubic on 0..1 with these values and tangents at its ends."""
    return [y0, h * m0, 3.0 * (y1 - y0) - h * (2.0 * m0 + m1), 2.0 * (y0 - y1) + h * (m0 + m1)]


def regular_series(readings: DataFrame, source: list[str], values: list[str], level: list[str], flow: list[str], max_gap: int = 30, shard_seconds: int = 900) -> DataFrame:
    """One row per source and second: carried and interpolated levels, flows, status.

    Columns: source.., slot, status, reading_id, and per level <name> (the
    second's last reading, or the last one carried over) and <name>_smooth
    (monotone cubic at the start of the second, null outside a segment), per
    flow its sum over the second's readings (0 without one). slot is the epoch
    second, from that of the source's first reading to that of its last, usable
    or not. status: read; filled, within a segment, where the cubic gives every
    level; carried, after a segment's end, from a reading at most max_gap
    seconds old at the second's start; gap (levels null, reading_id -1), also
    before the first usable reading and for sources without any. Of readings at
    one instant the one with the larger id is the later.

    A reading that is the first of its second brings this second and those
    since the reading before it, so every second is made once, by the shard
    that holds its readings, and nothing is shuffled again.
    """
    rows, unread, s = _with_halo(readings, len(source), shard_seconds)
    v = {c: f"v{i}" for i, c in enumerate(values)}
    us = F.unix_micros
    rows = rows.withColumn("sec", _second(F.col("ts")))
    of_second = Window.partitionBy(*s, "shard", "sec").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"own": F.last(F.struct("id", *v.values())).over(of_second)} | {f"sum_{c}": F.sum(v[c]).over(of_second) for c in flow})
    prev_sec = _second(F.col("p1.ts"))
    first_of_second, last = F.col("p1").isNull() | (prev_sec < F.col("sec")), F.col("n1").isNull()
    rows = rows.where(first_of_second | last)
    gap = lambda a, b: (us(b) - us(a)) / 1_000_000.0
    short = lambda c: F.when((c > 0) & (c <= max_gap), c)
    # The interval that ends at the reading, and its neighbours; a longer one is no part of a segment.
    rows = rows.withColumns({"h": short(gap("p1.ts", "ts")), "hp": short(gap("p2.ts", "p1.ts")), "hn": short(gap("ts", "n1.ts"))})
    tangents = {}
    for c in level:
        yp, y0, y1, yn = (F.col(x) for x in (f"p2.{v[c]}", f"p1.{v[c]}", v[c], f"n1.{v[c]}"))
        h, hp, hn = F.col("h"), F.col("hp"), F.col("hn")
        d, dp, dn = _slope(y0, y1, h), _slope(yp, y0, hp), _slope(y1, yn, hn)
        left = F.when(hp.isNotNull(), _inner_tangent(dp, d, hp, h)).when(hn.isNotNull(), _end_tangent(d, dn, h, hn)).otherwise(d)
        right = F.when(hn.isNotNull(), _inner_tangent(d, dn, h, hn)).when(hp.isNotNull(), _end_tangent(d, dp, h, hp)).otherwise(d)
        tangents |= {f"m0_{c}": left, f"m1_{c}": right}
    rows = rows.withColumns(tangents)
    # Everything that does not depend on the second is worked out before the seconds are unfolded.
    fixed = {f"c{i}_{c}": e for c in level for i, e in enumerate(_cubic(F.col(f"p1.{v[c]}"), F.col(v[c]), F.col(f"m0_{c}"), F.col(f"m1_{c}"), F.col("h")))}
    rows = rows.withColumns(fixed | {"us": us("ts"), "p_us": us("p1.ts")})
    # From the second after the reading before (or the source's first) to its own; the last reading also to the source's last.
    start = F.when(~first_of_second, F.col("sec") + 1).otherwise(F.coalesce(prev_sec + 1, _second(F.col("src_lo"))))
    end = F.when(last, _second(F.col("src_hi"))).otherwise(F.col("sec"))
    rows = rows.withColumn("slot", F.explode(F.when(start <= end, F.sequence(start, end))))
    at = F.col("slot") * 1_000_000
    after, read = F.col("slot") > F.col("sec"), F.col("slot") == F.col("sec")
    u = F.when(at == F.col("us"), F.lit(1.0)).otherwise((at - F.col("p_us")) / 1_000_000.0 / F.col("h"))
    curve = lambda c: ((F.col(f"c3_{c}") * u + F.col(f"c2_{c}")) * u + F.col(f"c1_{c}")) * u + F.col(f"c0_{c}")
    smooth = {c: F.when(~after & F.col("h").isNotNull(), curve(c)).when(read & (at == F.col("us")) & F.col("hn").isNotNull(), F.col(v[c])) for c in level}
    rows = rows.withColumns({f"{c}_smooth": e for c, e in smooth.items()})
    inside = F.col("h").isNotNull() & ~after
    for c in level:
        inside = inside & F.col(f"{c}_smooth").isNotNull()
    carrier = F.when(after, F.col("own")).otherwise(F.struct(F.col("p1.id").alias("id"), *[F.col(f"p1.{x}").alias(x) for x in v.values()]))
    fresh = at - F.when(after, F.col("us")).otherwise(F.col("p_us")) <= max_gap * 1_000_000
    rows = rows.withColumn("status", F.when(read, "read").when(inside, "filled").when(fresh, "carried").otherwise("gap"))
    known = F.when(F.col("status") != "gap", F.when(F.col("status") == "read", F.col("own")).otherwise(carrier))
    rows = rows.withColumn("known", known)
    made = rows.select(
        *s,
        "slot",
        "status",
        F.coalesce("known.id", F.lit(-1)).cast("long").alias("reading_id"),
        *[F.col(f"known.{v[c]}").alias(c) for c in level],
        *[f"{c}_smooth" for c in level],
        *[F.when(F.col("status") == "read", F.col(f"sum_{c}")).otherwise(F.lit(0.0)).alias(c) for c in flow],
    )
    unread = unread.select(
        *s,
        F.explode(F.sequence(_second(F.col("src_lo")), _second(F.col("src_hi")))).alias("slot"),
        F.lit("gap").alias("status"),
        F.lit(-1).cast("long").alias("reading_id"),
        *[F.lit(None).cast("double").alias(c) for c in [*level, *[f"{c}_smooth" for c in level]]],
        *[F.lit(0.0).alias(c) for c in flow],
    )
    return made.unionByName(unread).select(*[F.col(a).alias(c) for c, a in zip(source, s)], F.col("slot").cast("long").alias("slot"), "status", "reading_id", *level, *[f"{c}_smooth" for c in level], *flow)


def missing_slots(series: DataFrame) -> DataFrame:
    """The seconds of a regular_series() without a usable reading, with what is carried into them (-1: marked as a gap)."""
    return series.where("status <> 'read'").drop("status")
