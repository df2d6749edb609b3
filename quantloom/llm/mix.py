"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over training time t from 0 to 1, piecewise
linear, whose integral is its share; at every t the weights of all sources add
to one. A source's cumulative token demand is the integral of its schedule. Its
documents, in a fixed random order and as many times over as needed, lie on its
token axis; inverting the demand at the middle of a document gives the training
position, and a range sort by position gives the order of training.

The token axis of a source is a running sum over all its documents. It is cut
into buckets of the random order: totals per bucket, their running sum, and a
running sum within each bucket, so that no task holds a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.encode import token_counts
from quantloom.session import cut

#: More sources than this would not be a mixing table but data.
MOST_SOURCES = 10_000
#: Documents a bucket of the token axis holds on average.
BUCKET_DOCS = 20_000


def spelled(source: Column) -> Column:
    """One spelling of a source name: lower case, words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"[\s _-]+", " "))), " ", "_")


@dataclass(frozen=True)
class Share:
    """What one source brings and what it is to give."""

    source: str
    target: float
    max_repeats: int
    documents: int
    tokens: int
    need: float


def plan(stats: list[tuple[str, float, int, int, int]], total_tokens: int | str | None = None) -> list[Share]:
    """Token demand by source from (source, target share, max repeats, documents, tokens).

    total_tokens: the size of the mix, None for the size of the corpus (all
    tokens of the sources that take part). Sources that run out within their
    repeats give all they may and the others share the rest in proportion, each
    within its repeats; the shares reached then differ from the targets and are
    reported. "exact": the largest size at which no source runs out, so every
    source that has tokens reaches its share (shares renewed over these).
    """
    able = [s for s in stats if s[1] > 0 and s[4] > 0 and s[2] > 0]
    if not able:
        return [Share(*s, 0.0) for s in stats]
    weight = sum(s[1] for s in able)
    most = {s[0]: float(s[4]) * s[2] for s in able}
    need = dict.fromkeys(most, 0.0)
    if total_tokens == "exact":
        total = min(most[s[0]] * weight / s[1] for s in able)
        need = {s[0]: total * s[1] / weight for s in able}
    else:
        rest, free = float(sum(s[4] for s in able) if total_tokens is None else total_tokens), list(able)
        while free and rest > 1e-9:
            w = sum(s[1] for s in free)
            short = [s for s in free if most[s[0]] - need[s[0]] <= rest * s[1] / w]
            if not short:
                for s in free:
                    need[s[0]] += rest * s[1] / w
                break
            for s in short:
                rest -= most[s[0]] - need[s[0]]
                need[s[0]] = most[s[0]]
            free = [s for s in free if s not in short]
    return [Share(*s, need.get(s[0], 0.0)) for s in stats]


def curriculum(shares: list[Share], tilt: float = 0.5) -> dict[str, list[tuple[float, float]]]:
    """Knots (t, relative weight) by source: upweighted sources come late, the bulk early.

    A source's weight runs linearly from 1 - a to 1 + a, where a grows with the
    log of target over natural share and the a's, weighted by share, add to
    zero: so the weights of all sources add to one at every t, and each
    schedule's integral is its share. |a| is at most tilt, below 1.
    """
    from math import log

    used = [s for s in shares if s.need > 0]
    if not used:
        return {}
    need, tokens = sum(s.need for s in used), sum(s.tokens for s in used)
    up = {s.source: log((s.need / need) / (s.tokens / tokens)) for s in used}
    mean = sum(up[s.source] * s.need / need for s in used)
    widest = max(abs(u - mean) for u in up.values())
    return {k: [(0.0, 1 - tilt * (u - mean) / widest), (1.0, 1 + tilt * (u - mean) / widest)] if widest > 1e-12 else [(0.0, 1.0), (1.0, 1.0)] for k, u in up.items()}


def _segments(knots: list[tuple[float, float]]) -> list[dict]:
    """Integrated schedule: t0, width, w0, slope and cumulative share before, the whole being 1."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, before, out = sum(areas), 0.0, []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        out.append({"t0": t0, "h": t1 - t0, "w0": w0 / whole, "k": (w1 - w0) / (t1 - t0) / whole, "c0": before})
        before += area / whole
    return out


def _position(share: Column, segments: Column) -> Column:
    """t at which a schedule has given this share of its demand."""
    s = F.element_at(F.filter(segments, lambda x: x["c0"] <= share), -1)
    m = F.greatest(share - s["c0"], F.lit(0.0))
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * s["k"] * m, F.lit(0.0)))
    return F.least(s["t0"] + F.when(m > 0, 2 * m / (s["w0"] + root)).otherwise(0.0), s["t0"] + s["h"])


@dataclass
class Mix:
    """sized: (doc_id, source, n_tokens), checkpointed; shares: the plan."""

    sized: DataFrame
    shares: list[Share]


def prepare(docs: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, path: str | None = None) -> Mix:
    """Sizes in tokens of all documents of the target sources, and the plan.

    Sources are compared in one spelling; several rows for one source in
    targets add their shares and keep the larger repeats. Documents without id
    or source, or of a source without a target, take no part. Null and empty
    texts have no tokens and take no position.
    """
    spark = docs.sparkSession
    goal = (
        targets.select(spelled(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
        .where("source IS NOT NULL")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    goals = goal.limit(MOST_SOURCES + 1).collect()
    if len(goals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    names = F.broadcast(spark.createDataFrame([(r.source,) for r in goals], "source string"))  # at most MOST_SOURCES rows
    rows = docs.select("doc_id", spelled(F.col("source")).alias("source"), "text").where("doc_id IS NOT NULL").join(names, "source")
    sized = cut(token_counts(rows, ["doc_id", "source"], path=path).where("n_tokens > 0"))
    brought = {r.source: (r.d, r.t) for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("d"), F.sum("n_tokens").alias("t")).collect()}
    stats = [(r.source, r.target_share or 0.0, r.max_repeats or 0, *brought.get(r.source, (0, 0))) for r in goals]
    return Mix(sized, plan(sorted(stats), total_tokens))


def positions(mix: Mix, schedule: dict[str, list[tuple[float, float]]] | None = None, seed: int = 7) -> DataFrame:
    """(position, source, doc_id, copy, n_tokens) sorted by position.

    schedule: knots (t, weight) by source, weights positive; by default
    curriculum(). A copy is taken while the middle of its tokens lies within
    the source's demand, so no document is taken more than max_repeats times
    and a source's total is off by half a document at most. Repeated rows are
    documents of their own.
    """
    spark = mix.sized.sparkSession
    schedule = schedule or curriculum(mix.shares)
    used = [s for s in mix.shares if s.need > 0]
    seg = "array<struct<t0:double,h:double,w0:double,k:double,c0:double>>"
    demand = F.broadcast(  # one row per source of the plan, at most MOST_SOURCES
        spark.createDataFrame([(s.source, float(s.need), int(s.tokens), [tuple(x.values()) for x in _segments(schedule[s.source])]) for s in used], f"source string, need double, tokens bigint, segments {seg}")
    )
    documents = sum(s.documents for s in used)
    buckets = max(1, -(-documents // BUCKET_DOCS))
    rows = mix.sized.withColumn("key", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.floor((F.shiftright("key", 33) + (1 << 30)).cast("double") / float(1 << 31) * buckets).cast("int"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = totals.withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(before, ["source", "bucket"]).join(demand, "source")
    middle = F.col("before") + F.col("offset") + F.col("n_tokens") / 2.0
    copies = F.ceil((F.col("need") - middle) / F.col("tokens")).cast("int")
    taken = placed.withColumn("middle", middle).where(F.col("middle") < F.col("need")).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    share = (F.col("middle") + F.col("copy") * F.col("tokens")) / F.col("need")
    return taken.select(_position(share, F.col("segments")).alias("position"), "source", "doc_id", "copy", "n_tokens").orderBy("position", "source", "doc_id", "copy")


def report(mix: Mix, placed: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, mixed_tokens, documents, copies, repeats: one row per target source."""
    spark = placed.sparkSession
    goal = spark.createDataFrame([(s.source, s.target, s.max_repeats, s.documents, s.tokens) for s in mix.shares], "source string, target_share double, max_repeats int, documents bigint, tokens bigint")
    got = placed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("copies"), (F.max("copy") + 1).alias("repeats"))
    joined = goal.join(got, "source", "left").fillna(0, ["mixed_tokens", "copies", "repeats"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))
    return joined.withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), whole), F.lit(0.0)))
