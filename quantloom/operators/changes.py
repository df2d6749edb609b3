"""Replay of a change feed into the current state of its tables.

Commit-ordered replay. A *table* (here an order book) is named by one or more
columns and its changes are ordered by a sequence number. The feed is cut into
commit epochs of consecutive sequence numbers; (table, epoch) is the unit of
the first shuffle, so a hot table is spread over its epochs. Within an epoch

1. the copies of a change are resolved (the copy received last holds),
2. transactions are assembled, and
3. the changes of each key are folded into one summary row, keys being
   independent of each other (parallel, no conflict).

The second shuffle moves summaries only, by (table, slice of keys), and folds
the epochs of each key. A reset concerns all keys of its table: its mark is
sent to every slice, where it sorts before the keys, so no join is needed.

State is shown up to the committed watermark of each table: the last sequence
number before the first gap or incomplete transaction that is still held. The
watermark comes from a summary with one row per epoch and meets the changes
again by (table, epoch), so no hot table is gathered for it either.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTHING, SET, REDUCE, RESET = 0, 1, 2, 3


@dataclass(frozen=True)
class Feed:
    """Names of a feed's columns.

    table: columns naming a table; key: the row's key within it; seq: order of
    effect; arrived: time of receipt; op: one of the codes of this module;
    amount: what a SET leaves or a REDUCE takes off; payload: other columns
    that a SET replaces. txn and txn_size: number of the transaction a change
    belongs to and the number of its changes; without them each change is a
    transaction of its own.
    """

    table: list[str]
    key: str
    seq: str
    arrived: str
    op: Column
    amount: str
    payload: list[str] = field(default_factory=list)
    txn: str | None = None
    txn_size: str | None = None


def latest_copies(df: DataFrame, feed: Feed, epoch_size: int = 4096) -> DataFrame:
    """One row per change: of its copies the one received last.

    Copies received at the same instant are told apart by their content
    (greatest), so the choice never depends on the order of rows. Changes
    without a table, a sequence number or a time of receipt have no place in
    the order and are left out. Extra columns of the input are dropped.
    """
    t = [f"t{i}" for i in range(len(feed.table))]
    p = [f"p{i}" for i in range(len(feed.payload))]
    extra = [F.col(feed.txn).alias("txn"), F.col(feed.txn_size).alias("txn_size")] if feed.txn else []
    rows = df.select(
        *[F.col(c).alias(a) for c, a in zip(feed.table, t)],
        F.expr(f"(`{feed.seq}` - pmod(`{feed.seq}`, {epoch_size})) DIV {epoch_size}").alias("epoch"),
        F.col(feed.seq).cast("long").alias("seq"),
        F.col(feed.arrived).alias("arrived"),
        feed.op.cast("tinyint").alias("op"),
        F.col(feed.key).alias("key"),
        F.col(feed.amount).alias("amount"),
        *[F.col(c).alias(a) for c, a in zip(feed.payload, p)],
        *extra,
    ).where(F.col("seq").isNotNull() & F.col("epoch").isNotNull() & F.col("arrived").isNotNull() & ~F.greatest(*[F.col(c).isNull() for c in t], F.lit(False)))
    last = Window.partitionBy(*t, "epoch", "seq").orderBy(
        F.desc("arrived"), F.desc("op"), F.desc("key"), F.desc("amount"), *[F.desc(c) for c in p]
    )
    return rows.repartition(*[F.col(c) for c in t], F.col("epoch")).withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def commits(changes: DataFrame, n_table: int, hold_seconds: float | None, has_txn: bool = False) -> DataFrame:
    """(t0.., epoch, watermark, dropped) of each epoch of latest_copies().

    A transaction is complete when as many of its changes have come as it
    counts; its changes by epoch are added first, and only those short in an
    epoch are looked at across epochs. An incomplete transaction and a gap in
    the numbers are held: the watermark of the table stops before them, as what
    is missing may still come. The clock of a table is its newest receipt; a
    hold runs from the receipt of the first change beyond the gap, or of the
    transaction's first change, and lasts hold_seconds. None: the feed has
    ended and the clock has run on beyond every hold. A hold that has run out
    makes a gap void and drops an incomplete transaction as a whole.

    Within an epoch gaps are found by a window; between epochs by the epochs'
    first and last numbers, so no task ever sorts a whole table. ``dropped``
    names the epoch's changes of incomplete transactions (null: none).
    """
    t = [f"t{i}" for i in range(n_table)]
    held_us = int((hold_seconds or 0.0) * 1_000_000)
    inner = Window.partitionBy(*t, "epoch").orderBy("seq")
    rows = changes.withColumn("prev", F.lag("seq").over(inner))
    beyond_gap = F.when(F.col("seq") - F.col("prev") > 1, F.struct("seq", "arrived", F.col("prev").alias("mark")))
    epochs = rows.groupBy(*t, "epoch").agg(
        F.min("seq").alias("lo"),
        F.max("seq").alias("hi"),
        F.min_by("arrived", "seq").alias("lo_arrived"),
        F.max("arrived").alias("newest"),
        F.collect_list(beyond_gap).alias("held"),  # at most one a change of the epoch
    )
    by_epoch = Window.partitionBy(*t).orderBy("epoch")
    epochs = epochs.withColumn("hi_before", F.lag("hi").over(by_epoch))
    between = F.struct(F.col("lo").alias("seq"), F.col("lo_arrived").alias("arrived"), F.col("hi_before").alias("mark"))
    epochs = epochs.withColumn("held", F.when(F.col("lo") - F.col("hi_before") > 1, F.array_append("held", between)).otherwise(F.col("held")))
    if has_txn:
        pieces = changes.where("txn IS NOT NULL").groupBy(*t, "epoch", "txn").agg(F.count(F.lit(1)).alias("have"), F.max("txn_size").alias("size"), F.min("seq").alias("first"), F.min("arrived").alias("began"))
        whole = Window.partitionBy(*t, "txn")
        short = pieces.where("have < size").withColumns({"have": F.sum("have").over(whole), "size": F.max("size").over(whole), "first": F.min("first").over(whole), "began": F.min("began").over(whole)})
        short = short.where("have < size").groupBy(*t, "epoch").agg(F.collect_list("txn").alias("dropped"), F.collect_list(F.struct(F.col("first").alias("seq"), F.col("began").alias("arrived"), (F.col("first") - 1).alias("mark"))).alias("waiting"))
        epochs = epochs.join(short, [*t, "epoch"], "left").withColumn("held", F.when(F.col("waiting").isNull(), F.col("held")).otherwise(F.concat("held", "waiting")))
    else:
        epochs = epochs.withColumn("dropped", F.lit(None).cast("array<bigint>"))
    table = Window.partitionBy(*t)
    clock = F.lit(2**62) if hold_seconds is None else F.max(F.unix_micros("newest")).over(table)
    epochs = epochs.withColumn("clock", clock)
    open_ = F.filter("held", lambda x: F.col("clock") - F.unix_micros(x["arrived"]) < held_us)
    epochs = epochs.withColumn("blocked", F.array_min(F.transform(open_, lambda x: x["mark"])))
    return epochs.withColumn("watermark", F.coalesce(F.min("blocked").over(table), F.max("hi").over(table))).select(*t, "epoch", "lo", "watermark", "dropped")


def watermarks(changes: DataFrame, n_table: int, hold_seconds: float | None, has_txn: bool = False) -> DataFrame:
    """(t0.., watermark): the last committed number of each table over latest_copies(); see commits()."""
    t = [f"t{i}" for i in range(n_table)]
    return commits(changes, n_table, hold_seconds, has_txn).groupBy(*t).agg(F.max("watermark").alias("watermark"))


def current_state(df: DataFrame, feed: Feed, epoch_size: int = 4096, slices: int = 32, hold_seconds: float | None = None) -> DataFrame:
    """The rows of every table after its last committed change.

    Columns: those of feed.table, feed.key, feed.payload and feed.amount. Only
    what lies up to the table's contiguous committed watermark shows, and no
    change of an incomplete transaction; see commits() for hold_seconds.

    SET enters or replaces a key as a whole; REDUCE takes its amount off a key
    as it stands, removes it when nothing is left and does nothing to an
    unknown key; RESET empties the table. A null or negative amount takes
    nothing off, and a SET to a null or non-positive amount leaves nothing.
    Changes without a key (other than RESET) do nothing. An empty feed gives
    an empty state.
    """
    t = [f"t{i}" for i in range(len(feed.table))]
    p = [f"p{i}" for i in range(len(feed.payload))]
    rows = latest_copies(df, feed, epoch_size)
    marks = commits(rows, len(t), hold_seconds, feed.txn is not None).where("lo <= watermark").drop("lo")
    rows = rows.join(marks, [*t, "epoch"]).where("seq <= watermark")
    if feed.txn:
        rows = rows.where(F.col("txn").isNull() | F.col("dropped").isNull() | ~F.array_contains("dropped", F.col("txn")))
    rows = rows.drop("watermark", "dropped")
    rows = rows.where((F.col("op") == RESET) | (F.col("op").isin(SET, REDUCE) & F.col("key").isNotNull()))
    reset = F.col("op") == RESET
    rows = rows.withColumn("key", F.when(~reset, F.col("key")))

    # Fold within an epoch: the last SET of a key, what was taken off since.
    own = Window.partitionBy(*t, "epoch", "key")
    rows = rows.withColumn("set_seq", F.max(F.when(F.col("op") != REDUCE, F.col("seq"))).over(own))
    is_set = F.col("seq") == F.col("set_seq")
    after = (F.col("op") == REDUCE) & (F.col("set_seq").isNull() | (F.col("seq") > F.col("set_seq")))
    summary = rows.groupBy(*t, "epoch", "key").agg(
        F.max("set_seq").alias("set_seq"),
        F.max(F.when(is_set, F.coalesce("amount", F.lit(0)))).cast("long").alias("left"),
        F.coalesce(F.sum(F.when(after, F.greatest(F.col("amount"), F.lit(0)))), F.lit(0)).cast("long").alias("taken"),
        *[F.max(F.when(is_set, F.col(c))).alias(c) for c in p],
    )

    # Fold the epochs of a key; a reset mark (no key) goes to all slices of its table.
    sliced = summary.withColumn(
        "slice",
        F.explode(
            F.when(F.col("key").isNull(), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(
                F.array(F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int"))
            )
        ),
    )
    sliced = sliced.repartition(*[F.col(c) for c in t], F.col("slice")).sortWithinPartitions(*t, "slice", F.asc_nulls_first("key"), "epoch")
    keys_first = Window.partitionBy(*t, "slice").orderBy(F.asc_nulls_first("key"), "epoch").rowsBetween(Window.unboundedPreceding, 0)
    sliced = sliced.withColumn("reset_seq", F.max(F.when(F.col("key").isNull(), F.col("set_seq"))).over(keys_first)).where("key IS NOT NULL")
    all_epochs = Window.partitionBy(*t, "slice", "key")
    sliced = sliced.withColumn("last", F.max(F.when(F.col("set_seq").isNotNull(), F.col("epoch"))).over(all_epochs))
    at_last = F.col("epoch") == F.col("last")
    state = sliced.groupBy(*t, "slice", "key").agg(
        F.max("set_seq").alias("set_seq"),
        F.max("reset_seq").alias("reset_seq"),
        F.max(F.when(at_last, F.col("left"))).alias("left"),
        F.sum(F.when(F.col("epoch") >= F.col("last"), F.col("taken"))).alias("taken"),
        *[F.max(F.when(at_last, F.col(c))).alias(c) for c in p],
    )
    state = state.where(F.col("set_seq").isNotNull() & (F.col("reset_seq").isNull() | (F.col("set_seq") > F.col("reset_seq"))) & (F.col("left") > F.col("taken")))
    return state.select(
        *[F.col(a).alias(c) for c, a in zip(feed.table, t)],
        F.col("key").alias(feed.key),
        *[F.col(a).alias(c) for c, a in zip(feed.payload, p)],
        (F.col("left") - F.col("taken")).alias(feed.amount),
    )


def order_feed(df: DataFrame) -> Feed:
    """How order events change a book (A, M: set; C, F: reduce; R: reset)."""
    op = (
        F.when(F.col("action").isin("A", "M"), SET)
        .when(F.col("action").isin("C", "F"), REDUCE)
        .when(F.col("action") == "R", RESET)
        .otherwise(NOTHING)
    )
    return Feed(["symbol", "session_date"], "order_id", "seq", "ts_recv", op, "sz", ["side", "px"])
