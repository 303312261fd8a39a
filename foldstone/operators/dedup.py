"""Messages delivered more than once: one copy of each stays (problem 1).

Most writers number their messages, so an identifier is a producer and a number.
What was seen of a producer is kept as disjoint ranges of numbers. A number that no
range covers is new and is accepted once, without any look at stored messages; its
range grows, and ranges that meet become one. Everything else goes to an exact lookup by
``(collection, key, mutation_id)``: numbers that a range covers, numbers that one batch uses
for more than one message, and identifiers that are not of the numbered form.

Scale: identifiers are parsed once and kept, without bodies. Rows are first reduced to one per
``(producer, number)``, and those to be looked up to one per message, map-side, so a
message that makes up a third of the feed costs no more than any other. The sweep
over ranges works in blocks of ``BLOCK`` numbers, so the numbers and ranges of one
task's group are bounded even for one hot producer; only ranges that touch an edge of their
block, two a block at most, are merged beyond it. Stored messages are appended to, never
rewritten, and a lookup reads the files that may hold the numbers in doubt. Only
identifiers and stamps are shuffled, never bodies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldstone.model import collection_of, text_or_empty
from foldstone.runtime import cut

BLOCK = 4096
#: ``node:stamp:number`` and ``name-number``; numbers are canonical decimals that fit a long.
STAMPED = r"^(.+):[0-9]+:(0|[1-9][0-9]{0,17})$"
PLAIN = r"^([A-Za-z]+-)(0|[1-9][0-9]{0,17})$"
LAST = (1 << 63) - 1


@dataclass
class Seen:
    """What earlier batches brought: ``ranges`` (producer, lo, hi), which are disjoint and
    don't touch, and ``messages`` (producer, number, collection, key, mutation_id), for
    exact lookups, in which a message may occur more than once."""

    ranges: DataFrame
    messages: DataFrame


@dataclass
class Deduplicated:
    duplicates: DataFrame  # delivery_id
    seen: Seen


def producer_of(mutation_id: Column) -> Column:
    stamped, plain = F.regexp_extract(mutation_id, STAMPED, 1), F.regexp_extract(mutation_id, PLAIN, 1)
    return F.when(stamped != "", F.concat(stamped, F.lit(":"))).when(plain != "", plain)


def number_of(mutation_id: Column) -> Column:
    stamped, plain = F.regexp_extract(mutation_id, STAMPED, 2), F.regexp_extract(mutation_id, PLAIN, 2)
    return F.when(stamped != "", stamped).when(plain != "", plain).cast("long")


def messages_of(deliveries: DataFrame) -> DataFrame:
    """Identity and order of each delivery that carries an id; other columns are dropped here."""
    mid = text_or_empty("mutation_id")
    return deliveries.select(
        "delivery_id",
        collection_of().alias("collection"),
        text_or_empty("key").alias("key"),
        mid.alias("mutation_id"),
        # absent stamps sort last; null ids sort after all others of a tie
        F.when(F.coalesce("updated_at_unix_ms", F.lit(0)) == 0, LAST).otherwise(F.col("updated_at_unix_ms")).alias("stamp"),
        F.coalesce("delivery_id", F.lit(LAST)).alias("tie"),
        producer_of(mid).alias("producer"),
        number_of(mid).alias("number"),
    ).filter("mutation_id <> ''")


IDENTITY = ("collection", "key", "mutation_id")


def in_blocks(ranges: DataFrame) -> DataFrame:
    """Ranges cut at the edges of blocks."""
    each = ranges.withColumn("block", F.explode(F.expr(f"sequence(lo div {BLOCK}, hi div {BLOCK})")))
    return each.select("producer", "block", F.greatest("lo", F.col("block") * BLOCK).alias("lo"), F.least("hi", F.col("block") * BLOCK + (BLOCK - 1)).alias("hi"))


def _islands(ranges: DataFrame, *group: str) -> DataFrame:
    """Ranges of one group that overlap or touch, as one."""
    order = Window.partitionBy(*group).orderBy("lo")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0)
    marked = ranges.withColumn("starts", starts)
    marked = marked.withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*group, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def merged(ranges: DataFrame) -> DataFrame:
    """Ranges cut at blocks (producer, block, lo, hi) without the cuts."""
    edge = (F.col("lo") == F.col("block") * BLOCK) | (F.col("hi") == F.col("block") * BLOCK + (BLOCK - 1))
    whole = _islands(ranges.filter(edge).select("producer", "lo", "hi"), "producer")
    return ranges.filter(~edge).select("producer", "lo", "hi").unionByName(whole)


def sweep(numbers: DataFrame, ranges: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``numbers`` (producer, number, …) with ``covered``, and the ranges that hold both."""
    points = numbers.withColumn("block", F.expr(f"number div {BLOCK}"))
    new = points.select("producer", "block", F.col("number").alias("lo"), F.col("number").alias("hi"))
    if ranges is None:
        return points.withColumn("covered", F.lit(False)), merged(_islands(new, "producer", "block"))
    old = in_blocks(ranges)
    both = points.withColumns({"lo": F.col("number"), "old": F.lit(False)}).unionByName(old.withColumn("old", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy("producer", "block").orderBy("lo", F.desc("old")).rowsBetween(Window.unboundedPreceding, -1)
    marked = both.withColumn("reach", F.max("hi").over(before)).filter("not old")
    marked = marked.withColumn("covered", F.coalesce(F.col("reach") >= F.col("number"), F.lit(False))).drop("lo", "hi", "old", "reach")
    return marked, merged(_islands(new.unionByName(old), "producer", "block"))


def looked_up(wanted: DataFrame, messages: DataFrame) -> DataFrame:
    """``wanted`` messages that are not among ``messages``. Bounds of the numbers wanted
    are known before, so that files (each batch's hold its own numbers) are passed over."""
    low, high, plain = wanted.agg(F.min("number"), F.max("number"), F.count_if(F.col("number").isNull())).head()
    near = F.col("number").between(low, high) if low is not None else F.lit(False)
    held = messages.filter((near | F.col("number").isNull()) if plain else near)
    return wanted.join(held.select(*IDENTITY), list(IDENTITY), "left_anti")


def deduplicate(deliveries: DataFrame, seen: Seen | None = None) -> Deduplicated:
    """The deliveries that repeat a message of this batch or of an earlier one.

    Needs ``delivery_id`` (unique), ``collection``, ``key``, ``mutation_id`` and
    ``updated_at_unix_ms``; other columns, whatever their names, play no part. Rows
    with equal collection (absent: ``documents``), key and id are copies; a row
    without an id is a message of its own. Of the copies within a batch the one with
    the smallest stamp stays (absent last, then the smallest ``delivery_id``);
    against earlier batches the earlier copy stays. Rows whose ``delivery_id`` is
    null count as one delivery. An empty batch gives no duplicates.
    """
    return _deduplicate(cut(messages_of(deliveries)), seen)  # parsed once; several branches read it


def _deduplicate(rows: DataFrame, seen: Seen | None) -> Deduplicated:
    numbered = rows.filter("producer is not null")
    # two hashes tell whether a number stands for one message, so that no names move
    same = F.xxhash64(*IDENTITY), F.xxhash64("mutation_id", "key", "collection", F.lit(1))
    numbers = numbered.groupBy("producer", "number").agg(F.min(F.struct("stamp", "tie")).alias("first"), *[f(h).alias(f"{n}{i}") for i, h in enumerate(same) for n, f in (("low", F.min), ("high", F.max))])
    numbers = numbers.select("producer", "number", "first", F.expr("low0 = high0 and low1 = high1").alias("single"))
    marked, ranges = sweep(numbers, seen.ranges if seen else None)
    fresh = marked.filter("single and not covered")
    doubtful = marked.filter("not single or covered").select("producer", "number")

    per = rows.groupBy("producer", "number", *IDENTITY).agg(F.min(F.struct("stamp", "tie")).alias("first"))
    wanted = per.filter("producer is not null").join(doubtful, ["producer", "number"], "left_semi").unionByName(per.filter("producer is null"))
    if seen:
        wanted = looked_up(wanted.persist(StorageLevel.MEMORY_AND_DISK), seen.messages)

    accepted = fresh.select(F.col("first.tie").alias("accepted")).unionByName(wanted.select(F.col("first.tie").alias("accepted")))
    kept = accepted.filter(F.col("accepted") != LAST)
    duplicates = rows.select("delivery_id", "tie").join(kept, F.col("tie") == F.col("accepted"), "left_anti")
    nameless = accepted.filter(F.col("accepted") == LAST).limit(1)  # deliveries without an id stay if one of them does
    duplicates = duplicates.join(F.broadcast(nameless), F.col("tie") == F.col("accepted"), "left_anti").select("delivery_id")
    messages = rows.select("producer", "number", *IDENTITY)
    return Deduplicated(duplicates, Seen(ranges, seen.messages.unionByName(messages) if seen else messages))


class SeenStore:
    """Ranges and messages of all batches so far in a folder that all executors share.

    Messages are appended, each batch's by number; ranges, which are few, are written anew
    with each batch, and the last complete ones count.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.batch = spark, path, -1

    def seen(self) -> Seen | None:
        if self.batch < 0:
            return None
        return Seen(self.spark.read.parquet(f"{self.path}/ranges/{self.batch}"), self.spark.read.parquet(f"{self.path}/messages"))

    def take(self, deliveries: DataFrame) -> DataFrame:
        """The duplicates of the next batch, which is then seen."""
        rows, seen = cut(messages_of(deliveries)), self.seen()
        done = _deduplicate(rows, seen)
        duplicates = cut(done.duplicates)
        done.seen.ranges.write.parquet(f"{self.path}/ranges/{self.batch + 1}")
        new = rows.select("producer", "number", *IDENTITY)
        new.sortWithinPartitions("number").write.mode("append").parquet(f"{self.path}/messages")
        self.batch += 1
        return duplicates


def deduplicate_by_stamp(deliveries: DataFrame, epochs: int = 2) -> DataFrame:
    """All copies but the one with the smallest stamp, over the whole feed at once.

    The feed is taken in ``epochs`` of its stamps, oldest first, so the copy to keep
    is always in the earliest epoch that holds its message, and the ranges of the
    earlier epochs tell which numbers of a later one are new. Epoch borders are
    approximate quantiles; where they lie changes the work, not the result.
    """
    rows = cut(messages_of(deliveries))
    quantiles = [i / epochs for i in range(1, epochs)]
    borders = rows.filter(F.col("stamp") != LAST).select(F.percentile_approx("stamp", quantiles, 200)).head()[0] if quantiles else []
    borders = sorted(set(borders or []))
    epoch = F.lit(len(borders))
    for i, border in reversed(list(enumerate(borders))):
        epoch = F.when(F.col("stamp") <= border, i).otherwise(epoch)
    seen, out = None, None
    for i in range(len(borders) + 1):
        done = _deduplicate(rows.filter(epoch == i), seen)
        out = done.duplicates if out is None else out.unionByName(done.duplicates)
        if i < len(borders):
            seen = Seen(cut(done.seen.ranges), done.seen.messages)
    return out


def keep_one(deliveries: DataFrame, epochs: int = 2) -> DataFrame:
    """The deliveries without their copies, every column as it came."""
    copies = deduplicate_by_stamp(deliveries, epochs)
    return deliveries.join(copies, deliveries["delivery_id"] == copies["delivery_id"], "left_anti")
