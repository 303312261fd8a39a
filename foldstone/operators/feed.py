"""A change feed of puts and deletes, applied in order (problem 3; C1, C4, C6).

The feed is kept as two sets of files (``append_feed``): inserts, and equality deletes
that name a key and the sequence number from which they hold. A reader drops every insert that
a delete of its key follows (an anti-join on key and sequence number) and folds
what is left by the store's rules:

* a put whose id is that of the record now stored changes nothing;
* else, if both versions are given and the put's is smaller, it is refused;
* else it replaces the record.

Scale: deletes shrink to the last one per key before the join. Keys with at most
``HOT`` changes are folded in one shuffle by key, each a bounded list. The others,
at most ``rows / HOT`` of them (broadcast while there are few), are folded in slices of
``SLICE`` sequence numbers in parallel: a slice becomes a short table that
says which record it leaves behind for every record it may start from, and the
tables of a key are then applied in order. No key's history meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.model import collection_of, number_or_zero, text_or_empty
from foldstone.runtime import cut, scratch

HOT = 20_000
SLICE = 1 << 16
BROADCAST_KEYS = 100_000
#: Spellings of the two operations, lower case and trimmed.
PUTS, DELETES = ("p", "put"), ("d", "delete")
TOP = (1 << 63) - 1

STATE = "struct<seq:bigint,version:bigint,mid:string>"


def operation(op: Column | str) -> Column:
    """``P``, ``D`` or null for an ``op`` however it is spelled."""
    plain = F.lower(F.trim(F.col(op) if isinstance(op, str) else op))
    return F.when(plain.isin(*PUTS), "P").when(plain.isin(*DELETES), "D")


@dataclass
class Feed:
    inserts: DataFrame  # collection, key, seq, version, mid
    deletes: DataFrame  # collection, key, seq: holds against inserts with a smaller seq


def _changes(mutations: DataFrame) -> DataFrame:
    return mutations.select(
        collection_of().alias("collection"),
        F.col("key"),
        F.col("seq"),
        operation("op").alias("op"),
        number_or_zero("version").alias("version"),
        text_or_empty("mutation_id").alias("mid"),
    ).filter("key <> '' and seq is not null and op is not null")


def split_feed(mutations: DataFrame) -> Feed:
    """The feed's inserts and its equality deletes; malformed rows (neither operation,
    or no key) and rows without ``seq`` belong to neither."""
    rows = _changes(mutations)
    return Feed(rows.filter("op = 'P'").drop("op"), rows.filter("op = 'D'").select("collection", "key", "seq"))


def append_feed(mutations: DataFrame, path: str) -> None:
    """Append a batch to the files of inserts, ``path/kind=insert``, and of equality deletes,
    ``path/kind=delete``, in one pass; neither is ever rewritten."""
    rows = _changes(mutations).withColumn("kind", F.when(F.col("op") == "P", "insert").otherwise("delete"))
    rows.drop("op").write.mode("append").partitionBy("kind").parquet(path)


def read_feed(spark: SparkSession, path: str) -> Feed:
    """The feed in the files at ``path``; a path without files is an empty feed."""
    schema = "collection string, key string, seq bigint, version bigint, mid string, kind string"
    rows = spark.read.schema(schema).parquet(path)
    return Feed(rows.filter("kind = 'insert'").drop("kind"), rows.filter("kind = 'delete'").select("collection", "key", "seq"))


def through_files(mutations: DataFrame) -> Feed:
    """The feed after a way through files of its own in the shared folder: ``mutations`` are
    scanned once, and what follows reads keys, numbers and ids alone."""
    path = scratch(mutations.sparkSession, "feed")
    append_feed(mutations, path)
    return read_feed(mutations.sparkSession, path)


def fold_column(changes: Column) -> Column:
    """The state (seq, version, mid) that an ordered array of (seq, version, mid)
    leaves behind, from an empty store. Repeats of a ``seq`` change nothing."""

    def step(s: Column, c: Column) -> Column:
        same = (c["seq"] == s["seq"]) | ((c["mid"] != "") & (c["mid"] == s["mid"]))
        older = (c["version"] != 0) & (s["version"] != 0) & (c["version"] < s["version"])
        return F.when(s["seq"].isNull() | ~(same | older), c).otherwise(s)

    return F.aggregate(changes, F.lit(None).cast(STATE), step)


def live_inserts(inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Inserts that no delete of their key follows. ``deletes`` has one row per key."""
    last = deletes.select(F.col("collection").alias("d_collection"), F.col("key").alias("d_key"), F.col("seq").alias("d_seq"))
    at = (F.col("collection") == F.col("d_collection")) & (F.col("key") == F.col("d_key")) & (F.col("seq") < F.col("d_seq"))
    return inserts.join(last, at, "left_anti")


class Slice:
    """The effect of an ordered run of puts on whatever record is stored before it.

    ``seqs``, ``versions`` and ``mids`` are parallel; a zero version counts as one
    above all others when it comes in, since it is never refused for its version.
    """

    def __init__(self, seqs: list[int], versions: list[int], mids: list[str]):
        self.seqs, self.versions, self.mids = seqs, versions, mids
        self.rank = [v or TOP for v in versions]
        n = len(seqs)
        self.higher = self._later(n)
        self.differs = [n] * n  # next put with another id
        for i in range(n - 2, -1, -1):
            self.differs[i] = self.differs[i + 1] if mids[i + 1] == mids[i] else i + 1
        self.end = list(range(n))
        for i in range(n - 1, -1, -1):
            j = self.accepted(i + 1, versions[i], mids[i])
            if j < n:
                self.end[i] = self.end[j]

    def _later(self, n: int) -> list[int]:
        """For each put the next one that ranks at least as high."""
        out, stack = [n] * n, []
        for i in range(n - 1, -1, -1):
            while stack and self.rank[stack[-1]] < self.rank[i]:
                stack.pop()
            out[i] = stack[-1] if stack else n
            stack.append(i)
        return out

    def accepted(self, at: int, version: int, mid: str) -> int:
        """The first put from ``at`` on that replaces a record (version, mid)."""
        n = len(self.seqs)
        while at < n:
            if version and self.rank[at] < version:
                # climb to the next put that ranks high enough
                at = self.higher[at]
            elif mid and self.mids[at] == mid:
                at = self.differs[at]
            else:
                return at
        return n

    def table(self) -> list[tuple[int, int, str | None, int]]:
        """Rows (above, upto, mid, put): a record whose version lies in (above, upto]
        becomes that put; rows with an id hold for records of that id only and come
        first. A record that no row fits stays. Versions 0 lie in (-1, …]."""
        general: list[list] = []
        special: list[tuple[int, int, str | None, int]] = []
        n, low, at = len(self.seqs), -1, 0
        while at < n:
            high = self.rank[at]
            end = self.end[at]
            if general and general[-1][3] == end:
                general[-1][1] = high
            else:
                general.append([low, high, None, end])
            if self.mids[at]:
                special += self._without(at, low, high, end)
            if high == TOP:
                break
            low, at = high, self.accepted(at + 1, high + 1, "")
        return special + [tuple(g) for g in general]

    def _without(self, at: int, low: int, high: int, usual: int) -> list[tuple[int, int, str | None, int]]:
        """What becomes of records in (low, high] that share the id of put ``at``."""
        mid, n, out = self.mids[at], len(self.seqs), []
        while low < high:
            # versions just above low; -1 stands before 0, which any put replaces
            k = self.accepted(at + 1, max(low + 1, 0), mid)
            top = high if k == n else min(self.rank[k], high)
            end = -1 if k == n else self.end[k]
            if end != usual:
                out.append((low, top, mid, end))
            low = top
        return out


def slice_effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (collection, key, slice, seq) to the effects of each slice."""

    def effect(head: tuple, seqs: list, versions: list, mids: list) -> list[tuple]:
        s = Slice(seqs, versions, mids)
        return [(*head, above, upto, mid, *((s.seqs[e], s.versions[e], s.mids[e]) if e >= 0 else (None, None, None))) for above, upto, mid, e in s.table()]

    names = ["collection", "key", "slice", "above", "upto", "own", "seq", "version", "mid"]
    head, seqs, versions, mids, out = None, [], [], [], []
    for batch in batches:
        for c, k, sl, seq, v, m in zip(batch["collection"].tolist(), batch["key"].tolist(), batch["slice"].tolist(), batch["seq"].tolist(), batch["version"].tolist(), batch["mid"].tolist()):
            if (c, k, sl) != head:
                if head is not None:
                    out += effect(head, seqs, versions, mids)
                head, seqs, versions, mids = (c, k, sl), [], [], []
            if not seqs or seqs[-1] != seq:
                seqs.append(seq)
                versions.append(v)
                mids.append(m)
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=names).astype({"seq": "Int64", "version": "Int64"})
            out = []
    if head is not None:
        out += effect(head, seqs, versions, mids)
    if out:
        yield pd.DataFrame(out, columns=names).astype({"seq": "Int64", "version": "Int64"})


def apply_effects(effects: Column) -> Column:
    """The state after a key's slices, given its effects ordered by slice, each an
    array of (above, upto, own, seq, version, mid), from an empty store."""

    def step(s: Column, table: Column) -> Column:
        version, mid = F.coalesce(s["version"], F.lit(0)), F.coalesce(s["mid"], F.lit(""))
        fits = F.filter(
            table["rows"],
            lambda r: (r["above"] < version) & (version <= r["upto"]) & (r["own"].isNull() | (s["seq"].isNotNull() & (r["own"] == mid))),
        )
        # a row for the record's own id goes before the general one
        own = F.filter(fits, lambda r: r["own"].isNotNull())
        hit = F.get(F.when(F.size(own) > 0, own).otherwise(fits), F.lit(0))
        return F.when(hit["seq"].isNull(), s).otherwise(F.struct(hit["seq"].alias("seq"), hit["version"].alias("version"), hit["mid"].alias("mid")))

    return F.aggregate(effects, F.lit(None).cast(STATE), step)


def current_state(feed: Feed, hot: int = HOT, span: int = SLICE) -> DataFrame:
    """``collection, key, seq, version, mutation_id`` of every live key.

    ``seq`` is that of the put whose record the key holds. Rows may come in any
    order and repeat unchanged. Keys that end deleted, or have only deletes, do not
    come out; an empty feed gives no rows.
    """
    keys = ["collection", "key"]
    last = feed.deletes.groupBy(*keys).agg(F.max("seq").alias("seq"))
    busy = feed.inserts.groupBy(*keys).count().filter(F.col("count") > hot).select(*keys)

    busy = cut(busy)
    few = busy.count() <= BROADCAST_KEYS
    small = F.broadcast if few else (lambda df: df)  # beyond that, AQE splits the skewed joins
    busy_keys = small(busy)
    quiet_inserts = feed.inserts.join(busy_keys, keys, "left_anti")
    busy_inserts = feed.inserts.join(busy_keys, keys, "left_semi")

    quiet = (
        live_inserts(quiet_inserts, last)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("seq", "version", "mid"))).alias("changes"))
        .select(*keys, fold_column(F.col("changes")).alias("s"))
    )

    busy_last = small(last.join(busy_keys, keys, "left_semi"))
    effects = (
        live_inserts(busy_inserts, busy_last)
        .withColumn("slice", F.expr(f"seq div {span}"))
        .repartition(*keys, "slice")
        .sortWithinPartitions(*keys, "slice", "seq")
        .select(*keys, "slice", "seq", "version", "mid")
        .mapInPandas(
            slice_effects,
            "collection string, key string, slice long, above long, upto long, own string, seq long, version long, mid string",
        )
    )
    steps = effects.groupBy(*keys, "slice").agg(F.collect_list(F.struct("above", "upto", "own", "seq", "version", "mid")).alias("rows"))
    hot_state = (
        steps.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("slice", "rows"))).alias("steps"))
        .select(*keys, apply_effects(F.col("steps")).alias("s"))
    )
    return quiet.unionByName(hot_state).select(*keys, F.col("s.seq").alias("seq"), F.col("s.version").alias("version"), F.col("s.mid").alias("mutation_id"))


def rebuild(mutations: DataFrame, hot: int = HOT, span: int = SLICE, feed: Feed | None = None) -> DataFrame:
    """The full current records: the fold decides by ids alone, and the winners' keys and
    sequence numbers then fetch the records, so bodies are shuffled only once. Sequence
    numbers need be unique within a key only. ``feed`` is that of ``mutations``, if it is
    at hand or small."""
    won = current_state(feed or through_files(mutations), hot, span).select(F.col("collection").alias("w_collection"), F.col("key").alias("w_key"), F.col("seq").alias("w_seq"))
    named = mutations.filter(operation("op") == "P").withColumn("collection", collection_of())
    at = (F.col("collection") == F.col("w_collection")) & (F.col("key") == F.col("w_key")) & (F.col("seq") == F.col("w_seq"))
    rows = named.join(won, at, "left_semi")
    fields = [c for c in rows.columns if c not in ("op", "collection")]
    return rows.select("collection", *fields).dropDuplicates(["collection", "key", "seq"])
