"""One object over a log, an index and nodes: the whole API as methods."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.config import Settings
from foldstone.functions.embed import Embedder, embedder
from foldstone.functions.text import clamp_top_k
from foldstone.model import collection_of
from foldstone.operators import feed, kv, routing, search, state, vector
from foldstone.runtime import cut

INDEX_LOG = ["seq", "op", "collection", "key", "metadata", "vector"]


@dataclass(frozen=True)
class Engine:
    """Reads, writes and searches over DataFrames; nothing runs before a result is used,
    but for a write, which is checked when it is made, and gives a new engine.

    ``log`` has mutations (seq, op, record fields); the state is what they leave.
    Reads of keys filter the log before it is folded, since a key's record depends on its
    own changes alone. ``entries`` is the log of the index (``INDEX_LOG``), kept up by
    writes; an engine without one derives its entries from the state. ``last`` is the
    highest sequence number, where it is known.
    """

    log: DataFrame
    settings: Settings = Settings()
    nodes: DataFrame | None = None
    entries: DataFrame | None = None
    last: int | None = None

    @property
    def embedder(self) -> Embedder:
        s = self.settings
        model = {"model_path": s.model_path, "vocabulary_path": s.tokenizer_path, "max_tokens": s.ai_max_tokens} if s.model_path else {}
        return embedder(s.ai_backend, s.embedding_dimensions, **model)

    def _read(self, at: Column) -> DataFrame:
        rows = self.log.filter(at)
        return feed.rebuild(rows, feed=feed.split_feed(rows))

    def state(self) -> DataFrame:
        return feed.rebuild(self.log)

    def get(self, collection: str | None, key: str) -> DataFrame:
        return kv.get(self._read(kv.in_collection(collection) & (F.col("key") == key)), collection, key)

    def multi_get(self, references: DataFrame) -> DataFrame:
        wanted = references.select(collection_of().alias("r_collection"), F.col("key").alias("r_key")).distinct()
        at = (collection_of() == F.col("r_collection")) & (F.col("key") == F.col("r_key"))
        rows = self.log.join(wanted, at, "left_semi")
        return kv.multi_get(feed.rebuild(rows, feed=feed.split_feed(rows)), references)

    def range(self, collection: str | None, begin: str = "", end: str = "", limit: int | None = None) -> DataFrame:
        bounds = [kv.in_collection(collection), *([F.col("key") >= begin] if begin else []), *([F.col("key") < end] if end else [])]
        return kv.range_scan(self._read(reduce(Column.__and__, bounds)), collection, begin, end, limit)

    def collections(self) -> DataFrame:
        return kv.collections(self.state())

    def compacted(self, path: str) -> Engine:
        """An engine whose log is the state as stored at ``path``: records keep their numbers,
        and what is appended comes after them. Replayed deletes and replaced puts are gone."""
        now = self.state().withColumn("op", F.lit("P")).select("seq", "op", *state.feed_fields())
        now.repartitionByRange("collection", "key").sortWithinPartitions("collection", "key").write.parquet(path)
        return replace(self, log=self.log.sparkSession.read.parquet(path), last=self._last())

    def indexed(self, entries: DataFrame | None = None) -> Engine:
        """An engine that keeps its index: ``entries`` (collection, key, metadata, vector), or
        those of the state."""
        made = self.index() if entries is None else entries
        log = made.select(F.lit(0).cast("bigint").alias("seq"), F.lit("P").alias("op"), collection_of().alias("collection"), "key", "metadata", F.col("vector").cast("array<double>").alias("vector"))
        return replace(self, entries=cut(log))

    def _guard(self, records: DataFrame) -> None:
        """ValueError if a write of these keys may not be made here."""
        if self.settings.read_only_mode:
            raise ValueError("unavailable: read-only")
        if not records.filter(F.coalesce("key", F.lit("")) == "").isEmpty():
            raise ValueError("invalid_argument: empty key")
        if self.nodes is not None:
            refused = state.write_guard(self.route(records), self.settings.node_id).filter("outcome <> 'ok'").select("outcome").head()
            if refused:
                raise ValueError(refused["outcome"])

    def put(self, records: DataFrame, now_ms: int) -> Engine:
        """A batch, all of it or, if it breaks a rule, none (ValueError): an engine with
        the longer log. Stamps are filled in; versions and ids given are kept."""
        batch = cut(state.stamp(records, self.settings.node_id, now_ms))
        if batch.isEmpty():
            raise ValueError("empty batch")
        self._guard(batch)
        stored = self.multi_get(batch.select(F.monotonically_increasing_id().alias("ord"), "collection", "key"))
        verdict = state.validate_batches(batch.selectExpr("0 as batch_id", "*"), stored, self.settings.kv_batch_max_records).collect()
        if verdict[0]["outcome"] != "accepted":
            raise ValueError(verdict[0]["outcome"])
        return self._append(batch, "P", stored)

    def delete(self, references: DataFrame) -> Engine:
        """Delete keys (collection, key); those that are not there make no difference."""
        fields = state.feed_fields()
        rows = cut(references.select("collection", "key", *[F.lit(None).cast(t).alias(f) for f, t in fields.items() if f not in ("collection", "key")]))
        self._guard(rows)
        return self._append(rows, "D")

    def _last(self) -> int:
        return self.last if self.last is not None else self.log.selectExpr("coalesce(max(seq), 0) as s").head()["s"]

    def _append(self, rows: DataFrame, op: str, stored: DataFrame | None = None) -> Engine:
        # rows are checkpointed, so each keeps its number; numbers have gaps
        more = cut(rows.select((F.monotonically_increasing_id() + F.lit(self._last() + 1)).alias("seq"), F.lit(op).alias("op"), *state.feed_fields()))
        last = more.agg(F.max("seq")).head()[0] or self._last()
        out = replace(self, log=self.log.select("seq", "op", *state.feed_fields()).unionByName(more), last=last)
        if self.entries is None:
            return out
        named = more.withColumn("collection", collection_of())
        if op == "P":  # a put that repeats the stored id changes nothing, nor its entry
            known = stored.select("collection", "key", F.col("mutation_id").alias("stored_id"))
            named = named.join(known, ["collection", "key"], "left").filter("not (mutation_id <=> stored_id)").drop("stored_id")
            fresh = search.embed_records(named.filter(kv.is_semantic(self.settings.default_collection)), self.embedder).select("collection", "key", "metadata", F.col("vector").cast("array<double>").alias("vector"))
            kept = fresh.join(named.select("collection", "key", "seq", "op"), ["collection", "key"])
            # a record that no longer belongs in the index, or has nothing to embed, leaves it
            gone = named.join(fresh.select("collection", "key"), ["collection", "key"], "left_anti")
            change = kept.select(INDEX_LOG).unionByName(gone.select("seq", F.lit("D").alias("op"), "collection", "key", "metadata", F.lit(None).cast("array<double>").alias("vector")))
        else:
            change = named.select("seq", "op", "collection", "key", "metadata", F.lit(None).cast("array<double>").alias("vector"))
        return replace(out, entries=self.entries.unionByName(cut(change)))

    def index(self) -> DataFrame:
        """The entries in force: those kept, or those of all records that belong in the index."""
        if self.entries is not None:
            return vector.latest_vectors(self.entries)
        return search.embed_records(self.state().filter(kv.is_semantic(self.settings.default_collection)), self.embedder)

    def reindexed(self, collection: str) -> Engine:
        """With one collection embedded anew."""
        return self.indexed(search.reindex(self.state(), self.index(), self.embedder, collection))

    def search(self, queries: DataFrame, k: int, collection: str | None = None, filters: dict[str, str] | None = None, degraded: bool = False) -> DataFrame:
        """Hits; through ``search_lists`` lists, of which ``search_probes`` are probed, if
        that many are set and there are vectors enough to train them."""
        k = clamp_top_k(k, self.settings.max_top_k)
        return search.semantic_search(self.state(), self.index(), queries, self.embedder, k, collection, filters, degraded, self.settings.search_lists, self.settings.search_probes)

    def route(self, records: DataFrame) -> DataFrame:
        return routing.route(records, self.nodes, self.settings.node_id, self.settings.cluster_slot_count, copies=self.settings.replication_factor)

    def migration_plan(self, pending: DataFrame | None = None) -> DataFrame:
        return routing.migration_plan(self.state(), self.nodes, self.settings.node_id, pending, self.settings.cluster_slot_count)

    def after_migration(self, tasks: DataFrame, now_ms: int) -> Engine:
        """Records of tasks whose delayed delete is due, and that are still another node's,
        deleted here with their entries (R7)."""
        due = routing.due_deletes(tasks, self.route(tasks), now_ms).select("collection", "key")
        return replace(self, nodes=None).delete(due)._with(self.nodes)

    def _with(self, nodes: DataFrame | None) -> Engine:
        return replace(self, nodes=nodes)
