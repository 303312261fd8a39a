"""Searches that end in hits: semantic, and by keywords where that degrades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldstone.functions.embed import Embedder, record_text
from foldstone.functions.text import clamp_top_k, keyword_score, matches_filters, snippet
from foldstone.model import collection_of
from foldstone.operators.kv import in_collection
from foldstone.operators.vector import assign_lists, fit_lists, ivf_top_k, top_k_batch

SCAN_LIMIT = 1000
#: Queries answered by keywords in one pass over the texts.
DEGRADED_BLOCK = 100


def keyword_search(records: DataFrame, query: str, k: int, collection: str | None = None, filters: dict[str, str] | None = None, scan_limit: int | None = SCAN_LIMIT) -> DataFrame:
    """``key, title, snippet, score`` of the ``k`` best records above 0, ties by key.

    Candidates are the first ``scan_limit`` records of the collection by key, before
    the filters; with None all records are.
    """
    rows = records.filter(in_collection(collection))
    if scan_limit is not None:
        keys = rows.select(F.col("key").alias("first_key")).distinct().orderBy("first_key").limit(scan_limit)
        rows = rows.join(F.broadcast(keys) if scan_limit <= 100 * SCAN_LIMIT else keys, F.col("key") == F.col("first_key"), "left_semi")
    rows = rows.filter(matches_filters(F.col("metadata"), filters))
    title, body, q = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")), F.lit(query)
    # keys and scores alone are shuffled; texts are read again for the few that win
    scored = rows.select(F.col("key").alias("best_key"), keyword_score(title, body, q).alias("score")).filter("score > 0")
    best = scored.groupBy("best_key").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "best_key").limit(clamp_top_k(k))
    won = rows.join(F.broadcast(best), F.col("key") == F.col("best_key")).dropDuplicates(["key"])
    return won.select("key", title.alias("title"), snippet(body, q).alias("snippet"), "score").orderBy(F.desc("score"), "key")


def embed_records(records: DataFrame, embedder: Embedder) -> DataFrame:
    """Index entries (collection, key, metadata, vector) of all records that have
    something to embed (C13); entries of records that are gone are not among them."""
    rows = records.withColumn("vector", embedder.embed(record_text(records)))
    return rows.filter("vector is not null").select(collection_of().alias("collection"), "key", "metadata", "vector")


def semantic_search(records: DataFrame, index: DataFrame, queries: DataFrame, embedder: Embedder, k: int, collection: str | None = None, filters: dict[str, str] | None = None, degraded: bool = False, lists: int = 0, probes: int = 0) -> DataFrame:
    """Hits for a table of queries (qid, query), with ``degraded``.

    Queries are embedded, matched against the filtered entries (through ``lists`` trained
    lists, if set) and joined to their records. ``degraded`` ranks by keywords instead, as
    happens where embedding is not to be had: queries are taken ``DEGRADED_BLOCK`` at a time,
    each block in one pass over the texts.
    """
    k = clamp_top_k(k)
    own = records.filter(in_collection(collection))
    asked = queries.select("qid", "query")
    if degraded:
        title, body = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
        rows = own.filter(matches_filters(F.col("metadata"), filters)).select("key", title.alias("title"), body.alias("body"))
        n, found = asked.count(), None
        blocks = max(1, -(-n // DEGRADED_BLOCK))
        for i in range(blocks):
            part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
            block = [F.struct(F.lit(r["qid"]).cast("long").alias("qid"), F.lit(r["query"] or "").alias("query")) for r in part.collect()]
            if not block:
                continue
            scores = F.array(*[F.struct(b["qid"].alias("qid"), keyword_score(F.col("title"), F.col("body"), b["query"]).alias("score")) for b in block])
            got = rows.select("key", F.inline(F.filter(scores, lambda x: x["score"] > 0)))
            found = got if found is None else found.unionByName(got)
        if found is None:
            found = rows.select("key", F.lit(0).cast("long").alias("qid"), F.lit(0.0).alias("score")).limit(0)
        top = found.groupBy("qid", "key").agg(F.max("score").alias("score"))
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "key")  # a rank limit: each task keeps k a query
        ranked = top.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).join(asked, "qid")
        return hits_with_query(ranked, own, True)
    entries = index.filter(in_collection(collection)).filter(matches_filters(F.col("metadata"), filters))
    embedded = queries.select("qid", embedder.embed(F.col("query")).alias("vector")).filter("vector is not null")
    centroids = fit_lists(entries, lists) if lists else None
    ranked = ivf_top_k(assign_lists(entries, centroids), embedded, centroids, k, probes) if centroids else top_k_batch(entries, embedded, k)
    ranked = ranked.join(queries.select("qid", "query"), "qid")
    return hits_with_query(ranked, own, False)


def hits_with_query(ranked: DataFrame, records: DataFrame, degraded: bool) -> DataFrame:
    """References joined to their records first and made distinct after, so that only
    the records that were found are shuffled."""
    stored = records.select("key", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), "metadata")
    joined = ranked.join(stored, "key").dropDuplicates(["qid", "key"])
    return joined.select("qid", "rank", "key", "title", snippet(F.col("body"), F.col("query")).alias("snippet"), "score", "metadata", F.lit(degraded).alias("degraded"))


def reindex(records: DataFrame, index: DataFrame, embedder: Embedder, collection: str) -> DataFrame:
    """The index with one collection embedded anew; its entries without a record stay,
    as do all of other collections (C13)."""
    fresh = embed_records(records.filter(in_collection(collection)), embedder)
    kept = index.withColumn("collection", collection_of()).join(fresh.select("collection", "key"), ["collection", "key"], "left_anti")
    return kept.select("collection", "key", "metadata", F.col("vector").cast("array<double>").alias("vector")).unionByName(fresh)
