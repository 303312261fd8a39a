"""Vector top-k for given queries.

Few queries are scored by a Column expression; blocks of queries by one matrix
product per Arrow batch, with a top-k per batch before anything is shuffled. An
inverted file narrows the entries of a batch, list by list, to those that a query probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from foldstone.functions.text import matches_filters

#: Queries that are broadcast at a time; more are taken in several blocks.
QUERY_BLOCK = 4_096


def dot(a: Column, b: Column) -> Column:
    """The dot product in double, in order; -1 if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(-1.0)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def rank(scored: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The ``k`` best rows of each query with their ``rank``; ties go to the smaller key."""
    best = Window.partitionBy(by).orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(entries: DataFrame, query: list[float], k: int, collection: str | None = None, filters: dict[str, str] | None = None, overfetch: int | None = None) -> DataFrame:
    """``key, score, metadata`` of the ``k`` best entries for one query.

    Filters come first; with ``overfetch`` the best ``overfetch * k`` of all
    collections are taken before them, so that fewer than ``k`` may be left (D4).
    """
    rows = entries.withColumn("score", dot(F.col("vector"), literal(query)))
    wanted = matches_filters(F.col("metadata"), filters)
    if collection is not None:
        wanted = wanted & (F.col("collection") == collection)
    order = [F.desc("score"), F.col("key")]
    if overfetch:
        rows = rows.orderBy(*order).limit(overfetch * k)
    return rows.filter(wanted).select("key", "score", "metadata").orderBy(*order).limit(k)


Block = list[tuple[np.ndarray, np.ndarray]]  # per length: ids, and the queries as rows


def _blocks(queries: DataFrame) -> Block:
    """Queries (qid, vector), at most a block of them, by length."""
    got = queries.filter("qid is not null and vector is not null").select("qid", F.col("vector").cast("array<double>").alias("vector")).toArrow()
    ids, rows = got["qid"].to_numpy().astype(np.int64), got["vector"].combine_chunks()
    sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False) if len(rows) else np.zeros(0, int)
    return [(ids[sizes == n], rows.filter(pa.array(sizes == n)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)) for n in np.unique(sizes)]


def _best(total: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the ``k`` best of each row; ties of the last place stay in."""
    kept = min(k, total.shape[1])
    floor = -np.partition(-total, kept - 1, axis=1)[:, kept - 1]
    q, i = np.nonzero(total >= floor[:, None])
    return ids[q], places[i], total[q, i]


def _score(shared, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pc.fill_null(pc.list_value_length(batch["vector"]), -1).to_numpy(zero_copy_only=False)
            found = []
            for ids, rows in shared.value:
                n = rows.shape[1]
                total, same = np.full((len(ids), batch.num_rows), -1.0), np.flatnonzero(lengths == n)
                if len(same):
                    own = batch["vector"].take(pa.array(same))
                    total[:, same] = rows @ own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(same), n).T
                found.append(_best(total, ids, np.arange(batch.num_rows), k))
            if found:
                yield _scored(batch, found)

    return score


def _scored(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    q, i, s = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(q), batch["key"].take(pa.array(i)), pa.array(s)], names=["qid", "key", "score"])


SCORED = "qid bigint, key string, score double"


def _in_blocks(queries: DataFrame, block: int) -> Iterator[DataFrame]:
    n = queries.count()
    for i in range(max(1, -(-n // block))):
        yield queries if n <= block else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(-(-n // block))) == i)


def top_k_batch(entries: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``qid, key, score, rank`` for a table of queries (qid, vector) over all entries.

    Queries are taken ``block`` at a time, so that what is broadcast is bounded; each
    Arrow batch of entries hands on its ``k`` best per query only.
    """
    found, context = None, entries.sparkSession.sparkContext
    for part in _in_blocks(queries, block):
        got = entries.select("key", "vector").mapInArrow(_score(context.broadcast(_blocks(part)), k), SCORED)
        found = got if found is None else found.unionByName(got)
    return rank(found, k)


def fit_lists(entries: DataFrame, lists: int, seed: int = 7, least_per_list: int = 30) -> list[list[float]] | None:
    """Centroids by k-means on the cosine, or null while there are fewer than
    ``max(100, 30 * lists)`` vectors to train on (D5)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    need = max(100, least_per_list * lists)
    if entries.limit(need).count() < need:
        return None
    rows = entries.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine", maxIter=20).fit(rows)
    return [c.tolist() for c in model.clusterCenters()]


def nearest_lists(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` lists whose centroids score highest, ties to the smaller number."""
    return np.argsort(-(rows @ centroids.T), axis=1, kind="stable")[:, :n]


def _homes(shared):
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, n = batch["vector"], shared.value.shape[1]
            lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            same, home = np.flatnonzero(lengths == n), np.zeros(batch.num_rows, np.int32)  # others score -1 everywhere
            if len(same):
                rows = vectors.take(pa.array(same)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                home[same] = nearest_lists(rows, shared.value, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=[*batch.schema.names, "list_id"])

    return homes


def assign_lists(entries: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """``entries`` with ``list_id``; a column of that name is replaced."""
    shared = entries.sparkSession.sparkContext.broadcast(np.array(centroids, np.float64))
    own = entries.drop("list_id")
    return own.mapInArrow(_homes(shared), StructType([*own.schema.fields, StructField("list_id", IntegerType())]))


def probes_for(lists: int, probes: int = 0) -> int:
    """The configured number, or the root of the number of lists, at least one."""
    return min(lists, probes if probes > 0 else max(1, int(lists**0.5)))


def _probe(shared, k: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, asking = shared.value  # asking: per list the places of the queries that probe it
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pc.fill_null(pc.list_value_length(batch["vector"]), -1).to_numpy(zero_copy_only=False)
            lists, found = batch["list_id"].to_numpy(zero_copy_only=False), []
            for li in np.unique(lists):
                at, own = np.flatnonzero(lists == li), asking[int(li)]
                if not len(own):
                    continue
                total, same = np.full((len(own), len(at)), -1.0), np.flatnonzero(lengths[at] == rows.shape[1])
                if len(same):
                    vectors = batch["vector"].take(pa.array(at[same])).flatten().to_numpy(zero_copy_only=False)
                    total[:, same] = rows[own] @ vectors.astype(np.float64).reshape(len(same), -1).T
                found.append(_best(total, ids[own], at, k))
            if found:
                yield _scored(batch, found)

    return probe


def ivf_top_k(indexed: DataFrame, queries: DataFrame, centroids: list[list[float]], k: int, probes: int = 0, buffered: DataFrame | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """``qid, key, score, rank`` from the lists nearest to each query (D6), together with
    entries that wait in no list yet, which are scored exactly (D7, D8, I2).

    ``indexed`` has ``list_id`` and is best stored sorted by it. Queries, taken ``block`` at a
    time, are broadcast; a batch's entries meet, list by list, the queries that probe the list.
    Queries of another length than the centroids' find nothing in lists.
    """
    n, centers, found = probes_for(len(centroids), probes), np.array(centroids, np.float64), None
    for part in _in_blocks(queries, block):
        fit = [(ids, rows) for ids, rows in _blocks(part) if rows.shape[1] == centers.shape[1]]
        ids, rows = fit[0] if fit else (np.zeros(0, np.int64), np.zeros((0, centers.shape[1])))
        near = nearest_lists(rows, centers, n)
        asking = [np.flatnonzero((near == li).any(1)) for li in range(len(centers))]
        shared = indexed.sparkSession.sparkContext.broadcast((ids, rows, asking))
        got = indexed.select("key", "vector", "list_id").mapInArrow(_probe(shared, k), SCORED)
        found = got if found is None else found.unionByName(got)
    if buffered is not None:
        found = found.unionByName(top_k_batch(buffered, queries, k, block).select("qid", "key", "score"))
    return rank(found, k)


def latest_vectors(upserts: DataFrame) -> DataFrame:
    """The entries a log of index writes (seq, op, collection, key, vector, and metadata if
    it has that) leaves (C11)."""
    kept = [c for c in ("metadata", "vector") if c in upserts.columns]
    last = upserts.groupBy("collection", "key").agg(F.max_by(F.struct("op", *kept), "seq").alias("r"))
    return last.filter("r.op = 'P' and size(r.vector) > 0").select("collection", "key", *[f"r.{c}" for c in kept])
