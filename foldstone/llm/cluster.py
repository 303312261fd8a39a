"""Grouping vectors into clusters of mutually similar ones (problem 4).

Parallel pivot correlation clustering, within each collection:

1. *Pivots.* Entries meet those that are near them in tasks of neighbouring lists (as
   problem 2 makes them). Within a task each entry compares its hash with those of the
   entries that resemble it: all local minima become pivots at once and absorb what is
   similar, each entry going to its closest pivot, until none is left. Pivots, now the mean
   directions of all they drew, go on as entries of the next level, in lists of their own,
   where they absorb one another; levels end when one leaves nearly as many as it got. So
   levels, and the rounds in a task, are logarithmic, however many entries are like no other.
2. *Reassignment.* Pivots that drew at least ``LEAST`` entries start the clusters. All
   entries are given to the closest pivot, if it reaches ``MEMBER``, and pivots recomputed as
   the mean directions of their members; of two whose cosine exceeds ``APART`` the larger
   stays; until nothing changes.
3. *Overlooked clusters.* A cluster whose members went to several pivots, or to outliers,
   starts from none. So each entry that reaches no mean searches its most similar others
   among such entries, and starts from the mean of its surroundings: then those of that
   mean, and only then ``MEMBER`` and ``LEAST``. Of the entries of one such cluster the one with
   the lowest hash reports it, and 2 is gone through again. A start needs one neighbour that
   reaches ``SIMILAR``, and finds members among its ``SHORTLIST`` nearest.
4. *Description.* Size and the most typical members, the medoid first: of unit vectors the
   one with the largest sum of cosines to all members is the closest to their mean.

Scale: a level moves each of its entries once; a round of reassignment moves one sum per
cluster and partition; the search is that of problem 2, over few entries. Nothing grows
faster than the entries. The driver holds, and sends out, one mean per cluster and no
entries. A cluster that holds a third of all rows is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldstone.llm import ann
from foldstone.llm.vectors import DIMENSIONS, current, groups, matrix

#: Cosines: of a pivot and those it absorbs; of a member and its mean; of two means.
SIMILAR, MEMBER, APART = 0.35, 0.5, 0.45
LEAST = 5
#: Rounds of means that are never needed; 2 or 3 are usual.
ROUNDS = 500
#: Entries that are compared with one another at a time, if a task has more.
BLOCK = 4_096
#: A level that leaves more than this share of its entries is the last.
SHRINKS = 0.9


def local_minima(directions: np.ndarray, order: np.ndarray, similar: float) -> np.ndarray:
    """For each entry the position of its pivot (its own, for a pivot): in rounds, all
    entries whose order is the lowest among the similar ones still left become pivots and
    absorb those; who resembles several goes to the closest."""
    by = np.argsort(order, kind="stable")
    close = directions[by] @ directions[by].T >= similar
    free, pivot = np.ones(len(by), bool), np.full(len(by), -1, np.int64)
    first = np.tril(close, -1)  # similar and lower
    while free.any():
        at = np.flatnonzero(free)
        new = at[~first[np.ix_(at, at)].any(1)]
        pivot[new] = new
        free[new] = False
        drawn = np.flatnonzero(free & close[:, new].any(1))
        if len(drawn):
            pivot[drawn] = new[(directions[by[drawn]] @ directions[by[new]].T).argmax(1)]
            free[drawn] = False
    out = np.empty(len(by), np.int64)
    out[by] = by[pivot]
    return out


def _by_collection(batch: pa.RecordBatch, dimensions: int):
    vectors, names = matrix(batch["vector"], dimensions), batch["collection"].dictionary_encode()
    for c, at in groups(names.indices.to_numpy()):
        yield names.dictionary[int(c)].as_py(), at, vectors[at]


#: Pivots and, at first, entries: ``length`` is that of the sum of the ``n`` unit vectors drawn.
LEVEL = "id long, collection string, vector array<float>, n long, length double"
PACKED = "collection string, home int, ids binary, vectors binary, ns binary, lengths binary"


def _meet(index, dimensions: int):
    """Whole batches to the tasks of their lists."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, length, out = batch["id"].to_numpy(), batch["n"].to_numpy(), batch["length"].to_numpy(), []
            for name, at, own in _by_collection(batch, dimensions):
                lists = index.value.of(name)
                for g, p in groups(lists.group[lists.home(own)]):
                    out.append((name, int(g), ids[at][p].tobytes(), own[p].tobytes(), n[at][p].tobytes(), length[at][p].tobytes()))
            yield ann._batch(out, PACKED)

    return meet


def _absorb(similar: float, dimensions: int):
    schema = pa.schema([("id", pa.int64()), ("collection", pa.string()), ("vector", pa.list_(pa.float32())), ("n", pa.int64()), ("length", pa.float64())])

    def absorb(key: tuple, table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()])
        ids, n, length = read("ids", np.int64), read("ns", np.int64), read("lengths", np.float64)
        rows = read("vectors", np.float32).reshape(-1, dimensions)
        order = _mixed(ids)
        by, out = np.lexsort((ids, order)), []
        for part in np.array_split(by, -(-len(by) // BLOCK)):
            pivot = local_minima(rows[part], np.arange(len(part)), similar)
            heads, which = np.unique(pivot, return_inverse=True)
            sums = np.zeros((len(heads), dimensions))
            np.add.at(sums, which, rows[part] * length[part][:, None])
            norm = np.linalg.norm(sums, axis=1)
            out.append((ids[part][heads], (sums / np.maximum(norm, 1e-12)[:, None]).astype(np.float32), np.bincount(which, n[part]).astype(np.int64), norm))
        ids, vectors, n, norm = (np.concatenate(x) for x in zip(*out))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dimensions), pa.array(vectors.ravel()))
        return pa.Table.from_arrays([pa.array(ids), pa.array([key[0].as_py()] * len(ids), pa.string()), listed, pa.array(n), pa.array(norm)], schema=schema)

    return absorb


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A hash of ids, which are hashes themselves, to order pivots by."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def pivots(rows: DataFrame, similar: float, member: float, least: int, dimensions: int) -> dict[str, np.ndarray]:
    """Mean directions, by collection, of what pivots drew that drew at least ``least``
    entries, themselves included.

    What is handed on is the mean of all these entries, not the pivot: a pivot at the
    edge of its cluster has few members within reach of ``MEMBER``. So entries resemble a
    pivot from ``similar`` on, and pivots one another from ``member`` on.
    """
    context = rows.sparkSession.sparkContext
    level, n, reach = rows.select("id", "collection", "vector", F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("length")), rows.count(), similar
    while n:
        index = context.broadcast(ann.fit(level, dimensions, coded=False))
        after = level.mapInArrow(_meet(index, dimensions), PACKED).groupBy("collection", "home").applyInArrow(_absorb(reach, dimensions), LEVEL).persist(StorageLevel.MEMORY_AND_DISK)
        left, reach = after.count(), member
        level.unpersist()  # what the entries came from is not of a level
        level, done, n = after, left > SHRINKS * n, left
        if done:
            break
    got = level.filter(F.col("n") >= least).select("collection", "id", "vector").toArrow().sort_by([("collection", "ascending"), ("id", "ascending")])
    level.unpersist()
    names, out = np.array(got["collection"].to_pylist(), dtype=object), {}
    directions = matrix(got["vector"], dimensions).astype(np.float64) if len(names) else np.zeros((0, dimensions))
    for c in dict.fromkeys(names):
        own = directions[names == c]
        out[c] = own[separate(own, np.ones(len(own)), apart=0.9)]  # nearly the same start once
    return out


SUMS = "collection string, cluster int, sum binary, n long"


def _sums(means, member: float, dimensions: int):
    """Sums over the entries closest to each mean."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for name, _, own in _by_collection(batch, dimensions):
                mine = means.value.get(name)
                if mine is None:
                    continue
                if name not in total:
                    total[name] = np.zeros((len(mine), dimensions)), np.zeros(len(mine), np.int64)
                score = own @ mine.T
                best = score.argmax(1)
                hit = score[np.arange(len(own)), best] >= member
                for k, m in groups(best[hit]):
                    total[name][0][k] += own[hit][m].sum(0, dtype=np.float64)
                    total[name][1][k] += len(m)
        rows = [(c, int(k), s[k].tobytes(), int(n[k])) for c, (s, n) in total.items() for k in np.flatnonzero(n)]
        names, which, data, counts = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(which, pa.int32()), pa.array(data, pa.binary()), pa.array(counts, pa.int64())], names=["collection", "cluster", "sum", "n"])

    return sums


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], tuple[np.ndarray, int]] = {}
    for batch in batches:
        for c, k, s, n in zip(*(batch[x].to_pylist() for x in ("collection", "cluster", "sum", "n"))):
            before, m = total.get((c, k), (0.0, 0))
            total[c, k] = before + np.frombuffer(s, np.float64), m + n
    rows = [(c, k, s.tobytes(), n) for (c, k), (s, n) in total.items()]
    names, which, data, counts = zip(*rows) if rows else ((), (), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(which, pa.int32()), pa.array(data, pa.binary()), pa.array(counts, pa.int64())], names=["collection", "cluster", "sum", "n"])


def _added(parts: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Collection, number, sum and size of each cluster, from parts of them, in order."""
    got = parts.repartition("collection", "cluster").mapInArrow(_add, SUMS).toArrow().sort_by([("collection", "ascending"), ("cluster", "ascending")])
    sums = np.array([np.frombuffer(x, np.float64) for x in got["sum"].to_pylist()]).reshape(-1, dimensions)
    return np.array(got["collection"].to_pylist(), dtype=object), got["cluster"].to_numpy(), sums, got["n"].to_numpy()


def _unit(sums: np.ndarray) -> np.ndarray:
    return sums / np.maximum(np.linalg.norm(sums, axis=-1, keepdims=True), 1e-12)


def separate(directions: np.ndarray, sizes: np.ndarray, apart: float) -> np.ndarray:
    """Positions to keep, in order: of two means closer than ``apart`` the larger."""
    left, kept = np.lexsort((np.arange(len(sizes)), -sizes)), []
    while len(left):
        kept.append(left[0])
        left = left[1:][directions[left[1:]] @ directions[left[0]] <= apart]
    return np.sort(np.array(kept, np.int64))


def mean_rounds(rows: DataFrame, start: dict[str, np.ndarray], member: float, apart: float, least: int, rounds: int, dimensions: int) -> dict[str, np.ndarray]:
    """Mean directions by collection once they no longer change; an error if they still
    do after ``rounds``."""
    means = start
    for _ in range(rounds):
        if not means:
            break
        shared = rows.sparkSession.sparkContext.broadcast({c: m.astype(np.float32) for c, m in means.items()})
        names, _, sums, sizes = _added(rows.select("collection", "vector").mapInArrow(_sums(shared, member, dimensions), SUMS), dimensions)
        after = {}
        for c in means:
            at = np.flatnonzero((names == c) & (sizes >= least))
            if not len(at):
                continue
            directions = _unit(sums[at])
            after[c] = directions[separate(directions, sizes[at], apart)]
        same = after.keys() == means.keys() and all(after[c].shape == means[c].shape and np.abs(after[c] - means[c]).max() < 1e-6 for c in after)
        means = after
        if same:
            break
    else:
        raise RuntimeError(f"cluster means still change after {rounds} rounds")
    return means


def _beyond(means, member: float, dimensions: int):
    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = np.ones(batch.num_rows, bool)
            for name, at, own in _by_collection(batch, dimensions):
                mine = means.value.get(name)
                if mine is not None:
                    left[at] = (own @ mine.T).max(1) < member
            yield batch.filter(pa.array(left))

    return beyond


FOUND = "collection string, sum binary, n long"


def _stars(similar: float, member: float, least: int, dimensions: int):
    """Clusters around each entry among its nearest, told by the member with the lowest hash."""

    def stars(key: tuple, fetched: pa.Table, short: pa.Table) -> pa.Table:
        _, ids, rows = ann.looked_up(fetched, key[0], dimensions)
        by_id, out = np.argsort(ids, kind="stable"), []
        order, sorted_ids = _mixed(ids), ids[by_id]
        for q_ids, chosen in ann.steps(short) if len(ids) else ():
            q, near = by_id[np.searchsorted(sorted_ids, q_ids)], by_id[np.searchsorted(sorted_ids, chosen)]
            near = np.concatenate([q[:, None], near], axis=1)
            once = np.concatenate([np.ones((len(q), 1), bool), near[:, 1:] != q[:, None]], axis=1)
            some = np.ones(len(q), bool)
            mean, held = rows[q], once
            for reach, enough in ((similar, 2), (similar, 2), (member, least), (member, least)):
                q, near, once, mean = q[some], near[some], once[some], mean[some]
                around = rows[near]
                held = once & (np.einsum("qd,qrd->qr", mean, around) >= reach)
                sums = np.einsum("qr,qrd->qd", held, around, dtype=np.float64)
                mean, some = _unit(sums).astype(np.float32), held.sum(1) >= enough
            lowest = np.where(held, order[near], np.uint64(2**64 - 1)).min(1) == order[q]
            for i in np.flatnonzero(some & held[:, 0] & lowest):
                out.append((key[0].as_py(), sums[i].tobytes(), int(held[i].sum())))
        return pa.Table.from_batches([ann._batch(out, FOUND)])

    return stars


def overlooked(rows: DataFrame, means: dict[str, np.ndarray], similar: float, member: float, apart: float, least: int, dimensions: int) -> dict[str, np.ndarray]:
    """Mean directions, by collection, of clusters among the entries that reach none of
    ``means``, no two of them and none of ``means`` closer than ``apart``."""
    shared = rows.sparkSession.sparkContext.broadcast({c: m.astype(np.float32) for c, m in means.items()})
    left = rows.select("id", "collection", "key", "vector").mapInArrow(_beyond(shared, member, dimensions), "id long, collection string, key string, vector array<float>").persist(StorageLevel.MEMORY_AND_DISK)
    got = ann.search_with(left, _stars(similar, member, least, dimensions), FOUND, dimensions=dimensions).toArrow()
    left.unpersist()
    names, out = np.array(got["collection"].to_pylist(), dtype=object), {}
    directions = _unit(np.array([np.frombuffer(x, np.float64) for x in got["sum"].to_pylist()]).reshape(-1, dimensions))
    for c in sorted(set(names)):
        own, n = directions[names == c], got["n"].to_numpy()[names == c]
        own, n = (x[np.lexsort((*own.T[:2], n))] for x in (own, n))  # whatever task told them first
        if c in means:
            free = (own @ means[c].T).max(1) <= apart
            own, n = own[free], n[free]
        if len(own):
            out[c] = own[separate(own, n, apart)]
    return out


def _assign(means, member: float, dimensions: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cluster, cosine = np.full(n, -1, np.int32), np.zeros(n)
            for name, at, own in _by_collection(batch, dimensions):
                mine = means.value.get(name)
                if mine is not None:
                    score = own.astype(np.float64) @ mine.T
                    best = score.argmax(1)
                    value = score[np.arange(len(own)), best]
                    cluster[at], cosine[at] = np.where(value >= member, best, -1), value
            out = pa.RecordBatch.from_arrays([batch["collection"], batch["key"], batch["segment_id"], pa.array(cluster), pa.array(cosine)], names=["collection", "key", "segment_id", "cluster", "cosine"])
            yield out.filter(pa.array(cluster >= 0))

    return assign


def clusters(entries: DataFrame, similar: float = SIMILAR, member: float = MEMBER, apart: float = APART, least: int = LEAST, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """``collection, key, segment_id, cluster, cosine`` (to the cluster's mean direction)
    of every current, usable entry that belongs to a cluster; clusters are numbered
    within their collection.

    Nulls, stale rows, repeated rows and unusable vectors are as in
    ``vectors.current``; an absent segment is 0. Entries like no cluster do not come
    out; an empty table gives no rows.
    """
    rows = current(entries, dimensions).persist(StorageLevel.MEMORY_AND_DISK)
    start = pivots(rows, similar, member, least, dimensions)
    means = mean_rounds(rows, start, member, apart, least, rounds, dimensions)
    more = overlooked(rows, means, similar, member, apart, least, dimensions)
    if more:
        means = means | {c: np.concatenate([means[c], m]) if c in means else m for c, m in more.items()}
        means = mean_rounds(rows, means, member, apart, least, rounds, dimensions)
    shared = rows.sparkSession.sparkContext.broadcast(means)
    return rows.select("collection", "key", "segment_id", "vector").mapInArrow(_assign(shared, member, dimensions), "collection string, key string, segment_id long, cluster int, cosine double")


def _marked(means, member: float, apart: float, dimensions: int):
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, fault = batch["cluster"].to_numpy(zero_copy_only=False), np.full(batch.num_rows, "", object)
            for name, at, own in _by_collection(batch, dimensions):
                numbers, directions = means.value.get(name, (np.zeros(0, np.int64), np.zeros((0, dimensions))))
                if not len(numbers):
                    continue
                score, mine = own.astype(np.float64) @ directions.T, cluster[at]
                best, inside = score.argmax(1), ~np.isnan(mine)
                own_place = np.searchsorted(numbers, np.where(inside, mine, numbers[0]).astype(np.int64))
                value = score[np.arange(len(own)), own_place]
                fault[at[inside & (best != own_place)]] = "closer to another cluster"
                fault[at[inside & (value < member - 1e-6)]] = "not similar to its cluster"
                fault[at[~inside & (score.max(1) >= apart)]] = "similar to a cluster that is not its own"
            out = pa.RecordBatch.from_arrays([batch["collection"], batch["key"], pa.array(fault, pa.string())], names=["collection", "key", "fault"])
            yield out.filter(pa.array(fault != ""))

    return marked


def faults(entries: DataFrame, members: DataFrame, member: float = MEMBER, apart: float = APART, least: int = LEAST, dimensions: int = DIMENSIONS) -> DataFrame:
    """``collection, key, fault``: what breaks a condition of the division; none should.
    Clusters that are too small or too close to another are told by number instead of key."""

    def own_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, rows = batch["cluster"].to_numpy(), []
            for name, at, own in _by_collection(batch, dimensions):
                rows += [(name, int(k), own[m].sum(0, dtype=np.float64).tobytes(), len(m)) for k, m in groups(cluster[at])]
            yield ann._batch(rows, SUMS)

    spark, kept = entries.sparkSession, members.select("collection", "key", "cluster").persist(StorageLevel.MEMORY_AND_DISK)
    rows = current(entries, dimensions).join(kept, ["collection", "key"], "left").select("collection", "key", "cluster", "vector").persist(StorageLevel.MEMORY_AND_DISK)
    names, numbers, sums, sizes = _added(rows.filter("cluster is not null").mapInArrow(own_sums, SUMS), dimensions)
    means = {c: (numbers[names == c], _unit(sums[names == c])) for c in dict.fromkeys(names)}
    told = [(names[i], str(numbers[i]), "too small") for i in np.flatnonzero(sizes < least)]
    for c, (own, directions) in means.items():
        told += [(c, str(own[i]), "too close to another") for i in range(len(own)) if (np.delete(directions, i, 0) @ directions[i] > apart).any()]
    marked = rows.mapInArrow(_marked(spark.sparkContext.broadcast(means), member, apart, dimensions), "collection string, key string, fault string")
    return marked.unionByName(spark.createDataFrame(told, "collection string, key string, fault string"))


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """Per cluster its size, mean cosine and ``typical`` most typical members, the
    medoid first (``rank`` 1); ties go to the smaller key."""
    size = members.groupBy("collection", "cluster").agg(F.count("*").alias("size"), F.avg("cosine").alias("mean_cosine"))
    order = Window.partitionBy("collection", "cluster").orderBy(F.desc("cosine"), "key")
    best = members.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= typical)
    return best.join(size, ["collection", "cluster"]).select("collection", "cluster", "size", "mean_cosine", "rank", "key", "cosine")


PAIRS = "part int, edge int, collection string, cluster int, segment_id long, key_a string, key_b string"


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours within a sorted partition, and its first and last row (edge 0, 1)."""
    names = ["part", "edge", "collection", "cluster", "segment_id", "key_a", "key_b"]

    def edge(row: dict, which: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([row["part"]], pa.int32()), pa.array([which], pa.int32()), pa.array([row["collection"]], pa.string()), pa.array([row["cluster"]], pa.int32()), pa.array([row["segment_id"]], pa.int64()), pa.array([row["key"]], pa.string()), pa.nulls(1, pa.string())],
            names=names,
        )

    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if tail is None:
            yield edge(batch.slice(0, 1).to_pylist()[0], 0)
            own = batch
        else:
            own = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        tail = batch.slice(batch.num_rows - 1, 1)
        a, b = own.slice(0, own.num_rows - 1), own.slice(1)
        same = np.ones(a.num_rows, bool)
        for c in ("collection", "cluster", "segment_id"):
            x, y = (np.array(t[c].to_pylist(), dtype=object) for t in (a, b))
            same &= x == y
        out = pa.RecordBatch.from_arrays([a["part"], pa.nulls(a.num_rows, pa.int32()), a["collection"], a["cluster"], a["segment_id"], a["key"], b["key"]], names=names)
        yield out.filter(pa.array(same))
    if tail is not None:
        yield edge(tail.to_pylist()[0], 1)


def neighbours_in_order(members: DataFrame) -> DataFrame:
    """``collection, key_a, key_b``: members of one cluster and segment with no other
    member of both between their keys.

    Rows are sorted over all partitions at once, so that one large cluster spreads
    over many tasks; the rows at the partitions' ends, two each, are paired after.
    """
    kept = members.persist(StorageLevel.MEMORY_AND_DISK)  # range partitioning reads it twice
    order = ["collection", "cluster", "segment_id", "key"]
    spread = kept.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    paired = spread.mapInArrow(_pair, PAIRS).persist(StorageLevel.MEMORY_AND_DISK)
    ends = paired.filter("edge is not null")
    following = Window.orderBy("part", "edge")  # two rows a partition
    names = ["edge", "collection", "cluster", "segment_id", "key_a"]
    across = ends.select(*names, *[F.lead(c).over(following).alias(f"next_{c}") for c in names])
    joined = " and ".join(f"next_{c} = {c}" for c in names[1:4])
    across = across.filter(f"edge = 1 and next_edge = 0 and {joined}")
    return paired.filter("edge is null").select("collection", "key_a", "key_b").unionByName(across.select("collection", "key_a", F.col("next_key_a").alias("key_b")))
