"""Most similar vectors for every vector (problem 2).

An inverted file with product-quantised residuals, asymmetric distance tables and
exact reranking, laid out for a join of a collection with itself:

1. *Fit*, on a bounded sample: a collection has one list for about ``LIST`` entries,
   however large it is. Those of many lists are first divided into cells by coarse
   centroids, fitted on the driver on at most ``SAMPLE_ALL`` vectors; the lists of each
   cell are fitted in a task of its own on ``SAMPLE`` vectors a list. One set of codebooks is
   fitted for the residuals of all.
2. *Route*: neighbouring lists of a cell are grouped up to ``BLOCK`` entries; a group is a
   task. Each vector goes once, as a query, to the group of its list, and once, as a code
   of ``PARTS`` bytes, to each group with a list that probes its own. A list probes ``PROBES``
   lists and a list is as large at any size, so the copies of a code, and the codes
   that a query is compared with, do not grow with a collection. Whole batches travel as
   packed arrays, so a shuffle row is a block of vectors, not one vector.
3. *Shortlist*: the queries of a list are compared with the codes of the lists it probes;
   distances come from tables of the query's products with the codebooks, in fixed point.
4. *Rerank*: the distinct vectors a group needs are fetched by id, once each, and the
   shortlists are ranked by their true cosines.

Exact copies would make shortlists arbitrary and lists hot. Of the copies of one
vector only the ``k + 1`` with the smallest keys are indexed; each of the others has
the first ``k`` of them as its most similar, which is what a full ranking with ties
broken by key would give.

What is broadcast is bounded by ``MAX_LISTS`` lists (some 80 MB). Beyond ``LIST * MAX_LISTS``
entries in all, some 67 million, lists grow instead of their number, and work per entry
with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldstone.llm.vectors import DIMENSIONS, current, groups, matrix

PARTS, CODES = 32, 256
#: Entries of a list, lists probed, entries reranked, entries of a task's group of lists.
LIST, PROBES, SHORTLIST, BLOCK = 512, 32, 40, 4_096
#: Bounds of what is fitted and broadcast: lists, lists of a cell, vectors that lists and cells
#: are fitted on apiece, vectors that all cells and that the codebooks are fitted on.
MAX_LISTS, CELL, SAMPLE, SAMPLE_ALL, BOOKS = 1 << 17, 256, 32, 65_536, 16_384
#: Cells in which a vector's list, and the lists that a list probes, are looked for.
NEAR_CELLS, PROBED_CELLS = 4, 16
CHUNK, TABLES = 4_096, 128
#: Fixed point of scores: those of unit vectors stay within 16 bits.
SCALE = 8_192


@dataclass
class Lists:
    """The lists of one collection, those of a cell one after the other."""

    directions: np.ndarray  # (lists, dimensions), of the centroids
    lengths: np.ndarray  # of the centroids
    probed: np.ndarray  # (lists, probes): whose codes a list's queries look at
    group: np.ndarray  # of each list: the task of its queries
    cells: np.ndarray  # (cells, dimensions): their directions
    begins: np.ndarray  # the first list of each cell, and the number of lists

    def __post_init__(self):
        n, probes = self.probed.shape
        pair = np.unique(self.probed.ravel().astype(np.int64) * (int(self.group.max()) + 1) + np.repeat(self.group, probes))
        of, self.seeking = np.divmod(pair, int(self.group.max()) + 1)  # groups that look at a list
        self.seek_begins = np.searchsorted(of, np.arange(n + 1))

    def seekers(self, li: int) -> list[int]:
        return self.seeking[self.seek_begins[li] : self.seek_begins[li + 1]].tolist()

    def centroids(self, which: np.ndarray) -> np.ndarray:
        return self.directions[which] * self.lengths[which][:, None]

    def home(self, rows: np.ndarray) -> np.ndarray:
        """The list of each vector: the most similar of its nearest cells."""
        if len(self.cells) == 1:
            return (rows @ self.directions.T).argmax(1)
        near = _most(rows @ self.cells.T, NEAR_CELLS)
        best, value = np.zeros(len(rows), np.int64), np.full(len(rows), -np.inf, np.float32)
        for c in np.unique(near):
            at, (a, b) = np.flatnonzero((near == c).any(1)), self.begins[c : c + 2]
            if a == b:
                continue
            score = rows[at] @ self.directions[a:b].T
            place = score.argmax(1)
            score = score[np.arange(len(at)), place]
            better = score > value[at]
            best[at[better]], value[at[better]] = place[better] + a, score[better]
        return best


def _most(scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` largest of each row, or of all, largest first."""
    n = min(n, scores.shape[1])
    top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(scores, top, 1), axis=1, kind="stable"), 1)


@dataclass
class Index:
    lists: dict[str, Lists]
    books: np.ndarray  # (PARTS, CODES, dimensions / PARTS)
    dimensions: int

    def of(self, collection: str) -> Lists:
        """The lists of a collection; one, at the origin, if it has none of its own."""
        zero, one = np.zeros((1, self.dimensions), np.float32), np.zeros(1, np.int64)
        return self.lists.get(collection) or Lists(zero, np.zeros(1, np.float32), one[None], one, zero, np.array([0, 1]))

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        half = 0.5 * np.einsum("pcw,pcw->pc", self.books, self.books)
        codes = np.empty((len(residuals), parts), np.uint8)
        for p in range(parts):
            codes[:, p] = (residuals[:, p * width : (p + 1) * width] @ self.books[p].T - half[p]).argmax(1)
        return codes


def kmeans(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = rows[rng.permutation(len(rows))[:k]].copy()
    if not len(centers):
        return centers
    for _ in range(rounds):
        near = (rows @ centers.T - 0.5 * np.einsum("ij,ij->i", centers, centers)).argmax(1)
        n = np.bincount(near, minlength=len(centers))
        sums = np.stack([np.bincount(near, column, len(centers)) for column in rows.T], axis=1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers).astype(np.float32)
    return centers


def directions_of(centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.linalg.norm(centers, axis=1)
    return centers / np.maximum(lengths, 1e-12)[:, None], lengths.astype(np.float32)


def chain(directions: np.ndarray) -> np.ndarray:
    """An order in which each list is followed by the most similar one still left."""
    cosine, left, out = directions @ directions.T, np.ones(len(directions), bool), [0]
    for _ in range(1, len(directions)):
        left[out[-1]] = False
        out.append(int(np.where(left, cosine[out[-1]], -np.inf).argmax()))
    return np.array(out, np.int64)


def arrange(centers: np.ndarray, sizes: np.ndarray, cell: np.ndarray, cells: np.ndarray, probes: int = PROBES, block: int = BLOCK) -> Lists:
    """Lists from their centroids and expected sizes, which lie cell by cell."""
    directions, lengths = directions_of(centers)
    begins = np.searchsorted(cell, np.arange(len(cells) + 1))
    probed = np.empty((len(centers), min(probes, len(centers))), np.int32)
    for c in range(len(cells)):
        a, b = begins[c : c + 2]
        near = _most(cells[c : c + 1] @ cells.T, len(cells))[0]
        found = np.cumsum(np.diff(begins)[near])
        few = near[: max(PROBED_CELLS, int(np.searchsorted(found, probed.shape[1])) + 1)]
        others = np.concatenate([np.arange(*begins[x : x + 2]) for x in few])
        if b > a:
            probed[a:b] = others[_most(directions[a:b] @ directions[others].T, probed.shape[1])]
    # neighbours in a cell share a group
    group = np.zeros(len(centers), np.int64)
    for c in range(len(cells)):
        a, b = begins[c : c + 2]
        if b > a:
            own = (np.cumsum(sizes[a:b]) - sizes[a:b] / 2) // block
            group[a:b] = np.unique(own, return_inverse=True)[1] + (group[:a].max() + 1 if a else 0)
    return Lists(directions, lengths, probed, group, cells, begins)


FITTED = "collection string, cell int, centers binary, sizes binary"


def _fit_cell(dimensions: int, each: int):
    def fit_cell(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        rows, name, cell = matrix(table["vector"], dimensions), key[0].as_py(), key[1].as_py()
        centers = kmeans(rows, max(1, round(len(rows) / each)), 10, np.random.default_rng(zlib.crc32(name.encode()) + cell))
        directions, _ = directions_of(centers)
        order = chain(directions)
        sizes = np.bincount((rows @ directions.T).argmax(1), minlength=len(centers))[order]
        return pa.Table.from_batches([_batch([(name, cell, centers[order].tobytes(), sizes.astype(np.int64).tobytes())], FITTED)])

    return fit_cell


def _cell_of(coarse, dimensions: int):
    def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, names = np.zeros(batch.num_rows, np.int32), batch["collection"].dictionary_encode()
            for c, at in groups(names.indices.to_numpy()):
                mine = coarse.value.get(names.dictionary[int(c)].as_py())
                if mine is not None:
                    cell[at] = (matrix(batch["vector"].take(pa.array(at)), dimensions) @ mine.T).argmax(1)
            yield pa.RecordBatch.from_arrays([batch["collection"], pa.array(cell), batch["id"], batch["vector"]], names=["collection", "cell", "id", "vector"])

    return cell_of


def _sampled(entries: DataFrame, shares: dict[str, float] | float, seed: int) -> DataFrame:
    """Entries whose hash falls under the share of their collection."""
    span = 1 << 30
    if isinstance(shares, dict):
        bounds = [F.lit(x) for c, share in shares.items() for x in (c, int(min(span, np.ceil(span * share))))]
        most = F.coalesce(F.create_map(*bounds)[F.col("collection")], F.lit(0))
    else:
        most = F.lit(int(min(span, np.ceil(span * shares))))
    return entries.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(span)) < most).select("collection", "id", "vector")


def _ordered(sample: pa.Table, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Collections and unit vectors of a sample, in an order that does not depend on tasks."""
    sample = sample.sort_by([("id", "ascending"), ("collection", "ascending")])
    rows = matrix(sample["vector"], dimensions) if len(sample) else np.zeros((0, dimensions), np.float32)
    return np.array(sample["collection"].to_pylist(), dtype=object), rows


def fit(entries: DataFrame, dimensions: int = DIMENSIONS, probes: int = PROBES, size: int = LIST, max_lists: int = MAX_LISTS, cell: int = CELL, seed: int = 0, coded: bool = True) -> Index:
    """Lists and codebooks of ``entries``, fitted on hash samples as the module says.

    Collections of fewer than two lists have one; there are at most ``max_lists / 2`` others.
    Without ``coded`` there are no codebooks, and the index can only tell lists.
    """
    context, rng = entries.sparkSession.sparkContext, np.random.default_rng(seed)
    counts = entries.groupBy("collection").count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).head()[0]
    size = max(size, -(-total // max_lists))
    sizes = {r["collection"]: r["count"] for r in counts.filter(F.col("count") >= 2 * size).orderBy("collection").collect()}  # at most total / (2 * size)
    lists: dict[str, Lists] = {}
    if sizes:
        parts = {c: -(-n // (size * cell)) for c, n in sizes.items()}
        many = {c: m for c, m in parts.items() if m > 1}
        coarse: dict[str, np.ndarray] = {}
        if many:  # no more cells in all than max_lists / cell, and one a collection
            apiece = min(SAMPLE, max(1, SAMPLE_ALL // sum(many.values())))
            names, rows = _ordered(_sampled(entries, {c: apiece * m / sizes[c] for c, m in many.items()}, seed + 1).toArrow(), dimensions)
            coarse = {c: directions_of(kmeans(rows[names == c], m, 10, rng))[0] for c, m in many.items()}
        shared = context.broadcast(coarse)
        sample = _sampled(entries, {c: SAMPLE / size for c in sizes}, seed + 2)
        placed = sample.mapInArrow(_cell_of(shared, dimensions), "collection string, cell int, id long, vector array<float>")
        fitted = placed.groupBy("collection", "cell").applyInArrow(_fit_cell(dimensions, SAMPLE), FITTED).toArrow().sort_by([("collection", "ascending"), ("cell", "ascending")])
        of = np.array(fitted["collection"].to_pylist(), dtype=object)
        for c in dict.fromkeys(of):
            own = fitted.filter(pa.array(of == c))
            centers = [np.frombuffer(x, np.float32).reshape(-1, dimensions) for x in own["centers"].to_pylist()]
            held = np.concatenate([np.frombuffer(x, np.int64) for x in own["sizes"].to_pylist()])
            which = np.repeat(own["cell"].to_numpy(), [len(x) for x in centers])
            cells = coarse.get(c, np.ones((1, dimensions), np.float32))
            lists[c] = arrange(np.concatenate(centers), held * (sizes[c] / held.sum()), which, cells, probes)
    if not coded:
        return Index(lists, np.zeros((PARTS, CODES, dimensions // PARTS), np.float32), dimensions)
    names, rows = _ordered(_sampled(entries, BOOKS / max(1, total), seed + 3).toArrow(), dimensions)
    width, books = dimensions // PARTS, np.zeros((PARTS, CODES, dimensions // PARTS), np.float32)
    for c in dict.fromkeys(names):
        at = np.flatnonzero(names == c)
        if c in lists:
            rows[at] -= lists[c].centroids(lists[c].home(rows[at]))
    for p in range(PARTS):
        own = kmeans(rows[:, p * width : (p + 1) * width], CODES, 5, rng)
        books[p, : len(own)] = own
        books[p, len(own) :] = own[0] if len(own) else 0
    return Index(lists, books, dimensions)


#: ``list`` is that of a code, or ``-1 - list`` for queries.
ROUTED = "collection string, home int, list int, ids binary, data binary"
SHORT = "collection string, home int, id long, ids binary, data binary"
RANKED = "collection string, key string, neighbour string, similarity double, rank int"


def _route(index):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            out = []
            ids, vectors = batch["id"].to_numpy(), matrix(batch["vector"], ix.dimensions)
            names = batch["collection"].dictionary_encode()
            for c, at in groups(names.indices.to_numpy()):
                name, lists = names.dictionary[int(c)].as_py(), ix.of(names.dictionary[int(c)].as_py())
                own, own_ids = vectors[at], ids[at]
                home = lists.home(own)
                codes = ix.encode(own - lists.centroids(home))
                for li, p in groups(home):
                    li = int(li)
                    out.append((name, int(lists.group[li]), -1 - li, own_ids[p].tobytes(), own[p].astype(np.float16).tobytes()))
                    packed = own_ids[p].tobytes(), codes[p].tobytes()
                    out += [(name, g, li, *packed) for g in lists.seekers(li)]
            yield _batch(out, ROUTED)

    return route


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _arrow_schema(ddl)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def shortlists(queries: np.ndarray, centroids: np.ndarray, books: np.ndarray, of_list: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
    """Positions of the ``size`` best codes for each query, by asymmetric distance;
    ``of_list`` is the centroid of each code."""
    n = len(codes)
    size = min(size, n)
    out = np.empty((len(queries), size), np.int64)
    parts, _, width = books.shape
    by_part = np.ascontiguousarray(codes.T).astype(np.intp)
    for start in range(0, len(queries), TABLES):
        q = queries[start : start + TABLES] * np.float32(SCALE)
        tables = [np.rint(books[p] @ q[:, p * width : (p + 1) * width].T).astype(np.int16) for p in range(parts)]
        coarse = np.rint(centroids @ q.T).astype(np.int16)
        spare = np.empty((CHUNK, len(q)), np.int16)

        def scores(a: int, b: int) -> np.ndarray:
            total = coarse[of_list[a:b]]
            part = spare[: b - a] if b - a <= CHUNK else np.empty_like(total)  # noqa: B023
            for table, code in zip(tables, by_part):  # noqa: B023
                total += np.take(table, code[a:b], axis=0, out=part, mode="clip")
            return total

        # The first chunk gives each query a floor that its shortlist can't fall below.
        first = min(n, max(CHUNK, size))
        got = scores(0, first).T
        top = np.argpartition(-got, size - 1, axis=1)[:, :size]
        value = np.take_along_axis(got, top, 1)
        floor = value.min(1)
        rows, places, values = [np.repeat(np.arange(len(q)), size)], [top.ravel()], [value.ravel()]
        for a in range(first, n, CHUNK):
            more = scores(a, min(n, a + CHUNK))
            place, row = np.nonzero(more > floor)
            rows.append(row)
            places.append(place + a)
            values.append(more[place, row])
        row, place, value = np.concatenate(rows), np.concatenate(places), np.concatenate(values)
        order = np.lexsort((-value, row))
        begins = np.searchsorted(row[order], np.arange(len(q)))
        out[start : start + len(q)] = place[order[begins[:, None] + np.arange(size)]]
    return out


def _shortlist(index, size: int):
    def shortlist(key: tuple, table: pa.Table) -> pa.Table:
        ix: Index = index.value
        collection, home = (k.as_py() for k in key)
        lists = ix.of(collection)
        queries: dict[int, list[tuple]] = {}
        held: dict[int, list[tuple]] = {}
        for li, ids, data in zip(table["list"].to_pylist(), table["ids"].to_pylist(), table["data"].to_pylist()):
            if li < 0:
                queries.setdefault(-1 - li, []).append((np.frombuffer(ids, np.int64), np.frombuffer(data, np.float16).reshape(-1, ix.dimensions)))
            else:
                held.setdefault(li, []).append((np.frombuffer(ids, np.int64), np.frombuffer(data, np.uint8).reshape(-1, PARTS)))
        out, need = [], []
        for li, parts in queries.items():
            q, rows = (np.concatenate(x) for x in zip(*parts))
            probed = [p for p in lists.probed[li].tolist() if p in held]
            ids = np.concatenate([i for p in probed for i, _ in held[p]])
            codes = np.concatenate([c for p in probed for _, c in held[p]])
            of = np.repeat(np.arange(len(probed)), [sum(len(i) for i, _ in held[p]) for p in probed])
            mix = np.argsort(ids, kind="stable")  # ids are hashes: every chunk is a fair sample of the lists
            best = shortlists(rows.astype(np.float32), lists.centroids(np.array(probed)), ix.books, of[mix], codes[mix], size)
            chosen = ids[mix][best]
            out.append((collection, home, None, q.tobytes(), chosen.tobytes()))
            need.append(np.unique(np.concatenate([q, chosen.ravel()])))
        if not out:
            return pa.Table.from_batches([_batch([], SHORT)])
        need = np.unique(np.concatenate(need))
        nothing = pa.nulls(len(need), pa.binary())
        wanted = pa.Table.from_arrays([pa.array([collection] * len(need), pa.string()), pa.array([home] * len(need), pa.int32()), pa.array(need), nothing, nothing], schema=_arrow_schema(SHORT))
        return pa.concat_tables([wanted, pa.Table.from_batches([_batch(out, SHORT)])])

    return shortlist


def steps(short: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries and their shortlists, few at a time: bounds the vectors that are held twice."""
    for ids, data in zip(short["ids"].to_pylist(), short["data"].to_pylist()):
        q = np.frombuffer(ids, np.int64)
        chosen = np.frombuffer(data, np.int64).reshape(len(q), -1)
        step = max(1, 12_288 // chosen.shape[1])
        for a in range(0, len(q), step):
            yield q[a : a + step], chosen[a : a + step]


def looked_up(fetched: pa.Table, owner: pa.Scalar, dimensions: int, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and vectors that a task fetched, by key, and the places of the sorted ids."""
    fetched = fetched.filter(pc.equal(fetched["owner"], owner))
    keys = np.array(fetched["key"].to_pylist(), dtype=object)
    order = np.argsort(keys, kind="stable")  # position = rank of the key
    return keys[order], fetched["id"].to_numpy()[order], matrix(fetched["vector"], dimensions, kind)[order] if len(keys) else np.zeros((0, dimensions), kind)


def _rerank(k: int, dimensions: int):
    def rerank(key: tuple, fetched: pa.Table, short: pa.Table) -> pa.Table:
        empty = pa.Table.from_batches([_batch([], RANKED)])
        keys, ids, rows = looked_up(fetched, key[0], dimensions, np.float64)
        if not len(short) or not len(keys):
            return empty
        by_id = np.argsort(ids, kind="stable")
        sorted_ids = ids[by_id]
        out = []
        for ids, data in steps(short):
            q = by_id[np.searchsorted(sorted_ids, ids)]
            near = by_id[np.searchsorted(sorted_ids, data)]
            sim = np.einsum("qd,qrd->qr", rows[q], rows[near])
            sim[near == q[:, None]] = -np.inf
            rank = np.lexsort((near, -sim), axis=1)[:, :k]
            best, value = np.take_along_axis(near, rank, 1), np.take_along_axis(sim, rank, 1)
            keep = np.isfinite(value)
            place = np.broadcast_to(np.arange(1, rank.shape[1] + 1), rank.shape)
            out.append((keys[np.broadcast_to(q[:, None], best.shape)[keep]], keys[best[keep]], value[keep], place[keep]))
        left, right, value, place = (np.concatenate(x) for x in zip(*out))
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()] * len(left), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(np.clip(value, -1, 1)), pa.array(place.astype(np.int32))],
            schema=_arrow_schema(RANKED),
        )

    return rerank


def search_all(entries: DataFrame, k: int = 5, shortlist: int = SHORTLIST, dimensions: int = DIMENSIONS, probes: int = PROBES, size: int = LIST) -> DataFrame:
    """For each distinct vector of ``entries`` (as ``vectors.current`` gives them) its
    ``k`` most similar others of the collection: ``RANKED`` rows."""
    return search_with(entries, _rerank(k, dimensions), RANKED, max(shortlist, k), dimensions, probes, size)


def search_with(entries: DataFrame, rank, schema: str, shortlist: int = SHORTLIST, dimensions: int = DIMENSIONS, probes: int = PROBES, size: int = LIST) -> DataFrame:
    """What ``rank`` makes of each group's vectors and shortlists: a function of the
    group's key (collection first) and its fetched and shortlist tables."""
    spark = entries.sparkSession
    index = spark.sparkContext.broadcast(fit(entries, dimensions, probes, size))
    group = ["collection", "home"]
    short = (
        entries.select("collection", "id", "vector")
        .mapInArrow(_route(index), ROUTED)
        .groupBy(*group)
        .applyInArrow(_shortlist(index, shortlist + 1), SHORT)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    short.count()  # both branches below read it; begun together, they would both make it
    wanted = short.filter("id is not null").select(*group, "id")
    # By id alone, as the entries are partitioned, so that only the ids move; what an
    # equal hash brings in from another collection is left out when ranking.
    fetched = wanted.join(entries.select("id", F.col("collection").alias("owner"), "key", "vector"), "id")
    lists = short.filter("id is null").select(*[F.col(c).alias(f"of_{c}") for c in group], "ids", "data")
    return fetched.groupBy(*group).cogroup(lists.groupBy(*[f"of_{c}" for c in group])).applyInArrow(rank, schema)


def nearest(entries: DataFrame, k: int = 5, shortlist: int = SHORTLIST, dimensions: int = DIMENSIONS, probes: int = PROBES, size: int = LIST) -> DataFrame:
    """``collection, key, neighbour, similarity, rank`` (1 … k) for every current,
    usable vector; similarity is the cosine, ties go to the smaller key.

    ``entries`` has ``collection, key, vector, version, segment_id``; other columns
    play no part. Nulls, stale rows and unusable vectors are as in ``vectors.current``.
    A collection with fewer than ``k + 1`` entries gives what it has, one with a single
    entry nothing, and an empty table no rows.
    """
    rows = current(entries, dimensions).persist(StorageLevel.MEMORY_AND_DISK)
    value = F.xxhash64("vector")
    classes = rows.groupBy("collection", value.alias("value")).count().filter("count > 1").drop("count")
    if classes.isEmpty():
        return search_all(rows, k, shortlist, dimensions, probes, size)
    # A task passes on k + 1 rows of a class at most, so no class is ever gathered.
    valued = rows.withColumn("value", value)
    copies = valued.join(classes, ["collection", "value"], "left_semi")
    first = Window.partitionBy("collection", "value", "vector").orderBy("key")
    heads = copies.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    indexed = valued.join(classes, ["collection", "value"], "left_anti").select(rows.columns).unionByName(heads.select(rows.columns))
    found = search_all(indexed.persist(StorageLevel.MEMORY_AND_DISK), k, shortlist, dimensions, probes, size)
    others = copies.join(heads.select("collection", "key"), ["collection", "key"], "left_anti")
    shown = heads.filter(F.col("place") <= k).select("collection", "value", "vector", F.col("key").alias("neighbour"), F.col("place").alias("rank"))
    same = others.join(shown, ["collection", "value", "vector"]).select("collection", "key", "neighbour", F.lit(1.0).alias("similarity"), "rank")
    return found.unionByName(same)


def similar_pairs(neighbours: DataFrame, least: float = 0.85) -> DataFrame:
    """``collection, key_a, key_b`` of the pairs in which one is among the other's most
    similar and whose similarity is at least ``least``."""
    close = neighbours.filter(F.col("similarity") >= least)
    return close.select("collection", F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()
