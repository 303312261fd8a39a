import numpy as np
import pytest
from vector_data import clustered, rows_of, unit

from foldstone.llm import ann, vectors


def brute(rows, k):
    """(collection, key) to the k best (key, cosine), ties to the smaller key."""
    out = {}
    for c in {r[0] or "documents" for r in rows}:
        own = [(r[1], unit(r[2])) for r in rows if (r[0] or "documents") == c]
        m = np.stack([v for _, v in own])
        s = m @ m.T
        for i, (key, _) in enumerate(own):
            order = sorted((j for j in range(len(own)) if j != i), key=lambda j: (-round(s[i, j], 6), own[j][0]))
            out[c, key] = [(own[j][0], s[i, j]) for j in order[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("collection", "key", "rank").collect():
        out.setdefault((r["collection"], r["key"]), []).append((r["neighbour"], r["similarity"]))
    return out


def test_small_collections_are_exact(entries):
    rows = rows_of("a", clustered(1, [20, 30], 10)) + rows_of(None, clustered(2, [9], 0)) + rows_of("few", clustered(3, [3], 0)) + rows_of("one", clustered(4, [1], 0))
    got, want = found(ann.nearest(entries(rows))), brute(rows, 5)
    assert got.keys() == {k for k, v in want.items() if v}
    for k, near in got.items():
        assert [n for n, _ in near] == [n for n, _ in want[k]]
        assert [s for _, s in near] == pytest.approx([s for _, s in want[k]], abs=1e-5)


def test_lists_reach_the_recall_asked_for(entries):
    rows = rows_of("c", clustered(5, [700, 400, 300, 150, 60], 200))
    got, want = found(ann.nearest(entries(rows))), brute(rows, 5)
    hits = sum(len({n for n, _ in got[k]} & {n for n, _ in v}) for k, v in want.items())
    assert hits / sum(len(v) for v in want.values()) >= 0.9


def test_stale_rows_and_unusable_vectors(entries):
    good = clustered(6, [8], 0)
    rows = [*rows_of("c", good), ("c", "k00000", good[1] * 2, 0), ("c", "stale", good[0], 1), ("c", "stale", None, 2)]
    odd = {"short": good[0][:64], "long": [*good[0], 1.0], "zero": np.zeros(128), "nan": [float("nan"), *good[0][1:]], "inf": [float("inf"), *good[0][1:]], "null": None, "hole": [None, *good[0][1:]], "empty": []}
    got = found(ann.nearest(entries(rows + [("c", k, v) for k, v in odd.items()])))
    assert {k for _, k in got} == {f"k{i:05}" for i in range(8)}
    assert vectors.current(entries(rows * 2)).count() == 8


def test_copies_of_one_vector(entries):
    base = clustered(7, [40], 0)
    rows = rows_of("c", base) + [("c", f"copy{i:03}", base[0] * (1 + i % 2)) for i in range(50)] + [("c", f"same{i:03}", base[1]) for i in range(60)]
    got = found(ann.nearest(entries(rows)))
    assert len(got) == len(rows)
    for i in range(60):
        own = f"same{i:03}"
        assert [n for n, _ in got["c", own]] == [n for n in ["k00001", *[f"same{j:03}" for j in range(6)]] if n != own][:5]
        assert all(s == pytest.approx(1) for _, s in got["c", own])


def test_batches_keep_the_newest_version_of_each_key():
    import pyarrow as pa

    ids = [5, 5, 7, 5, 7, 9, 5]
    keys = ["a", "a", "b", "a", "b", "c", "other"]  # the last has the hash of "a" by chance
    batch = pa.RecordBatch.from_pydict({"id": ids, "collection": ["x"] * 7, "key": keys, "version": [1, 3, 2, 2, 1, 0, 9], "n": list(range(7))})
    got = next(vectors._newest(iter([batch]))).to_pydict()
    assert {("a", 1), ("b", 2), ("c", 5), ("other", 6)} <= set(zip(got["key"], got["n"])) and 4 not in got["n"]
    empty = batch.slice(0, 0)
    assert next(vectors._newest(iter([empty]))).num_rows == 0


def test_pairs(entries):
    rows = rows_of("c", clustered(8, [5, 5], 20, spread=0.01))
    pairs = {(r["key_a"], r["key_b"]) for r in ann.similar_pairs(ann.nearest(entries(rows))).collect()}
    assert pairs == {(f"k{a:05}", f"k{b:05}") for g in (range(5), range(5, 10)) for a in g for b in g if a < b}


def test_empty_and_clashing_columns(entries):
    assert ann.nearest(entries([])).count() == 0
    df = entries(rows_of("c", clustered(9, [10], 0)))
    clash = df.selectExpr("*", "'x' as id", "1 as home", "2 as block", "3 as rank", "4 as value", "5 as owner", "6 as place", "'y' as neighbour")
    assert found(ann.nearest(clash)) == found(ann.nearest(df))


def recall(got, want):
    hits = sum(len({n for n, _ in got.get(k, [])} & {n for n, _ in v}) for k, v in want.items())
    return hits / sum(len(v) for v in want.values())


def test_fewer_lists_are_probed_than_there_are(entries):
    rows = rows_of("c", clustered(11, [400, 300, 250, 200, 150, 100, 100], 100)) + rows_of("small", clustered(12, [30], 5))
    df = entries(rows)
    lists = ann.fit(ann.current(df), probes=5, size=64).lists
    assert set(lists) == {"c"} and len(lists["c"].directions) >= 20 and lists["c"].probed.shape[1] == 5
    got, want = found(ann.nearest(df, probes=5, size=64)), brute(rows, 5)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9


def test_collections_of_several_cells(entries):
    rows = rows_of("c", clustered(13, [300, 200, 200, 100, 100], 100))
    ix = ann.fit(ann.current(entries(rows)), probes=6, size=32, cell=4)
    lists = ix.lists["c"]
    assert len(lists.cells) == 8 and lists.begins[-1] == len(lists.directions)
    vectors_ = np.stack([unit(r[2]) for r in rows]).astype(np.float32)
    home, best = lists.home(vectors_), (vectors_ @ lists.directions.T).argmax(1)
    assert (home == best).mean() > 0.9
    assert (lists.probed == np.arange(len(lists.directions))[:, None]).any(1).all()


def test_distances_from_tables_equal_products_with_decoded_codes():
    rng = np.random.default_rng(0)
    unit_rows = lambda n: (lambda m: (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32))(rng.normal(size=(n, 128)))
    centroids, books = 0.5 * unit_rows(3), (rng.normal(size=(ann.PARTS, 256, 4)) * 0.07).astype(np.float32)
    codes = rng.integers(0, 256, size=(9000, ann.PARTS)).astype(np.uint8)
    of, q = rng.integers(0, 3, size=9000), unit_rows(300)
    decoded = centroids[of] + np.concatenate([books[p][codes[:, p]] for p in range(ann.PARTS)], axis=1)
    want = np.argsort(-(q @ decoded.T), axis=1)[:, :20]
    got = ann.shortlists(q, centroids, books, of, codes, 20)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(got, want)]) > 19.8


def test_copies_of_a_code_do_not_grow_with_a_collection():
    rng = np.random.default_rng(5)
    copies = []
    for n in (500_000, 5_000_000):  # entries, in lists of the usual size
        k = n // ann.LIST
        cells = ann.directions_of(rng.normal(size=(-(-k // ann.CELL), 128)).astype(np.float32))[0]
        cell = np.sort(rng.integers(0, len(cells), k))
        centers = (cells[cell] + 0.1 * rng.normal(size=(k, 128))).astype(np.float32)
        lists = ann.arrange(centers, np.full(k, ann.LIST), cell, cells)
        assert np.bincount(lists.group).max() * ann.LIST <= 2 * ann.BLOCK
        copies.append(len(lists.seeking) / k)
    assert max(copies) <= ann.PROBES and copies[1] <= 1.1 * copies[0]
