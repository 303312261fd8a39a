import numpy as np
import pytest
from vector_data import clustered, rows_of, unit

from foldstone.llm import cluster


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["collection"], r["cluster"]), set()).add(r["key"])
    return {c: sorted(map(sorted, (v for (x, _), v in out.items() if x == c))) for c in {c for c, _ in out}}


def test_planted_clusters_come_out(entries):
    rows = rows_of("c", clustered(1, [60, 30, 5], 40)) + rows_of(None, clustered(2, [20, 4], 10))
    got = groups(cluster.clusters(entries(rows)))
    keys = lambda a, b: [f"k{i:05}" for i in range(a, b)]
    assert got["c"] == sorted([keys(0, 60), keys(60, 90), keys(90, 95)])
    assert got["documents"] == [keys(0, 20)]


def test_members_are_closest_to_their_own_mean(entries):
    rows = rows_of("c", clustered(3, [80, 50, 30], 60))
    members = cluster.clusters(entries(rows)).collect()
    by_key = {k: unit(v) for _, k, v, *_ in rows}
    means = {}
    for r in members:
        means.setdefault(r["cluster"], []).append(by_key[r["key"]])
    means = {c: unit(np.sum(v, axis=0)) for c, v in means.items()}
    for r in members:
        cosines = {c: by_key[r["key"]] @ m for c, m in means.items()}
        assert max(cosines, key=cosines.get) == r["cluster"] and cosines[r["cluster"]] >= 0.5
        assert abs(cosines[r["cluster"]] - r["cosine"]) < 1e-4


def test_no_clusters(entries):
    assert cluster.clusters(entries([])).count() == 0
    assert cluster.clusters(entries(rows_of("c", clustered(4, [4], 6)))).count() == 0
    assert cluster.clusters(entries([("c", "a", None), ("c", "b", np.zeros(128))])).count() == 0


def test_copies_repeated_and_stale_rows(entries):
    v = clustered(5, [12], 0)
    rows = rows_of("c", v) + rows_of("c", v) + [("c", f"x{i}", v[0]) for i in range(5)] + [("c", "gone", v[0], 1), ("c", "gone", None, 2)]
    assert len(groups(cluster.clusters(entries(rows)))["c"][0]) == 17


def test_description(entries):
    rows = rows_of("c", clustered(6, [30], 5))
    members = cluster.clusters(entries(rows))
    best = sorted(((r["cosine"], r["key"]) for r in members.collect()), key=lambda x: (-x[0], x[1]))[:3]
    got = cluster.describe(members).orderBy("rank").collect()
    assert [r["key"] for r in got] == [k for _, k in best] and got[0]["size"] == 30


def test_neighbours_over_partitions(spark):
    rows = [("c", i % 2, i % 3, f"k{(i * 37) % 500:04}") for i in range(500)]
    df = spark.createDataFrame(rows, "collection string, cluster int, segment_id bigint, key string")
    want, last = set(), {}
    for c, k, s, key in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        if (k, s) in last:
            want.add((c, last[k, s], key))
        last[k, s] = key
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in cluster.neighbours_in_order(df).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(want) and set(got) == want
    assert cluster.neighbours_in_order(df.limit(0)).count() == 0


def test_clashing_columns(entries):
    df = entries(rows_of("c", clustered(7, [20], 5)))
    clash = df.selectExpr("*", "1 as cluster", "2 as n", "3 as pivot", "'x' as id", "'y' as part", "4 as edge", "5 as cosine")
    assert groups(cluster.clusters(clash)) == groups(cluster.clusters(df))


def test_edge_pivots_start_whole_clusters(entries):
    # Cosines within a cluster are near 0.42: hardly any two entries reach 0.5 with each other.
    rows = rows_of("c", clustered(8, [12, 7, 20], 0, spread=0.104))
    keys = lambda a, b: [f"k{i:05}" for i in range(a, b)]
    assert groups(cluster.clusters(entries(rows), similar=0.2)) == {"c": [keys(0, 12), keys(12, 19), keys(19, 39)]}


def test_cluster_split_over_pivots(entries):
    # Cosines are 0.4 within each half and 0.32 between them: any pivot draws three of the six.
    e = np.eye(128)
    rows = rows_of("c", [0.32**0.5 * e[0] + 0.08**0.5 * e[1 + i // 3] + 0.6**0.5 * e[3 + i] for i in range(6)])
    noise = [("c", f"x{i}", e[20 + i]) for i in range(9)]
    assert groups(cluster.clusters(entries(rows + noise))) == {"c": [[f"k{i:05}" for i in range(6)]]}
    planted = rows_of("c", clustered(9, [30], 0)) + [(c, f"z{k}", v, *x) for c, k, v, *x in rows]
    assert [len(g) for g in groups(cluster.clusters(entries(planted)))["c"]] == [30, 6]


def test_means_that_still_change_are_an_error(entries):
    rows = cluster.current(entries(rows_of("c", clustered(10, [30], 0))))
    start = {"c": unit(clustered(10, [30], 0)[0])[None]}
    settled = cluster.mean_rounds(rows, start, 0.5, 0.45, 5, 500, 128)
    assert np.allclose(settled["c"], cluster.mean_rounds(rows, settled, 0.5, 0.45, 5, 1, 128)["c"])
    with pytest.raises(RuntimeError):
        cluster.mean_rounds(rows, start, 0.5, 0.45, 5, 1, 128)


def test_local_minima_equal_pivots_taken_one_by_one():
    rng = np.random.default_rng(11)
    v = np.stack([unit(x) for x in clustered(12, [30, 20, 5], 60)])
    order = rng.permutation(len(v))
    pivot = cluster.local_minima(v, order, 0.35)
    free, want = set(range(len(v))), []
    for i in np.argsort(order):
        if i in free:
            want.append(i)
            free -= {j for j in free if v[i] @ v[j] >= 0.35} | {i}
    assert sorted(set(pivot.tolist())) == sorted(want)
    for i, p in enumerate(pivot):
        near = [j for j in want if v[i] @ v[j] >= 0.35]
        assert p == i if i in want else v[i] @ v[p] == pytest.approx(max(v[i] @ v[j] for j in near))


def test_half_noise_takes_few_levels(entries, monkeypatch):
    fits = []
    fit = cluster.ann.fit
    monkeypatch.setattr(cluster.ann, "fit", lambda *a, **k: fits.append(1) or fit(*a, **k))
    rows = rows_of("c", clustered(13, [400, 300, 200, 100], 1000))
    got = groups(cluster.clusters(entries(rows)))["c"]
    assert [len(g) for g in got] == [400, 300, 200, 100]
    assert len(fits) <= 5  # levels, and the search for what they overlooked
