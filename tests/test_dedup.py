import random

from foldstone.operators import dedup

SCHEMA = "delivery_id bigint, collection string, key string, mutation_id string, updated_at_unix_ms bigint"


def expected(rows):
    copies = {}
    for i, c, k, m, t in rows:
        if m:
            copies.setdefault((c or "documents", k or "", m), []).append((t or dedup.LAST, i))
    return {i for v in copies.values() for _, i in sorted(v)[1:]}


def found(spark, rows, **kw):
    return {r[0] for r in dedup.deduplicate_by_stamp(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def some_rows(seed, n=400):
    rnd = random.Random(seed)
    ids = ["", None, "node-a:5:1", "node-a:6:1", "cli-7", "cli-007", "CLI/1a", "x" * 300, "node-a:5:", *[f"node-b:{i % 3}:{i}" for i in range(20)], *[f"cli-{i}" for i in range(4090, 4102)]]
    return [(i, rnd.choice(["c", "", None]), rnd.choice(["k1", "k2", None]), rnd.choice(ids), rnd.choice([None, 0, 1, 2, 3])) for i in range(n)]


def test_random_feeds_equal_brute_force(spark):
    for seed in range(3):
        rows = some_rows(seed)
        for epochs in (1, 2, 4):
            assert found(spark, rows, epochs=epochs) == expected(rows)


def test_one_message_may_be_a_third_of_the_feed(spark):
    rows = [(i, "c", "k", "node-a:1:1" if i % 3 == 0 else f"node-a:1:{i}", i % 7) for i in range(3000)]
    assert found(spark, rows) == expected(rows)


def test_empty_and_all_absent(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, None, None, None, None), (2, None, None, None, None)]) == set()


def test_other_columns_do_not_matter(spark):
    rows = some_rows(9, 100)
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.selectExpr("*", "'x' as producer", "1 as number", "2 as stamp", "3 as block", "4 as lo", "5 as id", "true as old")
    assert {r[0] for r in dedup.deduplicate_by_stamp(clash).collect()} == expected(rows)
    assert set(dedup.keep_one(clash).columns) == set(clash.columns)
    assert dedup.keep_one(clash).count() == len(rows) - len(expected(rows))


def test_batches_one_after_another(spark):
    rows = some_rows(5, 300)
    seen, gone = None, set()
    for i in range(3):
        done = dedup.deduplicate(spark.createDataFrame([r for r in rows if r[0] % 3 == i], SCHEMA), seen)
        gone |= {r[0] for r in done.duplicates.collect()}
        seen = done.seen
    kept = [(c or "documents", k or "", m) for i, c, k, m, _ in rows if m and i not in gone]
    assert len(kept) == len(set(kept)) == len({(c or "documents", k or "", m) for _, c, k, m, _ in rows if m})
    ranges = seen.ranges.collect()
    by = {}
    for r in ranges:
        by.setdefault(r["producer"], []).append((r["lo"], r["hi"]))
    for spans in by.values():
        spans.sort()
        assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:]))
    assert any(r["hi"] > r["lo"] for r in ranges)


def test_ranges_that_meet_become_one(spark):
    numbers = [*range(4090, 4100), 8191, 8192, 9000, *range(20_000, 40_000, 4096)]
    rows = [(i, "c", "k", f"p-{n}", i) for i, n in enumerate(numbers)]
    df = spark.createDataFrame(rows, "delivery_id bigint, collection string, key string, mutation_id string, updated_at_unix_ms bigint")
    first = dedup.deduplicate(df.filter("delivery_id % 2 = 0"))
    both = dedup.deduplicate(df.filter("delivery_id % 2 = 1"), first.seen)
    want = [(4090, 4099), (8191, 8192), (9000, 9000), *[(n, n) for n in range(20_000, 40_000, 4096)]]
    assert sorted((r["lo"], r["hi"]) for r in both.seen.ranges.collect()) == want
    assert both.duplicates.count() == 0
    again = dedup.deduplicate(df, both.seen)
    assert again.duplicates.count() == len(numbers)
    assert sorted((r["lo"], r["hi"]) for r in again.seen.ranges.collect()) == want


def test_batches_through_a_store(spark, tmp_path):
    store = dedup.SeenStore(spark, str(tmp_path / "seen"))
    batch = lambda *rows: spark.createDataFrame(list(rows), "delivery_id bigint, collection string, key string, mutation_id string, updated_at_unix_ms bigint")
    take = lambda *rows: sorted(r[0] for r in store.take(batch(*rows)).collect())
    assert take((1, "c", "a", "n:9:1", 5), (2, "c", "a", "n:9:2", 5), (3, "c", "a", "odd", 5), (4, "c", "a", "odd", 4)) == [3]
    assert take((5, "c", "a", "n:9:2", 1), (6, "c", "b", "n:9:2", 1), (7, "c", "a", "n:8:3", 1), (8, "c", "a", "odd", 1)) == [5, 8]
    assert take() == [] and take((9, "c", "b", "n:9:2", 0), (10, None, "a", "n:8:3", 0)) == [9]
