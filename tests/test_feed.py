import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldstone.model import MUTATION
from foldstone.operators import feed


def apply(state, seq, version, mid):
    if state and mid and state[2] == mid:
        return state
    if state and state[1] and version and version < state[1]:
        return state
    return (seq, version, mid)


def expected(rows):
    live = {}
    for seq, op, c, k, v, m in sorted({(r[0], (r[1] or "").strip().lower()[:1], r[2] or "documents", r[3], r[4] or 0, r[5] or "") for r in rows if r[0] is not None and (r[1] or "").strip().lower() in ("p", "put", "d", "delete")}):
        if not k:
            continue
        live[c, k] = apply(live.get((c, k)), seq, v, m) if op == "p" else None
    return {(c, k, s[0]) for (c, k), s in live.items() if s}


def frame(spark, rows):
    return spark.createDataFrame([(s, op, c, k, "t", "b", {}, v, 0, m) for s, op, c, k, v, m in rows], MUTATION)


def some_rows(seed, n=600, deletes=0.1):
    rnd = random.Random(seed)
    rows = []
    for s in range(n):
        op = rnd.choice(["D", "delete ", "d"]) if rnd.random() < deletes else rnd.choice(["P", "put", " Put", "p"])
        if rnd.random() < 0.03:
            op = rnd.choice([None, "", "?"])
        rows.append((s, op, rnd.choice([None, "", "documents", "c"]), rnd.choice(["hot", "hot", "k1", "k2", "k3", None, ""]), rnd.choice([None, 0, 1, 2, 3, 4, 9]), rnd.choice([None, "", "m1", "m2", "m3", f"u{s}"])))
    rows += rnd.sample(rows, n // 10)
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,deletes,hot,span", [(1, 0.1, 20_000, 1 << 16), (2, 0.02, 20, 32), (3, 0.0, 5, 7), (4, 0.005, 1, 100)])
def test_random_logs_equal_the_rules(spark, seed, deletes, hot, span):
    rows = some_rows(seed, deletes=deletes)
    got = feed.current_state(feed.split_feed(frame(spark, rows)), hot, span)
    assert {(r["collection"], r["key"], r["seq"]) for r in got.collect()} == expected(rows)


put = st.tuples(st.integers(0, 5), st.sampled_from(["", "a", "b", "c"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(put, min_size=1, max_size=14), st.integers(0, 6), st.sampled_from(["", "a", "b", "z"]))
def test_a_slice_says_what_it_leaves_of_any_record(puts, version, mid):
    s = feed.Slice(list(range(len(puts))), [v for v, _ in puts], [m for _, m in puts])
    state = (-1, version, mid)
    for i, (v, m) in enumerate(puts):
        state = apply(state, i, v, m)
    fits = [r for r in s.table() if r[0] < version <= r[1] and (r[2] is None or r[2] == mid)]
    fits.sort(key=lambda r: r[2] is None)
    assert (fits[0][3] if fits else -1) == state[0]


def test_repeated_id_with_a_higher_version_keeps_the_first(spark):
    rows = [(1, "P", "c", "k", 5, "m1"), (2, "P", "c", "k", 9, "m1")]
    for hot in (0, 10):
        assert [r["seq"] for r in feed.current_state(feed.split_feed(frame(spark, rows)), hot).collect()] == [1]


def test_a_lower_version_after_a_delete(spark):
    rows = [(1, "P", "c", "k", 9, ""), (2, "D", "c", "k", 0, ""), (3, "P", "c", "k", 1, "")]
    assert [r["seq"] for r in feed.current_state(feed.split_feed(frame(spark, rows))).collect()] == [3]


def test_empty_feed_and_clashing_columns(spark):
    empty = frame(spark, [])
    assert feed.current_state(feed.split_feed(empty)).count() == 0
    rows = some_rows(7, 100)
    clash = frame(spark, rows).selectExpr("*", "1 as slice", "'x' as mid", "2 as d_seq", "3 as count", "4 as live_seq")
    assert {(r["collection"], r["key"], r["seq"]) for r in feed.current_state(feed.split_feed(clash), 5, 16).collect()} == expected(rows)


def test_rebuild_fetches_the_records(spark):
    rows = some_rows(8, 200)
    out = feed.rebuild(frame(spark, rows)).collect()
    assert {(r["collection"], r["key"], r["seq"]) for r in out} == expected(rows) and len(out) == len(expected(rows))
    assert all(r["title"] == "t" for r in out)


def test_appended_files(spark, tmp_path):
    rows = some_rows(6, 300)
    for i in range(3):
        feed.append_feed(frame(spark, [r for r in rows if r[0] % 3 == i]), str(tmp_path / "feed"))
    got = feed.current_state(feed.read_feed(spark, str(tmp_path / "feed")), 30, 64)
    assert {(r["collection"], r["key"], r["seq"]) for r in got.collect()} == expected(rows)


def test_sequence_numbers_need_be_unique_within_a_key_only(spark):
    rows = [(1, "put", "c", "a", "A"), (1, "put", "c", "b", "B"), (2, "put", "d", "a", "C"), (2, "delete", "c", "b", None)]
    df = spark.createDataFrame([(*r[:4], None, r[4], {}, None, None, None) for r in rows], "seq bigint, op string, collection string, key string, title string, body string, metadata map<string,string>, version bigint, updated_at_unix_ms bigint, mutation_id string")
    got = {(r["collection"], r["key"]): r["body"] for r in feed.rebuild(df).collect()}
    assert got == {("c", "a"): "A", ("d", "a"): "C"}


def test_files_are_appended_to(spark, tmp_path):
    schema = "seq bigint, op string, collection string, key string, version bigint, mutation_id string"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    path = str(tmp_path / "feed")
    feed.append_feed(batch((5, "delete", None, "a", None, None), (2, "put", None, "b", 0, "m")), path)
    feed.append_feed(batch((4, " PUT", "documents", "a", 1, "n"), (7, "nonsense", "documents", "b", 1, "n")), path)
    read = lambda: {(r["key"], r["seq"]) for r in feed.current_state(feed.read_feed(spark, path)).collect()}
    assert read() == {("b", 2)}
    feed.append_feed(batch((6, "p", "", "a", 1, "n")), path)
    assert read() == {("a", 6), ("b", 2)}
    feed.append_feed(batch(), path)
    assert read() == {("a", 6), ("b", 2)}
