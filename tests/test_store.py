"""Reads, writes, routing and the engine, on small literal stores."""

import pytest
from pyspark.sql import functions as F

from foldstone.config import Settings
from foldstone.engine import Engine
from foldstone.functions.embed import hash60
from foldstone.model import MUTATION, NODE, RECORD
from foldstone.operators import kv, routing, state, vector
from foldstone.sources import requests


def rec(c, k, version=0, mid="", title="t", body="b", meta=None, ts=0):
    return (c, k, title, body, meta or {}, version, ts, mid)


@pytest.fixture
def store(spark):
    rows = [rec("documents", "doc-1", 10, "mutation-10", "Test title", "Test body", {"team": "search"}, 10), rec(None, "b"), rec("", "B"), rec("documents", "é"), rec("x", "k"), rec("x", "k")]
    return spark.createDataFrame(rows, RECORD)


def test_get_and_range(store):
    assert kv.get(store, None, "doc-1").first()["title"] == "Test title"
    assert kv.get(store, "documents", "none").count() == 0
    with pytest.raises(ValueError):
        kv.get(store, "documents", "")
    keys = lambda df: [r["key"] for r in df.collect()]
    assert keys(kv.range_scan(store, "documents")) == ["B", "b", "doc-1", "é"]
    assert keys(kv.range_scan(store, None, "b", "doc-1")) == ["b"]
    assert keys(kv.range_scan(store, None, limit=0)) == ["B"]
    assert keys(kv.page(store, None, "b", 1)) == ["doc-1"]
    assert [r[0] for r in kv.collections(store).collect()] == ["documents", "x"]
    assert kv.exists(store) and not kv.exists(store.limit(0))


def test_multi_get_keeps_order_and_drops_missing(spark, store):
    refs = spark.createDataFrame([(0, "x", "k"), (1, "x", "no"), (2, "", "b")], "ord int, collection string, key string")
    assert [(r["ord"], r["key"]) for r in kv.multi_get(store, refs).collect()] == [(0, "k"), (2, "b")]


def test_metadata_filters(store):
    assert kv.filter_metadata(store, {"team": "search"}).count() == 1
    assert kv.filter_metadata(store, {"team": "x"}).count() == 0 and kv.filter_metadata(store, {"no": ""}).count() == 0
    assert kv.filter_metadata(store, {}).count() == store.count()


@pytest.mark.parametrize("rows,outcome", [
    ([rec("documents", "a", 20), rec("documents", "c", 21)], "accepted"),
    ([rec("documents", "a", 20), rec("", "a", 21)], "repeated_key"),
    ([rec("documents", "p", 30), rec("documents", "doc-1", 9, "mutation-9")], "stale"),
    ([rec("documents", "doc-1", 9, "mutation-10")], "accepted"),
    ([rec("documents", "doc-1", 0)], "accepted"),
    ([rec("documents", "")], "empty_key"),
    ([rec("documents", f"k{i}") for i in range(3)], "too_large"),
])
def test_batches(spark, store, rows, outcome):
    batch = spark.createDataFrame(rows, RECORD).withColumn("batch_id", F.lit(1))
    assert state.validate_batches(batch, store, 2).first()["outcome"] == outcome


def test_engine_life(spark):
    log = spark.createDataFrame([], MUTATION)
    nodes = spark.createDataFrame([("node-local", "127.0.0.1", 8080, True, 1, "")], NODE)
    e = Engine(log, Settings(kv_batch_max_records=2), nodes)
    e = e.put(spark.createDataFrame([rec("documents", "doc-1", 10, "m10", "Gateway health", "trace identifiers")], RECORD), 1000)
    with pytest.raises(ValueError, match="stale"):
        e.put(spark.createDataFrame([rec("documents", "doc-1", 9, "m9")], RECORD), 1000)
    with pytest.raises(ValueError, match="too_large"):
        e.put(spark.createDataFrame([rec("d", str(i)) for i in range(3)], RECORD), 1000)
    with pytest.raises(ValueError, match="empty"):
        e.put(spark.createDataFrame([], RECORD), 1000)
    same = e.put(spark.createDataFrame([rec("documents", "doc-1", 10, "m10", "other")], RECORD), 1000)
    assert same.get(None, "doc-1").first()["title"] == "Gateway health"
    asked = spark.createDataFrame([(0, "trace identifiers and gateway health")], "qid bigint, query string")
    assert e.search(asked, 3).first()["key"] == "doc-1"
    assert e.search(asked.withColumn("query", F.lit("gateway")), 3, degraded=True).first()["score"] == 8.0
    assert e.route(e.state()).first()["local_owner"]
    gone = e.delete(spark.createDataFrame([("documents", "doc-1")], "collection string, key string"))
    assert gone.state().count() == 0
    back = gone.put(spark.createDataFrame([rec("documents", "doc-1", 1)], RECORD), 1000)
    assert back.get(None, "doc-1").count() == 1
    with pytest.raises(ValueError, match="read-only"):
        Engine(log, Settings(read_only_mode=True)).put(spark.createDataFrame([rec("a", "b")], RECORD), 1)


def test_stamping(spark):
    out = state.stamp(spark.createDataFrame([rec("c", "a"), rec("c", "b", 5, "m", ts=7)], RECORD), "n", 99, F.lit(3)).orderBy("key").collect()
    assert (out[0]["version"], out[0]["updated_at_unix_ms"], out[0]["mutation_id"]) == (99, 99, "n:99:3")
    assert (out[1]["version"], out[1]["updated_at_unix_ms"], out[1]["mutation_id"]) == (5, 7, "m")


def test_routes(spark):
    nodes = requests.parse_members(spark, "node-a@10.0.0.1:8080,node-b@10.0.0.2:8080,node-c@10.0.0.3:8080")
    one = spark.createDataFrame([("documents", "doc-123")], "collection string, key string")
    r = routing.route(one, nodes, "node-a", 128, 64, 2).first()
    assert r["primary_id"] and len(set(r["replicas"])) == 2 and 0 <= r["slot_id"] < 128 and r["replicas"][0] == r["primary_id"]
    assert routing.route(one, nodes, "node-a", 128, 64, 2).first() == r
    none = routing.route(one, nodes.limit(0), "node-a").first()
    assert none["primary_id"] is None and not none["local_owner"]
    text = "documents:doc-123"
    assert spark.range(1).select(hash60(F.lit(text))).first()[0] == routing.hash_text(text)


def test_migration_life(spark):
    remote = spark.createDataFrame([("remote-node", "10.0.0.2", 9090, True, 1, "")], NODE)
    rows = spark.createDataFrame([rec("documents", "a"), rec("x", "b", title="")], RECORD)
    plan = routing.migration_plan(rows, remote, "local-node")
    assert {(r["key"], r["semantic"]) for r in plan.collect()} == {("a", True), ("b", False)}
    assert routing.migration_plan(rows, remote, "local-node", plan.filter("key = 'a'")).count() == 1
    results = spark.createDataFrame([("documents", "a", True), ("x", "b", False)], "collection string, key string, ok boolean")
    after = routing.step_tasks(plan, results, 1000, max_retries=1, delete_delay_ms=50)
    assert {(r["key"], r["state"], r["attempts"]) for r in after.collect()} == {("a", "delete_pending", 0), ("b", "failed", 1)}
    routes = routing.route(rows, remote, "local-node")
    assert routing.due_deletes(after, routes, 1049).count() == 0 and routing.due_deletes(after, routes, 1050).count() == 1
    guard = state.write_guard(routes, "local-node").first()["outcome"]
    assert "10.0.0.2:9090" in guard


def test_seed_records_only_into_an_empty_store(spark, store):
    assert routing.demo_records(spark).count() == 3 and routing.demo_records(spark, store).count() == 0


def test_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [1.0, 0.0]), ("d", [1.0])]
    e = spark.createDataFrame(rows, "key string, vector array<float>").withColumn("collection", F.lit("v")).withColumn("metadata", F.create_map(F.lit("k"), F.col("key")))
    assert [(r["key"], round(r["score"], 6)) for r in vector.top_k(e, [1.0, 0.0], 9).collect()] == [("a", 1.0), ("c", 1.0), ("b", 0.6), ("d", -1.0)]
    assert [r["key"] for r in vector.top_k(e, [1.0, 0.0], 1, filters={"k": "b"}).collect()] == ["b"]
    assert vector.top_k(e, [1.0, 0.0], 1, filters={"k": "b"}, overfetch=2).count() == 0
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid bigint, vector array<float>")
    for block in (1, 4096):
        got = vector.top_k_batch(e, q, 2, block).orderBy("qid", "rank").collect()
        assert [(r["qid"], r["key"]) for r in got] == [(1, "a"), (1, "c"), (2, "b"), (2, "a")]
    log = spark.createDataFrame([(1, "P", "c", "k", [1.0]), (2, "D", "c", "k", None), (1, "P", "c", "j", [2.0])], "seq bigint, op string, collection string, key string, vector array<float>")
    assert [r["key"] for r in vector.latest_vectors(log).collect()] == ["j"]
    assert vector.fit_lists(e, 2) is None
