import pytest
from pyspark.sql import functions as F

from foldstone.functions import service
from foldstone.model import NODE, RECORD
from foldstone.operators import kv, routing
from foldstone.sources import snapshots


@pytest.mark.parametrize("args,fine", [
    ((False, ""), True), ((True, ""), False), ((True, "k", "Bearer k"), True), ((True, "k", "bearer  k "), True),
    ((True, "k", "Bearer x", "k"), False), ((True, "k", "", " k "), True), ((True, "k", "Basic k", "k"), True), ((True, "k"), False),
])
def test_keys(args, fine):
    assert service.authorized(*args) is fine


def test_status_and_trace(spark):
    df = spark.createDataFrame([("ok",), ("timeout",), ("other",), (None,)], "s string")
    assert [r[0] for r in df.select(service.http_status(F.col("s"))).collect()] == [200, 504, 500, 500]
    t = spark.createDataFrame([("t1",), (" ",), (None,)], "t string")
    first, *made = [r[0] for r in t.select(service.trace_id(F.col("t"))).collect()]
    assert first == "t1" and all(len(x) == 36 for x in made)


def test_snapshots(spark, tmp_path):
    rows = [("c", "b", "t", "x", {"a": "1"}, 1, 2, "m"), (None, "a", None, "", {}, 0, 0, ""), ("c", "a", "", "", None, None, None, None)]
    df = spark.createDataFrame(rows, RECORD)
    path = str(tmp_path / "s")
    for _ in range(2):
        snapshots.write_snapshot(df, path)
    back = {(r["collection"], r["key"]): r for r in snapshots.read_snapshot(spark, path).collect()}
    assert back.keys() == {("c", "b"), ("documents", "a"), ("c", "a")} and back["c", "b"]["metadata"] == {"a": "1"}
    plan = snapshots.read_snapshot(spark, path).filter("collection = 'c' and key >= 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan and "GreaterThanOrEqual(key,b)" in plan
    snapshots.deliver(df.withColumn("target_id", F.lit("n1")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("target_id = 'n1'").count() == 3


def test_prefixes(spark):
    df = spark.createDataFrame([("c", k, "", "", {}, 0, 0, "") for k in ("a", "ab", "ab/1", "b", "")], RECORD)
    assert [r["key"] for r in kv.prefix_scan(df, "c", "ab").collect()] == ["ab", "ab/1"]
    assert kv.prefix_scan(df, "c", "").count() == 4


def test_few_slots_move_when_a_node_joins(spark):
    node = lambda i: (f"n{i}", "h", 1, True, 1, "")
    before, after = (spark.createDataFrame([node(i) for i in range(n)], NODE) for n in (4, 5))
    moved = routing.moved_slots(before, after).collect()
    assert {r["to_id"] for r in moved} == {"n4"} and 0.1 < len(moved) / 4096 < 0.35
    assert routing.moved_slots(before, before).count() == 0
