import random

import pytest
from pyspark.sql import functions as F
from test_feed import expected, frame, some_rows

from foldstone.functions.embed import HashEmbedder
from foldstone.operators import stats, vector
from foldstone.streaming import tables


def test_percentiles_by_nearest_rank(spark):
    rnd = random.Random(1)
    values = [rnd.choice([1.0, 2.0, rnd.random()]) for _ in range(501)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    v = sorted(x for x in values if x is not None)
    got = {r["percentile"]: r["latency"] for r in stats.percentiles(df, "v").collect()}
    assert got == {p: v[round(p / 100 * (len(v) - 1))] for p in stats.PERCENTILES}
    got = {r["percentile"]: r["latency"] for r in stats.percentiles(df, "v", (50, 99), "floor").collect()}
    assert got == {p: v[int(p / 100 * (len(v) - 1))] for p in (50, 99)}
    assert stats.percentiles(df.filter("v is null"), "v").count() == 0


def test_metrics(spark):
    log = spark.createDataFrame([("ok", 1.0), ("bad", 3.0)], "s string, v double")
    m = stats.request_metrics(log, F.col("s") == "bad", F.lit(False), F.col("v"))
    assert m.first().asDict() == {"requests": 2, "failures": 1, "degraded": 0, "average_latency": 2.0}
    assert stats.request_metrics(log.limit(0), F.col("s") == "bad", F.lit(False), F.col("v")).first()["average_latency"] == 0.0
    assert "x_requests_total 2.0" in [r["line"] for r in stats.render_metrics(m, "x").collect()]


def test_profiles(spark):
    lines = ["main 1 1.0:", " 4f inner (/bin/a)", " 5a outer (/bin/a)", " 66 [unknown] (x)", "", " 4f inner (/bin/a)", " 5a outer (/bin/a)", "", " 1a alone (b)"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line_no int, line string")
    folded = stats.fold_stacks(stats.collapse_profile(df))
    assert {(r["stack"], r["samples"]) for r in folded.collect()} == {("outer;inner", 2), ("alone", 1)}
    assert {(r["prefix"], r["depth"], r["samples"]) for r in stats.roll_up(folded).collect()} == {("", 0, 3), ("outer", 1, 2), ("outer;inner", 2, 2), ("alone", 1, 1)}


def test_frames_with_and_without_module(spark):
    lines = ["main 1 1.0:", " ffff start", " 4f f(int, char) (/bin/a b)", "zz not indented (x)", "  12   spaced name  ", "", " 1 [unknown]"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line_no int, line string")
    assert [r["stack"] for r in stats.collapse_profile(df).collect()] == ["spaced name;f(int, char);start"]
    ranked = stats.rank_siblings(stats.roll_up(spark.createDataFrame([("a;x", 1), ("a;y", 3), ("b", 4)], "stack string, samples bigint")))
    assert {r["prefix"]: r["rank"] for r in ranked.collect()} == {"": 1, "a": 1, "b": 2, "a;y": 1, "a;x": 2}


def stream_of(spark, df, path, parts=3):
    """A stream of the frame's rows in the order of seq, one file a batch."""
    rows = df.orderBy("seq").collect()
    for i in range(parts):
        own = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(own, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, df, path):
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_streamed_outcomes_equal_the_fold(spark, tmp_path):
    rows = some_rows(11, 150)
    df = frame(spark, [r for r in rows if r[0] is not None])
    out = drain(spark, tables.apply_changes(stream_of(spark, df, str(tmp_path / "in"))), str(tmp_path)).collect()
    last = {}
    for r in sorted(out, key=lambda r: r["seq"]):
        if r["outcome"] in ("applied", "deleted"):
            last[r["collection"], r["key"]] = r
    assert {(c, k, r["seq"]) for (c, k), r in last.items() if r["outcome"] == "applied"} == expected(rows)
    assert {r["outcome"] for r in out} == {"applied", "deleted", "duplicate", "stale"}


def test_index_maintenance(spark, tmp_path):
    rows = [(1, "P", "c", "a", 1, "m1"), (2, "P", "c", "b", 1, "m2"), (3, "D", "c", "a", 0, ""), (4, "P", "c", "b", 2, "m3")]
    source = stream_of(spark, frame(spark, rows), str(tmp_path / "in"), 2)
    tables.maintain_index(source, HashEmbedder(8), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    index = spark.read.parquet(str(tmp_path / "index"))
    assert [(r["key"], len(r["vector"])) for r in vector.latest_vectors(index).collect()] == [("b", 8)]
    failed = []

    class Broken:
        dimensions = 8

        def embed(self, text):
            raise RuntimeError("no model")

    source = spark.readStream.schema(frame(spark, rows).schema).parquet(str(tmp_path / "in"))
    tables.maintain_index(source, Broken(), str(tmp_path / "i2"), str(tmp_path / "cp2"), lambda b, e: failed.append((b.count(), str(e)))).awaitTermination()
    assert failed == [(4, "no model")]


@pytest.mark.parametrize("most", [1, 2])
def test_rate_limit_starts_with_the_request(spark, tmp_path, most):
    times = [0, 400, 999, 1000, 1500, 2600, 2700, 2800]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(times)], "stream string, event_id bigint, at_ms bigint").withColumn("seq", F.col("event_id"))
    out = drain(spark, tables.rate_limit(stream_of(spark, df, str(tmp_path / "in")).drop("seq"), most), str(tmp_path)).collect()
    start, used, want = -1, 0, {}
    for i, t in enumerate(times):
        if start < 0 or t - start >= 1000:
            start, used = t, 0
        used += 1
        want[i] = used <= most
    assert {r["event_id"]: r["passed"] for r in out} == want


def test_deletes_are_delayed(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", "a", 1_000), (2, "c", "b", 9_000), (3, "c", "z", 400_000), (4, "c", "z", 400_001)], "seq bigint, collection string, key string, sent_ms bigint")
    source = stream_of(spark, df, str(tmp_path / "in"), 4).withColumn("at", F.timestamp_millis("sent_ms")).withWatermark("at", "0 seconds")
    out = drain(spark, tables.delayed_deletes(source, 300_000), str(tmp_path)).collect()
    assert {r["key"] for r in out} == {"a", "b"}
