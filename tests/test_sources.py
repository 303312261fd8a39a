import pytest
from pyspark.sql import functions as F

from foldstone import config
from foldstone.model import MUTATION
from foldstone.sources import framed, legacy, requests, wire

RECORD = {"collection": "documents", "key": "é|k", "title": "", "body": "x\ny", "metadata": {"a": "1", "b": ""}, "version": (1 << 62) + 5, "updated_at_unix_ms": -7, "mutation_id": "m"}


def test_wire_round_trips():
    assert wire.decode_record(wire.encode_record(RECORD)) == RECORD
    assert wire.decode_record(b"") == {**wire.EMPTY}
    assert wire.decode_log_entry(wire.encode_log_entry("P", RECORD)) == ("P", RECORD)
    assert wire.decode_log_entry(wire.encode_log_entry("D", RECORD)) == ("D", {**wire.EMPTY, "collection": "documents", "key": "é|k"})
    assert wire.decode_vector_entry(wire.encode_vector_entry(RECORD, [0.25, -0.5, 1.0])) == (RECORD, [0.25, -0.5, 1.0])
    assert list(wire.frames(wire.MAGIC + wire.frame(b"one") + wire.frame(b""))) == [b"one", b""]


@pytest.mark.parametrize("data", [b"", b"nonsense", wire.MAGIC + b"\1", wire.MAGIC + b"\5\0\0\0abc"])
def test_broken_frames(data):
    with pytest.raises(ValueError):
        list(wire.frames(data))


def test_known_bytes():
    # field 2 "k", field 6 300
    assert wire.encode_record({"key": "k", "version": 300}) == b"\x12\x01k\x30\xac\x02"


def test_framed_sources(spark, tmp_path):
    framed.register(spark)
    log = spark.createDataFrame([(1, "P", "c", "k", "t", "b", {"x": "y"}, 3, 4, "m"), (2, "D", "c", "k", "", "", {}, 0, 0, "")], MUTATION).coalesce(1)
    for _ in range(2):
        log.write.format("framed_log").mode("append").save(str(tmp_path / "log"))
    back = spark.read.format("framed_log").load(str(tmp_path / "log")).orderBy("seq").collect()
    assert [(r["op"], r["key"], r["metadata"], r["version"]) for r in back] == [("P", "k", {"x": "y"}, 3), ("D", "k", {}, 0)] * 2
    assert spark.read.format("framed_log").load(str(tmp_path / "none")).count() == 0
    v = log.limit(1).drop("seq", "op").withColumn("vector", F.array(F.lit(0.5).cast("float"), F.lit(-1).cast("float")))
    v.write.format("framed_vectors").mode("append").save(str(tmp_path / "vectors"))
    assert spark.read.format("framed_vectors").load(str(tmp_path / "vectors")).first()["vector"] == [0.5, -1.0]
    other = spark.read.format("framed_log").option("magic", "OTHER\\n").load(str(tmp_path / "log"))
    with pytest.raises(Exception, match="head is missing"):
        other.collect()


def test_legacy_rows(spark, tmp_path):
    assert legacy.parse_log_line("P|documents|legacy-1|Legacy title|Legacy body|team=search")[1]["metadata"] == {"team": "search"}
    op, r = legacy.parse_log_line(r"P|c|a\|b|t\\|x\ny|k\==v\;w;k2=2;k2=3;junk|5|6|m\|1")
    assert (r["key"], r["title"], r["body"], r["metadata"], r["version"], r["mutation_id"]) == ("a|b", "t\\", "x\ny", {"k": "=v;w", "k2": "2"}, 5, "m|1")
    assert legacy.parse_log_line("D|c|k") == ("D", {"collection": "c", "key": "k"})
    for bad in ("", "X|c|k", "P|a|b", "P|a|b|c|d||x|y|z", "D|k"):
        assert legacy.parse_log_line(bad) is None
    assert legacy.unescape("a\\") == "a" and legacy.split_escaped("", "|") == [""]
    assert legacy.parse_vector_row("c|k|t|b||0.5,-1")[1] == [0.5, -1.0]
    (tmp_path / "log").write_text("P|c|k|t|b|\nnonsense\nD|c|k\n")
    assert [(r["op"], r["key"]) for r in legacy.read_log(spark, str(tmp_path / "log")).orderBy("seq").collect()] == [("P", "k"), ("D", "k")]


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first()["r"]


def test_requests(spark):
    r = one(spark, requests.record_of(F.col("j")), j='{"key": "k", "value": "v", "metadata": {"a": "1", "n": 2, "z": null}, "version": -1, "title": 5}')
    assert (r["key"], r["body"], r["metadata"], r["version"], r["title"]) == ("k", "v", {"a": "1"}, 0, "")
    assert one(spark, requests.record_of(F.col("j")), j='{"body": "b", "value": "v"}')["body"] == "b"
    for bad in ("[1]", "x", "", '"s"'):
        assert one(spark, requests.record_of(F.col("j")), j=bad) is None
    s = one(spark, requests.search_of(F.col("j")), j='{"query": "q", "image_reference": "r", "image_path": "p", "top_k": 3, "filters": {"f": "v", "g": 1}}')
    assert (s["query"], s["image_reference"], s["top_k"], s["filters"]) == ("q", "p", 3, {"f": "v"})
    b = spark.createDataFrame([(1, '{"records": [{"key": "a"}, {"key": "b"}]}'), (2, '{"records": [1]}'), (3, '{"records": 5}'), (4, "{}")], "id int, j string")
    assert [(r["id"], r["ord"], r["record"]["key"]) for r in requests.batch_of(b, "j").orderBy("ord").collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_registrations(spark):
    rows = [("a", '{"host": "h", "port": 1, "weight": 150, "zone": "zone-a"}'), ("b", "10.0.0.2:9090"), ("c", '{"port": 1}'), ("d", '{"host": "h", "port": 70000}'), ("e", "{bad"), ("f", ""), ("g", "h:0"), ("i", None)]
    got = requests.parse_registrations(spark.createDataFrame(rows, "id string, value string")).orderBy("id").collect()
    assert [(r["id"], r["host"], r["port"], r["weight"], r["zone"], r["healthy"]) for r in got] == [("a", "h", 1, 150, "zone-a", True), ("b", "10.0.0.2", 9090, 100, "", True)]


def test_settings(tmp_path):
    s = config.parse("server:\n  max_top_k: 7 # seven\n  node_id: ${NODE}-x\ncluster.replication_factor: 2\nread_only_mode: YES\nai_backend: ${UNSET}\nother: 1\n", {"NODE": "n"})
    assert (s.max_top_k, s.node_id, s.replication_factor, s.read_only_mode, s.ai_backend) == (7, "n-x", 2, True, "")
    assert config.parse("") == config.Settings()
    with pytest.raises(ValueError):
        config.parse("max_top_k: many")
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none"))
