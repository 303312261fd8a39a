"""Registry queries: the engine, framed files, requests, tasks and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldstone.config import Settings
from foldstone.engine import Engine
from foldstone.functions import embed, text
from foldstone.model import MUTATION, RECORD, table
from foldstone.operators import feed, routing, search, stats, vector
from foldstone.plans.data_problems import FOLD
from foldstone.plans.inputs import STATE, filled, records
from foldstone.plans.more import SQL as MORE
from foldstone.plans.reads import _SEMANTIC
from foldstone.plans.writes import _ROUTES, _TASKS, LOCAL, NOW, _drained, _plan, _sent, _stacks, _stream
from foldstone.runtime import scratch
from foldstone.sources import framed, requests
from foldstone.streaming import tables

NEW = [("documents", "engine-1", "A new one", "first body", {"lang": "en"}, 5, 7, "e:1"), ("wiki", "engine-2", "", "second body", {}, 6, 8, "e:2"), (None, "engine-3", "Third", "", None, None, None, None)]
SHORT = ["collection", "key", "title", "version"]


def _engine(spark, d, **more):
    return Engine(table(spark, d, "mutations").select(MUTATION.fieldNames()), Settings(**more))


def engine_get(spark, d):
    return filled(_engine(spark, d).get("wiki", "page/0000000001").unionByName(_engine(spark, d).get(None, "doc-0000000040"))).select(*SHORT)


def engine_range(spark, d):
    return filled(_engine(spark, d).range("wiki", "page/", "page0", 100)).select(*SHORT)


def _written(spark, d):
    """After a put of three records and a delete of one collection's keys."""
    engine = _engine(spark, d)
    gone = engine.state().filter("collection = 'tickets'").select("collection", "key")
    return engine.put(spark.createDataFrame(NEW, RECORD), NOW).delete(gone)


def engine_writes(spark, d):
    return filled(_written(spark, d).state()).select(*SHORT)


def engine_compacted(spark, d):
    """The state after a snapshot, a log behind it and a put that it refuses as a repeat."""
    kept = _written(spark, d).compacted(scratch(spark, "compacted"))
    again = spark.createDataFrame([(*NEW[0][:3], "other body", *NEW[0][4:])], RECORD)
    return filled(kept.put(again, NOW).state()).select("collection", "key", "title", "body", "version")


def engine_refusals(spark, d):
    """What is said of writes that may not be made."""
    log = table(spark, d, "mutations").select(MUTATION.fieldNames()).limit(0)
    one = spark.createDataFrame(NEW[:1], RECORD)
    cases = {
        "read-only put": lambda: Engine(log, Settings(read_only_mode=True)).put(one, NOW),
        "read-only delete": lambda: Engine(log, Settings(read_only_mode=True)).delete(one),
        "empty key": lambda: Engine(log).delete(one.withColumn("key", F.lit(""))),
        "remote owner": lambda: Engine(log, Settings(node_id="elsewhere"), table(spark, d, "nodes").filter("id = 'node-a'")).put(one, NOW),
        "too many": lambda: Engine(log, Settings(kv_batch_max_records=2)).put(spark.createDataFrame(NEW, RECORD), NOW),
    }
    said = []
    for name, case in cases.items():
        try:
            case()
            said.append((name, "ok"))
        except ValueError as refusal:
            said.append((name, str(refusal)))
    return spark.createDataFrame(said, "attempt string, outcome string")


def engine_index(spark, d):
    """Keys of the index that writes kept up: a put adds, a delete removes."""
    engine = Engine(table(spark, d, "mutations").select(MUTATION.fieldNames()).limit(0), Settings(ai_backend="deterministic", kv_batch_max_records=1 << 40))
    first = records(spark, d).filter("collection in ('wiki', 'documents')").select(RECORD.fieldNames())
    engine = engine.put(first.filter("key <> ''"), NOW).indexed().put(spark.createDataFrame(NEW, RECORD), NOW)
    engine = engine.delete(spark.createDataFrame([("documents", "engine-1")], "collection string, key string"))
    index = engine.index().select("collection", "key")
    return index.filter("key like 'engine-%'").unionByName(index.join(records(spark, d).select("collection", "key"), ["collection", "key"], "left_anti")).distinct()


def reindex(spark, d):
    """Sizes of the index after one collection was embedded anew; orphans stay."""
    entries = table(spark, d, "index_entries").select("collection", "key", "metadata", F.col("vector").cast("array<double>").alias("vector")).dropDuplicates(["collection", "key"])
    out = search.reindex(records(spark, d), entries, embed.VectorizedHashEmbedder(16), "wiki")
    return out.groupBy("collection", "key").agg(F.max(F.coalesce(F.size("vector") == 16, F.lit(False))).alias("fresh"))


def framed_round_trip(spark, d):
    framed.register(spark)
    path = scratch(spark, "framed")
    log = table(spark, d, "mutations").withColumn("op", feed.operation("op")).filter("op is not null and key <> ''").dropDuplicates(["seq"]).select(MUTATION.fieldNames())
    log.write.format("framed_log").mode("append").save(path)
    back = spark.read.format("framed_log").load(path)
    return back.groupBy("op", "collection").agg(F.count("*").alias("entries"), F.sum("version").alias("versions"), F.sum(F.length("body")).alias("characters"))


def framed_vectors(spark, d):
    framed.register(spark)
    path = scratch(spark, "vectors")
    rows = table(spark, d, "index_entries").select("collection", "key", F.lit("").alias("title"), F.lit("").alias("body"), "metadata", "version", "updated_at_unix_ms", F.lit("").alias("mutation_id"), "vector")
    rows.filter("vector is not null and forall(vector, x -> x is not null)").write.format("framed_vectors").mode("append").save(path)
    back = spark.read.format("framed_vectors").load(path)
    return back.groupBy("collection").agg(F.count("*").alias("entries"), F.sum(F.size("vector")).alias("components"))


def text_log_rewritten(spark, d):
    """Puts as older text rows, rewritten as frames and read again."""
    def escaped(c):
        return F.regexp_replace(F.regexp_replace(c, r"([\\|;=])", r"\\$1"), "\n", r"\\n")

    source, target = scratch(spark, "text"), scratch(spark, "framed")
    r = records(spark, d).filter("not contains(body, '\r')")
    line = F.concat_ws("|", F.lit("P"), *[escaped(F.col(c)) for c in ("collection", "key", "title", "body")], F.lit("a=1"), F.col("version").cast("string"), F.col("updated_at_unix_ms").cast("string"), escaped(F.col("mutation_id")))
    r.select(line.alias("value")).write.text(source)
    framed.rewrite_text_log(spark, source, target)
    return spark.read.format("framed_log").load(target).select("collection", "key", "title", "body", "version", "mutation_id")


def json_search_parse(spark, d):
    request = F.to_json(F.struct(F.col("title").alias("query"), F.col("key").alias("image_reference"), "collection", F.col("version").alias("top_k"), F.struct(F.lit("en").alias("lang"), F.lit(3).alias("n")).alias("filters")))
    r = records(spark, d).select("collection", "key", requests.search_of(request).alias("r"))
    return r.select("collection", "key", "r.query", F.col("r.image_reference").alias("image"), F.col("r.collection").alias("asked"), F.col("r.filters")["lang"].alias("lang"), F.size("r.filters").cast("bigint").alias("filters"))


def json_batch_parse(spark, d):
    e = table(spark, d, "events").withColumn("batch", F.expr("event_id div 20"))
    record = F.struct(F.col("event_type").alias("collection"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), F.col("props").alias("body"), F.col("event_id").alias("version"))
    asked = e.groupBy("batch").agg(F.to_json(F.struct(F.array_sort(F.collect_list(record)).alias("records"))).alias("json"))  # 20 a batch
    rows = requests.batch_of(asked, "json")
    return rows.select("batch", F.col("ord").cast("bigint").alias("ord"), "record.collection", "record.key", "record.body", "record.version")


def json_hits_render(spark, d):
    hits = records(spark, d).filter("version > 0").select(F.pmod(F.col("version"), F.lit(7)).alias("qid"), "collection", "key", "title", F.col("body").substr(1, 20).alias("snippet"), F.lit(0.5).alias("score"), "metadata", F.lit(False).alias("degraded"))
    ranked = vector.rank(hits.withColumn("key", F.concat_ws("/", "collection", "key")), 5)
    answer = requests.render_hits(ranked)
    return answer.select("qid", *[F.get_json_object("answer", f"$.hits[{i}].key").alias(f"key{i}") for i in (0, 4)], F.get_json_object("answer", "$.degraded").alias("degraded"))


def json_routes_render(spark, d):
    routes = routing.route(records(spark, d), table(spark, d, "nodes"), LOCAL, copies=2)
    json = routes.withColumn("json", requests.render_route())
    return json.select("collection", "key", *[F.get_json_object("json", f"$.{p}").alias(n) for n, p in (("owner", "primary.id"), ("port", "primary.port"), ("slot", "slot_id"), ("second", "replicas[1]"))])


def migration_plan_pending(spark, d):
    pending = records(spark, d).filter("collection = 'wiki'")
    tasks = routing.migration_plan(records(spark, d), table(spark, d, "nodes"), LOCAL, pending, now_ms=NOW)
    return tasks.select("collection", "key", "target_id", "migration_epoch")


def migration_deletes(spark, d):
    """Records and entries that are left once all due deletes were applied."""
    r = records(spark, d)
    due = routing.due_deletes(_sent(spark, d), routing.route(r, table(spark, d, "nodes"), LOCAL), NOW + 300_000)
    entries = table(spark, d, "index_entries").select("collection", "key").distinct()
    left = [routing.apply_due_deletes(rows, due).groupBy("collection").agg(F.count("*").alias("rows")).withColumn("kind", F.lit(kind)) for rows, kind in ((r, "records"), (entries, "entries"))]
    return left[0].unionByName(left[1]).withColumn("collection", F.coalesce(F.nullif("collection", F.lit("")), F.lit("documents"))).groupBy("kind", "collection").agg(F.sum("rows").alias("rows"))


def tasks_round_trip(spark, d):
    path = scratch(spark, "tasks")
    routing.write_tasks(_sent(spark, d), path)
    return routing.read_tasks(spark, path).select("collection", "key", "target_id", "attempts", "delete_after_unix_ms", F.when(F.col("state") == "failed", "pending").otherwise(F.col("state")).alias("state"))


def members_moved(spark, d):
    """Slots that a second version of the table of nodes moves."""
    nodes, path = table(spark, d, "nodes"), scratch(spark, "nodes")
    routing.append_members(nodes.filter("id <> 'node-d'"), path, 1)
    routing.append_members(nodes, path, 2)
    return routing.moved_slots(routing.members_at(spark, path, 1), routing.members_at(spark, path))


def load_errors(spark, d):
    e = table(spark, d, "events")
    return stats.error_histogram(e, F.col("event_type") != "error", F.concat(F.lit("code-"), (F.col("user_id") % 5).cast("string")))


def stack_siblings(spark, d):
    return stats.rank_siblings(stats.roll_up(_stacks(spark, d))).select("prefix", "parent", "samples", "rank")


def profile_collapse(spark, d):
    """One sample per record, its key's parts as frames, innermost first."""
    parts = F.reverse(F.split("key", "/"))
    framed_lines = F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("   4f0 "), x)).otherwise(F.concat(F.lit("  a1  "), x, F.lit(" (/bin/x)"))))
    lines = F.concat(F.array(F.lit("main 1 2.0:")), framed_lines, F.array(F.lit("")))
    r = records(spark, d).filter("key <> '' and not contains(key, ' ')").withColumn("file", F.concat_ws("/", "collection", "key"))
    return stats.fold_stacks(stats.collapse_profile(r.select("file", F.posexplode(lines).alias("line_no", "line"))))


def stream_index(spark, d):
    """Keys in the index that a stream of mutations left."""
    path = scratch(spark, "index")
    tables.maintain_index(_stream(spark, d, "mutations"), embed.VectorizedHashEmbedder(8), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return vector.latest_vectors(spark.read.parquet(f"{path}/rows")).select("collection", "key")


QUERIES = {f.__name__: f for f in (engine_get, engine_range, engine_writes, engine_compacted, engine_refusals, engine_index, reindex, framed_round_trip, framed_vectors, text_log_rewritten, json_search_parse, json_batch_parse, json_hits_render, json_routes_render, migration_plan_pending, migration_deletes, tasks_round_trip, members_moved, load_errors, stack_siblings, profile_collapse, stream_index)}

_LIVE = f"""{FOLD}, live AS (SELECT DISTINCT f.collection, f.key, f.s.seq AS seq, coalesce(m.title, '') AS title, coalesce(m.body, '') AS body, coalesce(m.version, 0) AS version
  FROM folded f JOIN mutations m ON m.seq = f.s.seq AND m.key = f.key AND coalesce(nullif(m.collection, ''), 'documents') = f.collection WHERE f.s.op = 'p')"""
_NEW = f"VALUES ('documents', 'engine-1', 'A new one', 'first body', 5), ('wiki', 'engine-2', '', 'second body', 6), ('documents', 'engine-3', 'Third', '', {NOW})"
_MUTATED = "WHERE key <> '' AND lower(trim(op)) IN ('p', 'put', 'd', 'delete')"
_INDEX = "SELECT DISTINCT coalesce(nullif(collection, ''), 'documents') AS collection, key FROM index_entries"

SQL = {
    "engine_get": f"{_LIVE} SELECT collection, key, title, version FROM live WHERE (collection = 'wiki' AND key = 'page/0000000001') OR (collection = 'documents' AND key = 'doc-0000000040')",
    "engine_range": f"{_LIVE} SELECT collection, key, title, version FROM live WHERE collection = 'wiki' AND key >= 'page/' AND key < 'page0' ORDER BY key LIMIT 100",
    "engine_writes": f"{_LIVE} SELECT collection, key, title, version FROM live WHERE collection <> 'tickets' UNION ALL SELECT c, k, t, v FROM ({_NEW}) n(c, k, t, b, v)",
    "engine_compacted": f"{_LIVE} SELECT collection, key, title, body, version FROM live WHERE collection <> 'tickets' UNION ALL SELECT * FROM ({_NEW}) n(c, k, t, b, v)",
    "engine_refusals": """SELECT * FROM (VALUES ('read-only put', 'unavailable: read-only'), ('read-only delete', 'unavailable: read-only'), ('empty key', 'invalid_argument: empty key'), ('too many', 'too_large')) t(attempt, outcome)
      UNION ALL SELECT 'remote owner', 'unavailable: owned by ' || id || ' at ' || host || ':' || port FROM nodes WHERE id = 'node-a'""",
    "engine_index": "SELECT 'documents' AS collection, 'engine-3' AS key",
    "reindex": f"""WITH {STATE}, old AS ({_INDEX}) SELECT coalesce(s.collection, o.collection) AS collection, coalesce(s.key, o.key) AS key, s.key IS NOT NULL AS fresh
      FROM (SELECT collection, key FROM state WHERE collection = 'wiki') s FULL JOIN old o ON o.collection = s.collection AND o.key = s.key""",
    "framed_round_trip": f"""WITH log AS (SELECT DISTINCT ON (seq) upper(substr(trim(op), 1, 1)) AS op, coalesce(collection, '') AS collection, version, body FROM mutations {_MUTATED} AND seq IS NOT NULL)
      SELECT op, collection, count(*) AS entries, sum(CASE WHEN op = 'P' THEN coalesce(version, 0) ELSE 0 END)::BIGINT AS versions, sum(CASE WHEN op = 'P' THEN length(coalesce(body, '')) ELSE 0 END)::BIGINT AS characters FROM log GROUP BY ALL""",
    "framed_vectors": """SELECT coalesce(collection, '') AS collection, count(*) AS entries, sum(len(vector))::BIGINT AS components FROM index_entries
      WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL)) = 0 GROUP BY ALL""",
    "text_log_rewritten": f"WITH {STATE} SELECT collection, key, title, body, version, mutation_id FROM state WHERE NOT contains(body, chr(13))",
    "json_search_parse": f"WITH {STATE} SELECT collection, key, title AS query, key AS image, collection AS asked, 'en' AS lang, 1 AS filters FROM state",
    "json_batch_parse": """WITH b AS (SELECT event_id // 20 AS batch, event_type AS collection, 'k' || event_id AS key, props AS body, event_id AS version FROM events)
      SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY collection, key) - 1 AS ord, collection, key, body, version FROM b""",
    "json_hits_render": f"""WITH {STATE}, h AS (SELECT version % 7 AS qid, collection || '/' || key AS key FROM state WHERE version > 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY key) AS n FROM h)
      SELECT qid, max(key) FILTER (n = 1) AS key0, max(key) FILTER (n = 5) AS key4, 'false' AS degraded FROM r GROUP BY qid""",
    "json_routes_render": f"WITH {_ROUTES} SELECT collection, key, primary_id AS owner, port::VARCHAR AS port, slot_id::VARCHAR AS slot, string_split(replicas, ',')[2] AS second FROM routes",
    "migration_plan_pending": f"WITH {_ROUTES} SELECT collection, key, primary_id AS target_id, {NOW} AS migration_epoch FROM routes WHERE primary_id <> '{LOCAL}' AND collection <> 'wiki'",
    "migration_deletes": f"""WITH {_TASKS}, due AS (SELECT collection, key FROM sent WHERE state = 'delete_pending'), entries AS ({_INDEX})
      SELECT 'records' AS kind, collection, count(*)::BIGINT AS rows FROM state ANTI JOIN due USING (collection, key) GROUP BY ALL
      UNION ALL SELECT 'entries', collection, count(*)::BIGINT FROM entries ANTI JOIN due USING (collection, key) GROUP BY ALL""",
    "tasks_round_trip": f"WITH {_TASKS} SELECT collection, key, primary_id AS target_id, attempts, delete_after_unix_ms, CASE state WHEN 'failed' THEN 'pending' ELSE state END AS state FROM sent",
    "members_moved": MORE["slots_moved"],
    "load_errors": "SELECT 'code-' || (user_id % 5) AS error, count(*) AS requests FROM events WHERE event_type = 'error' GROUP BY ALL",
    "stack_siblings": f"""WITH {STATE}, f AS (SELECT string_split(replace(key, '/', ';'), ';') AS frames FROM state WHERE key <> ''),
      n AS (SELECT frames, unnest(range(0, len(frames) + 1)) AS depth FROM f),
      g AS (SELECT array_to_string(frames[1:depth], ';') AS prefix, array_to_string(frames[1:greatest(depth - 1, 0)], ';') AS parent, depth, count(*) AS samples FROM n GROUP BY ALL)
      SELECT prefix, parent, samples, row_number() OVER (PARTITION BY parent, depth ORDER BY samples DESC, prefix) AS rank FROM g""",
    "profile_collapse": f"WITH {STATE} SELECT replace(key, '/', ';') AS stack, count(*) AS samples FROM state WHERE key <> '' AND NOT contains(key, ' ') GROUP BY ALL",
    "stream_index": f"WITH last AS (SELECT coalesce(nullif(collection, ''), 'documents') AS collection, key, arg_max(lower(trim(op)), seq) AS op FROM mutations {_MUTATED} GROUP BY ALL) SELECT collection, key FROM last WHERE op IN ('p', 'put')",
}
