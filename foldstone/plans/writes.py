"""Registry queries: writes, vectors, routing, statistics, streams (A20–A22, C, D, F, G, R, S)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from foldstone.functions import embed, text
from foldstone.model import table
from foldstone.operators import feed, routing, state, stats, vector
from foldstone.plans import data_problems
from foldstone.plans.inputs import DOT, ENTRIES, HASH60, LOG, STATE, entries, event_log, first_vector, first_vectors, records, vector_queries
from foldstone.runtime import shared_folder
from foldstone.sources import requests
from foldstone.streaming import tables

NOW = 1_700_000_000_000
LOCAL = "node-a"


def log_outcomes(spark, d):
    return state.outcomes(event_log(spark, d))


def log_latest(spark, d):
    return state.latest(event_log(spark, d)).select("collection", "key", "seq", "version", "mutation_id")


def log_with_deletes(spark, d):
    return feed.current_state(feed.split_feed(event_log(spark, d, deletes=True)))


def log_with_repeats(spark, d):
    return feed.current_state(feed.split_feed(event_log(spark, d, repeats=True)))


def log_replay(spark, d):
    log = table(spark, d, "mutations").withColumn("op", feed.operation("op")).filter("op is not null and key <> ''")
    return state.replay(records(spark, d), log)


def stamp_mutations(spark, d):
    t = state.stamp(table(spark, d, "deliveries"), "node-x", NOW, F.col("delivery_id"))
    return t.select("delivery_id", "version", "updated_at_unix_ms", "mutation_id")


def batch_validate(spark, d):
    return state.validate_batches(table(spark, d, "deliveries"), records(spark, d), 150)


def batch_duplicates(spark, d):
    return state.repeated_keys(table(spark, d, "deliveries"))


def apply_migrated(spark, d):
    m = state.migrated(records(spark, d), "trace-1", "node-x", NOW)
    return m.select("collection", "key", "version", text.map_text(F.col("metadata")).alias("metadata"))


def index_latest(spark, d):
    log = table(spark, d, "index_entries").select(F.coalesce("version", F.lit(0)).alias("seq"), F.lit("P").alias("op"), "collection", "key", "vector")
    return vector.latest_vectors(log).select("collection", "key", F.size("vector").cast("bigint").alias("dimensions"))


def vector_topk_exact(spark, d):
    return vector.top_k(entries(spark, d), first_vector(spark, d), 10, "vectors").select("key", F.round("score", 6).alias("score"))


def vector_topk_filtered(spark, d):
    return vector.top_k(entries(spark, d), first_vector(spark, d), 10, "vectors", {"label": "3"}).select("key", F.round("score", 6).alias("score"))


def vector_overfetch(spark, d):
    return vector.top_k(entries(spark, d), first_vector(spark, d), 10, "vectors", {"label": "3"}, overfetch=4).select("key", F.round("score", 6).alias("score"))


def vector_topk_batch(spark, d):
    return vector.top_k_batch(entries(spark, d), vector_queries(spark, d), 10).select("qid", "key", "rank", F.round("score", 6).alias("score"))


def vector_dim_mismatch(spark, d):
    short = F.when(F.col("metadata")["label"] == "0", F.slice("vector", 1, 32)).otherwise(F.col("vector"))
    scored = entries(spark, d).select("key", vector.dot(short, vector.literal(first_vector(spark, d))).alias("score"))
    return scored.select("key", F.round("score", 6).alias("score"))


def l2_normalize(spark, d):
    v = embed.l2_normalize(F.transform("vector", lambda x: x * 3))
    return entries(spark, d).select("key", v.alias("v")).select("key", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in (0, 31, 63)])


def _lists(spark, d, n=16):
    return first_vectors(spark, d, n)


def ivf_topk_fixed(spark, d):
    centroids = _lists(spark, d)
    lists = vector.assign_lists(entries(spark, d), centroids)
    return vector.ivf_top_k(lists, vector_queries(spark, d), centroids, 10).select("qid", "key", "rank", F.round("score", 6).alias("score"))


def ivf_topk_buffered(spark, d):
    centroids, all_entries = _lists(spark, d), entries(spark, d)
    waiting = F.col("metadata")["label"] == "0"
    lists = vector.assign_lists(all_entries.filter(~waiting), centroids)
    return vector.ivf_top_k(lists, vector_queries(spark, d), centroids, 10, buffered=all_entries.filter(waiting)).select("qid", "key", "rank", F.round("score", 6).alias("score"))


def ivf_topk_trained(spark, d):
    rows = entries(spark, d)
    centroids = vector.fit_lists(rows, 16)
    if centroids is None:
        return vector.top_k_batch(rows, vector_queries(spark, d), 10)
    return vector.ivf_top_k(vector.assign_lists(rows, centroids), vector_queries(spark, d), centroids, 10)


def slot_assign(spark, d):
    return records(spark, d).select("collection", "key", routing.slot_of(F.col("collection"), F.col("key")).alias("slot_id"))


def ring_build(spark, d):
    return routing.ring_table(table(spark, d, "nodes"))


def slot_owners(spark, d):
    own = routing.slot_owners(table(spark, d, "nodes"), copies=2)
    return own.select("slot_id", "primary_id", F.array_join("replicas", ",").alias("replicas"))


def route_records(spark, d):
    r = routing.route(records(spark, d), table(spark, d, "nodes"), LOCAL, copies=2)
    return r.select("collection", "key", "slot_id", "primary_id", "primary_host", "primary_port", F.array_join("replicas", ",").alias("replicas"), "local_owner")


def write_guard(spark, d):
    routes = routing.route(records(spark, d), table(spark, d, "nodes"), LOCAL)
    return state.write_guard(routes, LOCAL).select("collection", "key", "outcome")


def _plan(spark, d):
    return routing.migration_plan(records(spark, d), table(spark, d, "nodes"), LOCAL)


def migration_plan(spark, d):
    return _plan(spark, d).select("collection", "key", "target_id", "target_host", "target_port", "semantic", "attempts", "state")


def _sent(spark, d):
    """Tasks after a round in which keys with an odd hash went through."""
    tasks = _plan(spark, d)
    results = tasks.select("collection", "key", (embed.hash60(F.col("key")) % 2 == 1).alias("ok"))
    return routing.step_tasks(tasks.withColumn("attempts", (embed.hash60(F.col("key")) % 5).cast("int")), results, NOW)


def migration_step(spark, d):
    return _sent(spark, d).select("collection", "key", "attempts", "state", "delete_after_unix_ms")


def migration_status(spark, d):
    return stats.count_states(_sent(spark, d))


def migration_due(spark, d):
    routes = routing.route(records(spark, d), table(spark, d, "nodes"), LOCAL)
    return routing.due_deletes(_sent(spark, d), routes, NOW + 300_000).select("collection", "key", "target_id")


def members_parse(spark, d):
    n = table(spark, d, "nodes").orderBy("id").collect()  # a handful of nodes
    listed = ",".join(f"{r['id']}@{r['host']}:{r['port']}" for r in n) + ",broken,x@:1,y@h:70000"
    return requests.parse_members(spark, listed).select("id", "host", "port", "weight")


def registrations_parse(spark, d):
    n = table(spark, d, "nodes")
    as_json = n.select(F.concat(F.lit("/"), "id").alias("id"), F.to_json(F.struct("id", "host", "port", F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("zone", F.lit("")).alias("zone"))).alias("value"))
    legacy = n.select(F.concat(F.lit("old-"), "id").alias("id"), F.concat_ws(":", "host", F.col("port").cast("string")).alias("value"))
    broken = spark.createDataFrame([("a", '{"port": 1}'), ("b", "host:0"), ("c", "{"), ("d", ""), ("e", '{"host": "h", "port": 70000}')], "id string, value string")
    return requests.parse_registrations(as_json.unionByName(legacy).unionByName(broken))


def _failed():
    return F.col("event_type") == "error"


def request_metrics(spark, d):
    m = stats.request_metrics(table(spark, d, "events"), _failed(), F.col("value") > 100, F.col("value"))
    return m.withColumn("average_latency", F.round("average_latency", 4))


def metrics_text(spark, d):
    m = stats.request_metrics(table(spark, d, "events"), _failed(), F.col("value") > 100, F.col("value"))
    return stats.render_metrics(m.withColumn("average_latency", F.round("average_latency", 2)))


def latency_percentiles(spark, d):
    return stats.percentiles(table(spark, d, "events"), "value")


def latency_percentiles_floor(spark, d):
    return stats.percentiles(table(spark, d, "events"), "value", (50, 95, 99), "floor")


def load_summary(spark, d):
    s = stats.load_summary(table(spark, d, "events"), ~_failed(), "value", 30.0, 100)
    return s.select("successes", "errors", *[F.round(c, 4).alias(c) for c in ("qps", "records_per_s", "average", "largest")])


def _stacks(spark, d):
    return stats.fold_stacks(records(spark, d).select(F.translate("key", "/", ";").alias("stack")))


def stack_fold(spark, d):
    return _stacks(spark, d)


def stack_rollup(spark, d):
    return stats.roll_up(_stacks(spark, d))


def _requests(spark, d):
    ms = F.expr("unix_millis(cast(ts as timestamp))")
    return table(spark, d, "events").select(F.col("event_type").alias("stream"), "event_id", ms.alias("at_ms"))


def rate_limit_aligned(spark, d):
    return tables.rate_limit_aligned(_requests(spark, d), 1)


def _stream(spark, d, name):
    """A table as a stream of its files."""
    path = f"{d}/{name}.parquet"
    source = spark.readStream.schema(table(spark, d, name).schema)
    return source.parquet(path) if os.path.isdir(path) else source.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _drained(spark, df):
    """All that a stream gives until its input ends, from the shared folder."""
    out = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    run = df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def stream_state(spark, d):
    """Live keys by the last applied change of the stream."""
    told = _drained(spark, tables.apply_changes(_stream(spark, d, "mutations"))).filter("outcome in ('applied', 'deleted')")
    last = told.groupBy("collection", "key").agg(F.max_by("outcome", "seq").alias("outcome"), F.max("seq").alias("seq"))
    return last.filter("outcome = 'applied'").select("collection", "key", "seq")


def stream_rate_limit(spark, d):
    ms = F.expr("unix_millis(cast(ts as timestamp))")
    asked = _stream(spark, d, "events").select(F.lit("all").alias("stream"), "event_id", ms.alias("at_ms"))
    return _drained(spark, tables.rate_limit(asked, 1))


QUERIES = {f.__name__: f for f in (log_outcomes, log_latest, log_with_deletes, log_with_repeats, log_replay, stamp_mutations, batch_validate, batch_duplicates, apply_migrated, index_latest, vector_topk_exact, vector_topk_filtered, vector_overfetch, vector_topk_batch, vector_dim_mismatch, l2_normalize, ivf_topk_fixed, ivf_topk_buffered, ivf_topk_trained, slot_assign, ring_build, slot_owners, route_records, write_guard, migration_plan, migration_step, migration_status, migration_due, members_parse, registrations_parse, request_metrics, metrics_text, latency_percentiles, latency_percentiles_floor, load_summary, stack_fold, stack_rollup, rate_limit_aligned, stream_state, stream_rate_limit)}


def _log(deletes: bool = False, repeats: bool = False) -> str:
    op = "CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END" if deletes else "'P'"
    mid = "'e-' || (event_id // 3)" if repeats else "'e-' || event_id"
    return LOG.replace("{op}", op).replace("{collection}", "'events'" if deletes else "event_type").replace("{mid}", mid)


_FOLDED = """folded AS (SELECT collection, key, list_reduce(list({'seq': seq, 'op': op, 'version': version, 'mid': mid} ORDER BY seq),
  lambda s, c: CASE WHEN c.op = 'D' THEN {'seq': c.seq, 'op': 'D', 'version': 0::BIGINT, 'mid': ''}
    WHEN s.op = 'P' AND c.mid = s.mid THEN s WHEN s.op = 'P' AND c.version < s.version THEN s ELSE c END,
  {'seq': -1::BIGINT, 'op': 'D', 'version': 0::BIGINT, 'mid': ''}) AS s FROM log GROUP BY collection, key)
  SELECT collection, key, s.seq AS seq, s.version AS version, s.mid AS mutation_id FROM folded WHERE s.op = 'P'"""
_BATCH = """batch AS (SELECT batch_id, coalesce(nullif(collection, ''), 'documents') AS collection, coalesce(key, '') AS key,
  coalesce(version, 0) AS version, coalesce(mutation_id, '') AS mid FROM deliveries)"""
_TOP = """SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY s DESC, key) AS rank, round(s, 6) AS score FROM found QUALIFY rank <= 10"""
_SCORED = f"scored AS (SELECT e.*, {DOT.format(a='e.vector', b='q.vector')} AS s FROM entries e, (SELECT vector FROM entries WHERE vec_id = 0) q)"
_C = "c AS (SELECT vec_id AS list, vector AS center FROM entries WHERE vec_id < 16)"


def _ivf(waiting: str) -> str:
    near = DOT.format(a="e.vector", b="c.center")
    pair = DOT.format(a="e.vector", b="q.vector")
    return f"""WITH {ENTRIES}, {_C},
      homes AS (SELECT e.vec_id, c.list, row_number() OVER (PARTITION BY e.vec_id ORDER BY {near} DESC, c.list) AS place FROM entries e, c),
      found AS (
        SELECT q.vec_id AS qid, e.key, {pair} AS s FROM entries e JOIN homes h ON h.vec_id = e.vec_id AND h.place = 1
        JOIN homes p ON p.list = h.list AND p.place <= 4 JOIN entries q ON q.vec_id = p.vec_id WHERE q.vec_id % 100 = 0 AND NOT ({waiting})
        UNION ALL SELECT q.vec_id, e.key, {pair} FROM entries e, entries q WHERE q.vec_id % 100 = 0 AND {waiting})
      {_TOP}"""


_RING = f"""points AS (SELECT {HASH60.format(x="id || '#' || i")} AS ring_hash, id AS node_id, i FROM (SELECT DISTINCT id FROM nodes) n, range(64) r(i)),
  ring AS (SELECT ring_hash, arg_min(node_id, node_id) AS node_id FROM points GROUP BY ring_hash)"""
_OWNERS = f"""{_RING}, slots AS (SELECT s::INTEGER AS slot_id, {HASH60.format(x="'slot:' || s")} AS h FROM range(4096) t(s)),
  gaps AS (SELECT slot_id, node_id, min((ring_hash - h + 1152921504606846976) % 1152921504606846976) AS gap FROM slots, ring GROUP BY ALL),
  placed AS (SELECT slot_id, node_id, row_number() OVER (PARTITION BY slot_id ORDER BY gap, node_id) AS place FROM gaps),
  owners AS (SELECT slot_id, max(CASE WHEN place = 1 THEN node_id END) AS primary_id, string_agg(node_id, ',' ORDER BY place) FILTER (place <= 2) AS replicas FROM placed GROUP BY slot_id)"""
_SLOT = f"({HASH60.format(x=chr(39).join(['collection || ', ':', ' || key']))} % 4096)::INTEGER"
_ROUTES = f"""{STATE}, {_OWNERS}, routes AS (SELECT r.*, o.slot_id, o.primary_id, o.replicas, n.host, n.port
  FROM (SELECT *, {_SLOT} AS slot FROM state) r JOIN owners o ON o.slot_id = r.slot JOIN nodes n ON n.id = o.primary_id)"""
_TASKS = f"""{_ROUTES}, tasks AS (SELECT *, {HASH60.format(x="key")} % 2 = 1 AS ok, ({HASH60.format(x="key")} % 5)::INTEGER AS tries FROM routes WHERE primary_id <> '{LOCAL}'),
  sent AS (SELECT collection, key, primary_id, CASE WHEN ok THEN tries ELSE tries + 1 END AS attempts,
    CASE WHEN ok THEN 'delete_pending' WHEN tries + 1 >= 5 THEN 'failed' ELSE 'pending' END AS state, CASE WHEN ok THEN {NOW + 300_000} ELSE 0 END AS delete_after_unix_ms FROM tasks)"""
_RANKED = "ranked AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)"

SQL = {
    "log_outcomes": f"""WITH {_log()} SELECT seq, CASE WHEN version < max(version) OVER (PARTITION BY collection, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      THEN 'stale' ELSE 'applied' END AS outcome FROM log""",
    "log_latest": f"WITH {_log()} SELECT collection, key, seq, version, mid AS mutation_id FROM log QUALIFY row_number() OVER (PARTITION BY collection, key ORDER BY version DESC, seq DESC) = 1",
    "log_with_deletes": f"WITH {_log(deletes=True)}, {_FOLDED}",
    "log_with_repeats": f"WITH {_log(repeats=True)}, {_FOLDED}",
    "log_replay": f"""WITH {STATE}, rows AS (SELECT collection, key, -1 AS seq, 'p' AS op FROM state UNION ALL
        SELECT coalesce(nullif(collection, ''), 'documents'), key, seq, substr(lower(trim(op)), 1, 1) FROM mutations WHERE key <> '' AND lower(trim(op)) IN ('p', 'put', 'd', 'delete')),
      last AS (SELECT collection, key, max(seq) AS seq, arg_max(op, seq) AS op FROM rows GROUP BY ALL) SELECT collection, key, seq FROM last WHERE op = 'p'""",
    "stamp_mutations": f"""WITH a AS (SELECT *, coalesce(nullif(updated_at_unix_ms, 0), {NOW}) AS u FROM deliveries)
      SELECT delivery_id, coalesce(nullif(version, 0), u) AS version, u AS updated_at_unix_ms, coalesce(nullif(mutation_id, ''), 'node-x:' || u || ':' || delivery_id) AS mutation_id FROM a""",
    "batch_duplicates": f"WITH {_BATCH} SELECT batch_id, collection, key, count(*) AS copies FROM batch GROUP BY ALL HAVING count(*) > 1",
    "batch_validate": f"""WITH {STATE}, {_BATCH}, j AS (SELECT b.*, b.mid <> '' AND b.mid = coalesce(s.mutation_id, '') AS same, coalesce(s.version, 0) AS sv
        FROM batch b LEFT JOIN state s ON s.collection = b.collection AND s.key = b.key),
      per AS (SELECT batch_id, count(*) AS records, bool_or(key = '') AS empty, count(*) > count(DISTINCT (collection, key)) AS repeated,
        bool_or(NOT same AND version <> 0 AND sv > version) AS stale FROM j GROUP BY batch_id)
      SELECT batch_id, records, CASE WHEN records > 150 THEN 'too_large' WHEN empty THEN 'empty_key' WHEN repeated THEN 'repeated_key' WHEN stale THEN 'stale' ELSE 'accepted' END AS outcome FROM per""",
    "apply_migrated": f"""WITH {STATE} SELECT collection, key, CASE WHEN version <> 0 THEN version WHEN updated_at_unix_ms <> 0 THEN updated_at_unix_ms ELSE {NOW} END AS version,
      array_to_string(list_sort(list_append(list_transform(map_entries(coalesce(metadata, MAP {{}})), lambda e: e.key || '=' || coalesce(e.value, '')), 'trace_id=trace-1')), ';') AS metadata FROM state""",
    "index_latest": """WITH last AS (SELECT collection, key, vector FROM index_entries QUALIFY row_number() OVER (PARTITION BY collection, key ORDER BY coalesce(version, 0) DESC) = 1)
      SELECT collection, key, len(vector)::BIGINT AS dimensions FROM last WHERE len(vector) > 0""",
    "vector_topk_exact": f"WITH {ENTRIES}, {_SCORED} SELECT key, round(s, 6) AS score FROM scored ORDER BY s DESC, key LIMIT 10",
    "vector_topk_filtered": f"WITH {ENTRIES}, {_SCORED} SELECT key, round(s, 6) AS score FROM scored WHERE label = 3 ORDER BY s DESC, key LIMIT 10",
    "vector_overfetch": f"WITH {ENTRIES}, {_SCORED}, best AS (SELECT * FROM scored ORDER BY s DESC, key LIMIT 40) SELECT key, round(s, 6) AS score FROM best WHERE label = 3 ORDER BY s DESC, key LIMIT 10",
    "vector_topk_batch": f"WITH {ENTRIES}, found AS (SELECT q.vec_id AS qid, e.key, {DOT.format(a='e.vector', b='q.vector')} AS s FROM entries e, entries q WHERE q.vec_id % 100 = 0) {_TOP}",
    "vector_dim_mismatch": f"WITH {ENTRIES}, {_SCORED} SELECT key, CASE WHEN label = 0 THEN -1 ELSE round(s, 6) END AS score FROM scored",
    "l2_normalize": f"""WITH {ENTRIES}, n AS (SELECT key, vector AS v, sqrt({DOT.format(a='vector', b='vector')}) AS norm FROM entries)
      SELECT key, round(v[1] / norm, 6) AS v0, round(v[32] / norm, 6) AS v31, round(v[64] / norm, 6) AS v63 FROM n""",
    "ivf_topk_fixed": _ivf("false"),
    "ivf_topk_buffered": _ivf("e.label = 0"),
    "slot_assign": f"WITH {STATE} SELECT collection, key, {_SLOT} AS slot_id FROM state",
    "ring_build": f"WITH {_RING} SELECT ring_hash, node_id FROM ring",
    "slot_owners": f"WITH {_OWNERS} SELECT slot_id, primary_id, replicas FROM owners",
    "route_records": f"WITH {_ROUTES} SELECT collection, key, slot_id, primary_id, host AS primary_host, port AS primary_port, replicas, primary_id = '{LOCAL}' AS local_owner FROM routes",
    "write_guard": f"WITH {_ROUTES} SELECT collection, key, CASE WHEN primary_id = '{LOCAL}' THEN 'ok' ELSE 'unavailable: owned by ' || primary_id || ' at ' || host || ':' || port END AS outcome FROM routes",
    "migration_plan": f"""WITH {_ROUTES} SELECT collection, key, primary_id AS target_id, host AS target_host, port AS target_port,
      (title <> '' OR collection = 'documents' OR list_has_any(map_keys(coalesce(metadata, MAP {{}})), ['image_path', 'image_reference', 'image_uri'])) AS semantic, 0 AS attempts, 'pending' AS state
      FROM routes WHERE primary_id <> '{LOCAL}'""",
    "migration_step": f"WITH {_TASKS} SELECT collection, key, attempts, state, delete_after_unix_ms FROM sent",
    "migration_status": f"WITH {_TASKS} SELECT state, count(*) AS tasks FROM sent GROUP BY state",
    "migration_due": f"WITH {_TASKS} SELECT collection, key, primary_id AS target_id FROM sent WHERE state = 'delete_pending'",
    "members_parse": "SELECT id, host, port, 100 AS weight FROM nodes",
    "registrations_parse": """SELECT id, host, port, true AS healthy, coalesce(nullif(weight, 0), 100) AS weight, coalesce(zone, '') AS zone FROM nodes
      UNION ALL SELECT 'old-' || id, host, port, true, 100, '' FROM nodes""",
    "request_metrics": """SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (value > 100) AS degraded,
      round(coalesce(avg(value), 0), 4) AS average_latency FROM events""",
    "latency_percentiles": f"""WITH {_RANKED}, p(percentile) AS (VALUES (50), (90), (95), (99))
      SELECT percentile, value AS latency FROM p JOIN ranked ON place = round_even(percentile / 100.0 * (n - 1), 0)""",
    "latency_percentiles_floor": f"""WITH {_RANKED}, p(percentile) AS (VALUES (50), (95), (99)) SELECT percentile, value AS latency FROM p JOIN ranked ON place = floor(percentile / 100.0 * (n - 1))""",
    "load_summary": """SELECT count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type <> 'error') / 30.0, 4) AS qps,
      round(count(*) FILTER (event_type <> 'error') * 100 / 30.0, 4) AS records_per_s, round(avg(value), 4) AS average, round(max(value), 4) AS largest FROM events""",
    "stack_fold": f"WITH {STATE} SELECT replace(key, '/', ';') AS stack, count(*) AS samples FROM state WHERE key <> '' GROUP BY ALL",
    "stack_rollup": f"""WITH {STATE}, f AS (SELECT string_split(replace(key, '/', ';'), ';') AS frames FROM state WHERE key <> ''),
      n AS (SELECT frames, unnest(range(0, len(frames) + 1)) AS depth FROM f)
      SELECT array_to_string(frames[1:depth], ';') AS prefix, depth, count(*) AS samples FROM n GROUP BY ALL""",
    "rate_limit_aligned": """WITH r AS (SELECT event_type AS stream, event_id, epoch_us(ts) // 1000 AS at_ms FROM events)
      SELECT stream, event_id, at_ms, row_number() OVER (PARTITION BY stream, at_ms // 1000 ORDER BY at_ms, event_id) <= 1 AS passed FROM r""",
}
SQL["stream_state"] = data_problems.SQL["p3_found"]
