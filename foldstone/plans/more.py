"""Registry queries: snapshots, prefixes, membership changes, statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldstone.functions import service
from foldstone.model import table
from foldstone.operators import feed, kv, routing, state
from foldstone.plans.inputs import STATE, filled, records
from foldstone.plans.writes import SQL as WRITES
from foldstone.runtime import scratch
from foldstone.sources import snapshots

PLAIN = ["collection", "key", "title", "version", "mutation_id"]


def kv_prefix(spark, d):
    return filled(kv.prefix_scan(table(spark, d, "records"), "documents", "doc-", 100)).select(*PLAIN)


def snapshot_round_trip(spark, d):
    path = scratch(spark, "snapshot")
    snapshots.write_snapshot(records(spark, d), path)
    return snapshots.read_snapshot(spark, path).select(*PLAIN)


def snapshot_and_log(spark, d):
    """The state after a stored snapshot and a log appended to in two batches."""
    snapshot, path = scratch(spark, "snapshot"), scratch(spark, "log")
    snapshots.write_snapshot(records(spark, d), snapshot)
    log = table(spark, d, "mutations").withColumn("op", feed.operation("op")).filter("op is not null and key <> ''")
    late = F.col("updated_at_unix_ms") % 2 == 0
    snapshots.append_log(log.filter(F.coalesce(late, F.lit(False))), path)
    snapshots.append_log(log.filter(~F.coalesce(late, F.lit(False))), path)
    return state.replay(snapshots.read_snapshot(spark, snapshot), snapshots.read_log(spark, path))


def slots_moved(spark, d):
    nodes = table(spark, d, "nodes")
    return routing.moved_slots(nodes.filter("id <> 'node-d'"), nodes)


def status_codes(spark, d):
    kinds = F.create_map(*[F.lit(x) for k, v in {"error": "unavailable", "view": "ok", "signup": "invalid_argument", "purchase": "not_found"}.items() for x in (k, v)])
    e = table(spark, d, "events").select("event_id", kinds[F.col("event_type")].alias("status"))
    return e.select("event_id", "status", service.http_status(F.col("status")).alias("code"))


QUERIES = {f.__name__: f for f in (kv_prefix, snapshot_round_trip, snapshot_and_log, slots_moved, status_codes)}

_P = ", ".join(PLAIN)
_OWN = WRITES["slot_owners"].replace("SELECT slot_id, primary_id, replicas FROM owners", "SELECT slot_id, primary_id FROM owners")

SQL = {
    "kv_prefix": f"WITH {STATE} SELECT {_P} FROM state WHERE collection = 'documents' AND starts_with(key, 'doc-') ORDER BY key LIMIT 100",
    "snapshot_round_trip": f"WITH {STATE} SELECT {_P} FROM state",
    "snapshot_and_log": WRITES["log_replay"],
    "slots_moved": f"""SELECT b.slot_id::BIGINT AS slot_id, b.primary_id AS from_id, a.primary_id AS to_id
      FROM ({_OWN.replace("FROM nodes)", "FROM nodes WHERE id <> 'node-d')")}) b JOIN ({_OWN}) a ON a.slot_id = b.slot_id WHERE a.primary_id <> b.primary_id""",
    "status_codes": """SELECT event_id, status, CASE status WHEN 'ok' THEN 200 WHEN 'invalid_argument' THEN 400 WHEN 'not_found' THEN 404 WHEN 'unavailable' THEN 503 ELSE 500 END::BIGINT AS code FROM (
      SELECT event_id, CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'view' THEN 'ok' WHEN 'signup' THEN 'invalid_argument' WHEN 'purchase' THEN 'not_found' END AS status FROM events)""",
}
