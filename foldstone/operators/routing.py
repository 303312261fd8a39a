"""Slots, the hash ring and rebalancing.

The ring is configuration: nodes times virtual nodes, a few thousand numbers. It is
walked once per slot on the driver; records then meet their owner in an equi-join
with one row per slot.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from foldstone.functions.embed import hash60
from foldstone.model import NODE, RECORD, collection_of, text_or_empty
from foldstone.operators.kv import is_semantic

SLOTS, VIRTUAL = 4096, 64
#: The most slots whose owners are broadcast.
MAX_SLOTS = 1 << 20


def hash_text(s: str) -> int:
    return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)


def slot_of(collection: Column, key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(hash60(F.concat_ws(":", collection, key)), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class Ring:
    hashes: list[int]
    nodes: list[str]

    @classmethod
    def of(cls, node_ids: Iterable[str], virtual: int = VIRTUAL) -> Ring:
        """``virtual`` points per node; of equal points the first node's stays (R2)."""
        points: dict[int, str] = {}
        for node in node_ids:
            for i in range(virtual):
                points.setdefault(hash_text(f"{node}#{i}"), node)
        hashes = sorted(points)
        return cls(hashes, [points[h] for h in hashes])

    def owners(self, at: int, copies: int) -> list[str]:
        """The first ``copies`` distinct nodes from a hash on, clockwise."""
        out: list[str] = []
        n, i = len(self.hashes), bisect_left(self.hashes, at)
        for j in range(n):
            node = self.nodes[(i + j) % n]
            if node not in out:
                out.append(node)
                if len(out) == copies:
                    break
        return out


def node_ids(nodes: DataFrame) -> list[str]:
    """The members in order of their ids; weight, zone and health play no part."""
    return [r["id"] for r in nodes.select("id").filter("id <> ''").distinct().orderBy("id").collect()]


def ring_table(nodes: DataFrame, virtual: int = VIRTUAL) -> DataFrame:
    ring = Ring.of(node_ids(nodes), virtual)
    return nodes.sparkSession.createDataFrame(list(zip(ring.hashes, ring.nodes)), "ring_hash bigint, node_id string")


def slot_hash(slot: int) -> int:
    return hash_text(f"slot:{slot}")


def slot_owners(nodes: DataFrame, slots: int = SLOTS, virtual: int = VIRTUAL, copies: int = 1) -> DataFrame:
    """``slot_id, primary_id, replicas`` of every slot; no rows without nodes."""
    if slots > MAX_SLOTS:
        raise ValueError(f"more than {MAX_SLOTS} slots")
    ids = node_ids(nodes)
    ring, n = Ring.of(ids, virtual), min(max(1, copies), max(1, len(ids)))
    rows = []
    for s in range(slots if ids else 0):
        own = ring.owners(slot_hash(s), n)
        rows.append((s, own[0], own))
    return nodes.sparkSession.createDataFrame(rows, "slot_id int, primary_id string, replicas array<string>")


def route(records: DataFrame, nodes: DataFrame, local_id: str, slots: int = SLOTS, virtual: int = VIRTUAL, copies: int = 1) -> DataFrame:
    """``collection, key, slot_id, primary_id, replicas, local_owner`` and the primary's
    host and port (R1–R4); without nodes the owner is null."""
    owners = F.broadcast(slot_owners(nodes, slots, virtual, copies))  # one row per slot, at most MAX_SLOTS
    names = F.broadcast(nodes.select(F.col("id").alias("primary_id"), F.col("host").alias("primary_host"), F.col("port").alias("primary_port")).dropDuplicates(["primary_id"]))
    rows = records.select(collection_of().alias("collection"), text_or_empty("key").alias("key"))
    rows = rows.withColumn("slot_id", slot_of(F.col("collection"), F.col("key"), slots))
    out = rows.join(owners, "slot_id", "left").join(names, "primary_id", "left")
    return out.select("collection", "key", "slot_id", "primary_id", "primary_host", "primary_port", "replicas", F.coalesce(F.col("primary_id") == local_id, F.lit(False)).alias("local_owner"))


def moved_slots(before: DataFrame, after: DataFrame, slots: int = SLOTS, virtual: int = VIRTUAL) -> DataFrame:
    """``slot_id, from_id, to_id`` of the slots whose owner another membership changes."""
    old = slot_owners(before, slots, virtual).select("slot_id", F.col("primary_id").alias("from_id"))
    new = slot_owners(after, slots, virtual).select("slot_id", F.col("primary_id").alias("to_id"))
    return old.join(new, "slot_id").filter("from_id <> to_id")


def migration_plan(records: DataFrame, nodes: DataFrame, local_id: str, pending: DataFrame | None = None, slots: int = SLOTS, virtual: int = VIRTUAL, now_ms: int = 0) -> DataFrame:
    """Tasks for every record whose primary is another node, but for those that are
    pending or wait for their delayed delete (R5, F5)."""
    owners = F.broadcast(slot_owners(nodes, slots, virtual))
    names = F.broadcast(nodes.select(F.col("id").alias("target_id"), F.col("host").alias("target_host"), F.col("port").alias("target_port")).dropDuplicates(["target_id"]))
    rows = records.withColumn("semantic", is_semantic()).withColumn("collection", collection_of()).withColumn("key", text_or_empty("key"))
    rows = rows.withColumn("slot_id", slot_of(F.col("collection"), F.col("key"), slots)).join(owners.select("slot_id", F.col("primary_id").alias("target_id")), "slot_id")
    tasks = rows.filter(F.col("target_id") != local_id).join(names, "target_id").dropDuplicates(["collection", "key"])
    if pending is not None:
        tasks = tasks.join(pending.select("collection", "key"), ["collection", "key"], "left_anti")
    return tasks.withColumns({"attempts": F.lit(0), "state": F.lit("pending"), "migration_epoch": F.lit(now_ms).cast("bigint"), "delete_after_unix_ms": F.lit(0).cast("bigint")})


def step_tasks(tasks: DataFrame, results: DataFrame, now_ms: int, max_retries: int = 5, delete_delay_ms: int = 300_000) -> DataFrame:
    """Tasks after a round of sending (R6): sent ones wait for their delete, failed ones
    count an attempt and are ``failed`` at the last; tasks without a result stay."""
    got = results.select("collection", "key", "ok")
    t = tasks.join(got, ["collection", "key"], "left")
    pending = (F.col("state") == "pending") & F.col("ok").isNotNull()
    attempts = F.when(pending & ~F.col("ok"), F.col("attempts") + 1).otherwise(F.col("attempts"))
    state = F.when(pending & F.col("ok"), "delete_pending").when(pending & (F.col("attempts") + 1 >= max_retries), "failed").otherwise(F.col("state"))
    due = F.when(pending & F.col("ok"), F.lit(now_ms + delete_delay_ms)).otherwise(F.col("delete_after_unix_ms"))
    return t.withColumns({"attempts": attempts, "delete_after_unix_ms": due, "state": state}).drop("ok")


def due_deletes(tasks: DataFrame, routes: DataFrame, now_ms: int) -> DataFrame:
    """Tasks whose delete is due and whose record is still another node's."""
    remote = routes.filter("not local_owner").select("collection", "key")
    return tasks.filter((F.col("state") == "delete_pending") & (F.col("delete_after_unix_ms") <= now_ms)).join(remote, ["collection", "key"], "left_semi")


def apply_due_deletes(rows: DataFrame, due: DataFrame) -> DataFrame:
    """Records, or index entries, without those whose delayed delete is due."""
    gone = due.select(F.col("collection").alias("d_collection"), F.col("key").alias("d_key"))
    return rows.join(gone, (collection_of() == F.col("d_collection")) & (F.col("key") == F.col("d_key")), "left_anti")


def append_members(nodes: DataFrame, path: str, version: int) -> None:
    """A membership as another version of the table of nodes."""
    nodes.select(*NODE.fieldNames()).write.mode("append").parquet(f"{path}/version={version}")


def members_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The nodes of a version, or of the last."""
    table = spark.read.schema(StructType([*NODE.fields, StructField("version", LongType())])).parquet(path)
    at = version if version is not None else table.agg(F.max("version")).head()[0]
    return table.filter(F.col("version") == F.lit(at)).drop("version")


def replan(records: DataFrame, path: str, local_id: str, pending: DataFrame | None = None, **ring) -> DataFrame:
    """Tasks for the newest membership, none of which is pending already."""
    return migration_plan(records, members_at(records.sparkSession, path), local_id, pending, **ring)


TASK = StructType(
    [
        *RECORD.fields,
        *[StructField(f"target_{n}", t) for n, t in (("id", StringType()), ("host", StringType()), ("port", IntegerType()))],
        StructField("semantic", BooleanType()),
        StructField("attempts", LongType()),
        StructField("migration_epoch", LongType()),
        StructField("delete_after_unix_ms", LongType()),
    ]
)


def write_tasks(tasks: DataFrame, path: str) -> None:
    """Tasks as JSON, one a line."""
    tasks.select(TASK.fieldNames()).write.mode("overwrite").json(path)


def read_tasks(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Tasks from JSON lines or, ``array``, files with one array each (A12): those with a time
    for their delete wait for it, the others are pending; what is absent counts as 0 or ""."""
    rows = spark.read.schema(TASK).option("multiLine", array).json(path)
    zero = {f.name: False if f.dataType == BooleanType() else 0 if f.dataType in (LongType(), IntegerType()) else "" for f in TASK.fields if f.name != "metadata"}
    waits = F.when(F.col("delete_after_unix_ms") > 0, "delete_pending").otherwise("pending")
    return rows.fillna(zero).withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>"))).withColumn("state", waits)


def demo_records(spark: SparkSession, existing: DataFrame | None = None) -> DataFrame:
    """Three short records for an empty store; none if there is any record."""
    rows = [
        ("documents", "demo-1", "Routes and gateways", "How a gateway finds the node that owns a key.", {"domain": "gateway", "lang": "en"}, 1, 0, "demo:1"),
        ("documents", "demo-2", "Logs and snapshots", "A store is its log, folded from the last snapshot on.", {"domain": "storage", "lang": "en"}, 1, 0, "demo:2"),
        ("documents", "demo-3", "Vectors in lists", "An inverted file looks only at lists near the query.", {"domain": "search", "lang": "en"}, 1, 0, "demo:3"),
    ]
    if existing is not None and not existing.limit(1).isEmpty():
        rows = []
    return spark.createDataFrame(rows, RECORD)
