"""Writes as sets: stamping, batches, outcomes and quick folds.

``feed`` has the general fold. The folds here are for logs without deletes, with
versions given and ids not repeated, where one aggregate or window is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstone.model import collection_of, number_or_zero, text_or_empty

MAX_BATCH = 1000


def stamp(records: DataFrame, node: str, now_ms: int, counter: Column | None = None) -> DataFrame:
    """Missing stamps, versions and ids filled in (C5): ``now``, the stamp, and
    ``node:stamp:counter``. Without a counter column rows are numbered as they lie."""
    updated = F.when(number_or_zero("updated_at_unix_ms") == 0, F.lit(now_ms)).otherwise(F.col("updated_at_unix_ms"))
    n = F.monotonically_increasing_id() if counter is None else counter
    out = records.withColumn("updated_at_unix_ms", updated)
    out = out.withColumn("version", F.when(number_or_zero("version") == 0, F.col("updated_at_unix_ms")).otherwise(F.col("version")))
    made = F.concat_ws(":", F.lit(node), F.col("updated_at_unix_ms").cast("string"), n.cast("string"))
    return out.withColumn("mutation_id", F.when(text_or_empty("mutation_id") == "", made).otherwise(F.col("mutation_id")))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("collection", collection_of()).withColumn("key", text_or_empty("key"))


def repeated_keys(batches: DataFrame) -> DataFrame:
    """``batch_id, collection, key, copies`` of keys that a batch has more than once."""
    n = _keyed(batches).groupBy("batch_id", "collection", "key").agg(F.count("*").alias("copies"))
    return n.filter("copies > 1")


def validate_batches(batches: DataFrame, state: DataFrame, max_records: int = MAX_BATCH) -> DataFrame:
    """``batch_id, records, outcome`` of each batch against the same state.

    A batch is rejected whole: ``too_large``, ``empty_key``, ``repeated_key`` or
    ``stale``, in that order; else it is ``accepted``. Records that repeat the stored
    id are fine and change nothing.
    """
    rows = _keyed(batches).select("batch_id", "collection", "key", number_or_zero("version").alias("version"), text_or_empty("mutation_id").alias("mid"))
    stored = _keyed(state).select("collection", "key", number_or_zero("version").alias("s_version"), text_or_empty("mutation_id").alias("s_mid")).dropDuplicates(["collection", "key"])
    joined = rows.join(stored, ["collection", "key"], "left")
    same = (F.col("mid") != "") & (F.col("mid") == F.coalesce("s_mid", F.lit("")))
    stale = ~same & (F.col("version") != 0) & (F.coalesce("s_version", F.lit(0)) > F.col("version"))
    # one row per key of a batch first, so that the second aggregate stays small
    keys = joined.groupBy("batch_id", "collection", "key").agg(F.count("*").alias("n"), F.max(stale).alias("stale"))
    per = keys.groupBy("batch_id").agg(F.sum("n").alias("records"), F.max(F.col("key") == "").alias("empty"), (F.max("n") > 1).alias("repeated"), F.max("stale").alias("stale"))
    outcome = F.when(F.col("records") > max_records, "too_large").when(F.col("empty"), "empty_key").when(F.col("repeated"), "repeated_key").when(F.col("stale"), "stale").otherwise("accepted")
    return per.select("batch_id", "records", outcome.alias("outcome"))


def outcomes(mutations: DataFrame) -> DataFrame:
    """``seq, outcome`` (applied or stale) for logs without deletes, zero versions and
    repeated ids: a put is stale if an earlier one of its key had a higher version."""
    before = Window.partitionBy("collection", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("version").over(before)
    return _keyed(mutations).select("seq", F.when(F.col("version") < best, "stale").otherwise("applied").alias("outcome"))


def latest(mutations: DataFrame) -> DataFrame:
    """The state such a log leaves: per key the last of the highest version.
    One aggregate with map-side combine."""
    fields = [c for c in mutations.columns if c not in ("collection", "key", "op")]
    rows = _keyed(mutations).groupBy("collection", "key").agg(F.max_by(F.struct(*fields), F.struct("version", "seq")).alias("r"))
    return rows.select("collection", "key", *[F.col(f"r.{c}").alias(c) for c in fields])


def replay(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """``collection, key, seq`` after a snapshot and the log behind it, taken as they
    are: checks were made when the log was written (A1, A2, I1). The last entry of a
    key decides; deletes take it away. Snapshot rows have seq -1."""
    base = _keyed(snapshot).select("collection", "key", F.lit(-1).cast("bigint").alias("seq"), F.lit("P").alias("op"))
    rows = base.unionByName(_keyed(log).select("collection", "key", "seq", "op"))
    last = rows.groupBy("collection", "key").agg(F.max(F.struct("seq", "op")).alias("r"))
    return last.filter("r.op = 'P'").select("collection", "key", "r.seq")


def migrated(records: DataFrame, trace_id: str, node: str, now_ms: int) -> DataFrame:
    """Records as another node sent them: stamped, with the trace in their metadata.
    A trace id they already carry is replaced."""
    out = stamp(records, node, now_ms)
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "trace_id")
    return out.withColumn("metadata", F.map_concat(own, F.create_map(F.lit("trace_id"), F.lit(trace_id))))


def write_guard(routes: DataFrame, local_id: str, started: bool = True, read_only: bool = False) -> DataFrame:
    """``routes`` with ``outcome``: why a write would be refused here, with the owner's
    endpoint, or ``ok`` (C12, R4)."""
    if not started:
        why = F.lit("unavailable: not started")
    elif read_only:
        why = F.lit("unavailable: read-only")
    else:
        remote = F.concat(F.lit("unavailable: owned by "), F.col("primary_id"), F.lit(" at "), F.col("primary_host"), F.lit(":"), F.col("primary_port").cast("string"))
        why = F.when(F.col("primary_id") == local_id, "ok").otherwise(F.coalesce(remote, F.lit("unavailable: no owner")))
    return routes.withColumn("outcome", why)


def feed_fields() -> dict[str, str]:
    """The record's fields and their types, as a log holds them."""
    from foldstone.model import RECORD

    return {f.name: f.dataType.simpleString() for f in RECORD.fields}
