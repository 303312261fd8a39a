"""Snapshots, logs and deliveries as Parquet tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.model import MUTATION, RECORD, collection_of, text_or_empty


def write_snapshot(records: DataFrame, path: str) -> None:
    """The state as one folder per collection, sorted by key within its files (A3, A6),
    so that reads of a collection skip the others and key ranges skip row groups."""
    rows = records.withColumn("collection", collection_of()).withColumn("key", text_or_empty("key"))
    spread = rows.repartitionByRange("collection", "key").sortWithinPartitions("collection", "key")
    spread.write.mode("overwrite").partitionBy("collection").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    fields = [f for f in RECORD.fields if f.name != "collection"]
    schema = RECORD.__class__([*fields, RECORD["collection"]])
    return spark.read.schema(schema).parquet(path).select(RECORD.fieldNames())


def append_log(mutations: DataFrame, path: str) -> None:
    """A batch of mutations behind a log (A4); a log is never rewritten."""
    mutations.select(MUTATION.fieldNames()).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MUTATION).parquet(path)


def deliver(tasks: DataFrame, path: str) -> DataFrame:
    """Records of migration tasks, into one folder per target node, and how that went:
    ``collection, key, ok``, as ``routing.step_tasks`` takes it (A18). A write that fails leaves
    nothing behind and fails all of its tasks; for streams, to be called from ``foreachBatch``."""
    try:
        tasks.write.mode("append").partitionBy("target_id").parquet(path)
        ok = True
    except PySparkException:
        ok = False
    return tasks.select("collection", "key", F.lit(ok).alias("ok"))
