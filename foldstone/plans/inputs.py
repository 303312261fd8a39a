"""The test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.model import collection_of, table, text_or_empty

#: The same in SQL, as common table expressions.
ENTRIES = "entries AS (SELECT vec_id, 'vectors' AS collection, 'vec-' || lpad(vec_id::VARCHAR, 8, '0') AS key, label, embedding AS vector FROM embeddings)"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
STATE = """state AS (SELECT DISTINCT coalesce(nullif(collection, ''), 'documents') AS collection, coalesce(key, '') AS key, coalesce(title, '') AS title,
  coalesce(body, '') AS body, metadata, coalesce(version, 0) AS version, coalesce(updated_at_unix_ms, 0) AS updated_at_unix_ms, coalesce(mutation_id, '') AS mutation_id FROM records)"""
LOG = """log AS (SELECT event_id AS seq, {op} AS op, {collection} AS collection, 'user-' || lpad(user_id::VARCHAR, 6, '0') AS key,
  event_id % 7 + 1 AS version, {mid} AS mid FROM events)"""
HASH60 = "('0x' || substr(md5({x}), 1, 15))::BIGINT"


def filled(rows: DataFrame) -> DataFrame:
    """Records without nulls but for metadata; other columns stay."""
    own = ["collection", "key", "title", "body", "metadata", "version", "updated_at_unix_ms", "mutation_id"]
    return rows.select(
        *[c for c in rows.columns if c not in own],
        collection_of().alias("collection"), *[text_or_empty(c).alias(c) for c in ("key", "title", "body")], "metadata",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("version", "updated_at_unix_ms")], text_or_empty("mutation_id").alias("mutation_id"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records, each once, without nulls but for metadata."""
    return filled(table(spark, sf_dir, "records")).dropDuplicates(["collection", "key"])


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    key = F.concat(F.lit("vec-"), F.lpad(F.col("vec_id").cast("string"), 8, "0"))
    return e.select("vec_id", F.lit("vectors").alias("collection"), key.alias("key"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as a query (qid, vector)."""
    return entries(spark, sf_dir).filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), "vector")


def first_vectors(spark: SparkSession, sf_dir: str, n: int) -> list[list[float]]:
    """The first vectors, as a query or as centroids."""
    return [list(r["vector"]) for r in entries(spark, sf_dir).filter(F.col("vec_id") < n).orderBy("vec_id").select("vector").collect()]


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return first_vectors(spark, sf_dir, 1)[0]


def event_log(spark: SparkSession, sf_dir: str, deletes: bool = False, repeats: bool = False) -> DataFrame:
    """Events as mutations: one key per user, in a collection per kind of event; errors are
    deletes of the collection ``events``, or three neighbours on a key share an id."""
    e = table(spark, sf_dir, "events")
    key = F.concat(F.lit("user-"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    mid = F.concat(F.lit("e-"), (F.expr("event_id div 3") if repeats else F.col("event_id")).cast("string"))
    return e.select(
        F.col("event_id").alias("seq"),
        (F.when(F.col("event_type") == "error", "D").otherwise("P") if deletes else F.lit("P")).alias("op"),
        (F.lit("events") if deletes else F.col("event_type")).alias("collection"),
        key.alias("key"), F.lit("").alias("title"), F.col("props").alias("body"), F.create_map().cast("map<string,string>").alias("metadata"),
        (F.col("event_id") % 7 + 1).alias("version"), F.lit(0).cast("bigint").alias("updated_at_unix_ms"), mid.alias("mutation_id"),
    )
