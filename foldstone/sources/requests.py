"""Requests and answers as JSON columns (A12–A15), and nodes as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.functions.text import filter_parameters, limit_of, query_parameters


def _string(v: Column, path: str) -> Column:
    """A member if it is a string, else null: other types are ignored."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def _integer(v: Column, path: str) -> Column:
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def _strings(v: Column, path: str) -> Column:
    """The string members of an object; members of other types are dropped."""
    members = F.try_variant_get(v, path, "map<string,variant>")
    texts = F.transform_values(F.map_filter(members, lambda k, x: F.schema_of_variant(x) == "STRING"), lambda k, x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(texts, F.create_map().cast("map<string,string>"))


def record_of(json: Column) -> Column:
    """A document request as a record (A13): ``value`` stands in for ``body``, members
    of the wrong type count as absent; null if it is no JSON object."""
    v = F.try_parse_json(json)
    blank = F.lit("")
    version = _integer(v, "$.version")
    out = F.struct(
        F.coalesce(_string(v, "$.collection"), blank).alias("collection"),
        F.coalesce(_string(v, "$.key"), blank).alias("key"),
        F.coalesce(_string(v, "$.title"), blank).alias("title"),
        F.coalesce(_string(v, "$.body"), _string(v, "$.value"), blank).alias("body"),
        _strings(v, "$.metadata").alias("metadata"),
        F.when(version >= 0, version).otherwise(F.lit(0)).cast("bigint").alias("version"),
        F.coalesce(_integer(v, "$.updated_at_unix_ms"), F.lit(0)).cast("bigint").alias("updated_at_unix_ms"),
        F.coalesce(_string(v, "$.mutation_id"), blank).alias("mutation_id"),
    )
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), out)


def search_of(json: Column) -> Column:
    """A search request (A13): ``image_path`` goes before ``image_reference``."""
    v = F.try_parse_json(json)
    blank = F.lit("")
    out = F.struct(
        F.coalesce(_string(v, "$.query"), blank).alias("query"),
        F.coalesce(_string(v, "$.image_path"), _string(v, "$.image_reference"), blank).alias("image_reference"),
        F.coalesce(_string(v, "$.collection"), blank).alias("collection"),
        F.coalesce(_integer(v, "$.top_k"), F.lit(0)).cast("int").alias("top_k"),
        _strings(v, "$.filters").alias("filters"),
    )
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), out)


def batch_of(requests: DataFrame, json: str) -> DataFrame:
    """``requests`` with ``ord`` and ``record`` per member of the array ``records``; requests
    without such an array, or with members that are no objects, give no rows."""
    v = F.try_parse_json(json)
    items = F.try_variant_get(v, "$.records", "array<variant>")
    fine = F.forall(items, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    rows = requests.withColumn("items", items).filter(fine)
    out = rows.select(*requests.columns, F.posexplode("items").alias("ord", "item"))
    return out.withColumn("record", record_of(F.to_json("item"))).drop("item")


def render_record() -> Column:
    """A record as JSON, its body also as ``value``."""
    return F.to_json(F.struct("collection", "key", "title", "body", F.col("body").alias("value"), "metadata", "version", "updated_at_unix_ms", "mutation_id"))


def render_hits(hits: DataFrame) -> DataFrame:
    """``qid, answer``: each query's hits in order of rank, at most 50."""
    hit = F.struct("rank", "key", "title", "snippet", "score", "metadata")
    per = hits.groupBy("qid").agg(F.array_sort(F.collect_list(hit), lambda a, b: a["rank"] - b["rank"]).alias("hits"), F.any_value("degraded").alias("degraded"))
    return per.select("qid", F.to_json(F.struct("degraded", F.transform("hits", lambda h: h.dropFields("rank")).alias("hits"))).alias("answer"))


def render_route() -> Column:
    """A row of ``routing.route`` as JSON."""
    primary = F.struct(F.col("primary_id").alias("id"), F.col("primary_host").alias("host"), F.col("primary_port").alias("port"))
    return F.to_json(F.struct("collection", "key", "slot_id", "local_owner", primary.alias("primary"), "replicas"))


def render_health(metrics: DataFrame, healthy: Column) -> DataFrame:
    """``answer``: a row of request metrics as JSON with a status."""
    status = F.when(healthy, "ok").otherwise("unavailable")
    return metrics.select(F.to_json(F.struct(status.alias("status"), *metrics.columns)).alias("answer"))


def range_request(query_string: Column) -> Column:
    """Collection, bounds, limit and filters of a range request's query string."""
    p = query_parameters(query_string)
    get = lambda name: F.coalesce(p[name], F.lit(""))
    return F.struct(get("collection").alias("collection"), get("begin").alias("begin"), get("end").alias("end"), limit_of(get("limit")).alias("limit"), filter_parameters(p).alias("filters"))


def parse_members(spark: SparkSession, text: str) -> DataFrame:
    """Nodes of a list ``id@host:port,…``; broken entries are left out."""
    rows = spark.createDataFrame([(text,)], "t string").select(F.posexplode(F.split("t", ",")).alias("at", "entry"))
    part = lambda i: F.regexp_extract(F.trim("entry"), r"^([^@]+)@(.+):([0-9]{1,5})$", i)
    port = F.nullif(part(3), F.lit("")).cast("int")
    return rows.select(part(1).alias("id"), part(2).alias("host"), port.alias("port"), F.lit(True).alias("healthy"), F.lit(100).alias("weight"), F.lit("").alias("zone")).filter("id <> '' and port between 1 and 65535")


def parse_registrations(registrations: DataFrame) -> DataFrame:
    """``id, value`` as nodes register them, JSON or ``host:port``, to nodes; those
    without host or valid port are left out, a weight of 0 is 100 (A21)."""
    value = F.trim(F.col("value"), F.lit(" \t\r\n"))
    v = F.when(F.startswith(value, F.lit("{")), F.try_parse_json(value))
    legacy = lambda i: F.regexp_extract(value, r"^(?!\{)(.+):([0-9]+)$", i)
    is_json = F.startswith(value, F.lit("{"))
    weight = F.coalesce(_integer(v, "$.weight"), F.lit(100))
    rows = registrations.select(
        F.when(is_json, F.coalesce(F.nullif(_string(v, "$.id"), F.lit("")), F.col("id"))).otherwise(F.col("id")).alias("id"),
        F.when(is_json, _string(v, "$.host")).otherwise(legacy(1)).alias("host"),
        F.when(is_json, _integer(v, "$.port")).otherwise(F.nullif(legacy(2), F.lit("")).try_cast("bigint")).alias("port"),
        F.lit(True).alias("healthy"),
        F.when(weight == 0, 100).otherwise(weight).cast("int").alias("weight"),
        F.coalesce(_string(v, "$.zone"), F.lit("")).alias("zone"),
    )
    return rows.filter("host <> '' and port between 1 and 65535").withColumn("port", F.col("port").cast("int"))
