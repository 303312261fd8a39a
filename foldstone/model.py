"""The record model: schemas, table access and the meaning of "absent"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_COLLECTION = "documents"

RECORD = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("version", T.LongType()),
        T.StructField("updated_at_unix_ms", T.LongType()),
        T.StructField("mutation_id", T.StringType()),
    ]
)
MUTATION = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), *RECORD.fields])
ENTRY = T.StructType([*RECORD.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
NODE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("healthy", T.BooleanType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("zone", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: Column | str) -> Column:
    """Null and "" both mean absent; the model holds no nulls."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def number_or_zero(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("long"), F.lit(0).cast("long"))


def collection_of(c: Column | str = "collection", default: str = DEFAULT_COLLECTION) -> Column:
    """The collection, with the default in place of an absent one."""
    value = text_or_empty(c)
    return F.when(value == "", F.lit(default)).otherwise(value)
