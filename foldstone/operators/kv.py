"""Reads over the record state (B1–B14) and its sets.

Records may occur several times unchanged; reads give each (collection, key) once.
Collection and key filters reach the scan of a table that is handed over as it is
stored, nulls and repeats included; no read gathers more than its limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.functions.text import matches_filters
from foldstone.model import DEFAULT_COLLECTION, collection_of, text_or_empty

MOST, USUAL = 1000, 100
IMAGE_KEYS = ("image_path", "image_reference", "image_uri")


def in_collection(collection: str | None, default: str = DEFAULT_COLLECTION) -> Column:
    """A filter on a collection that a file scan can take; absent ones are the default."""
    name = collection or default
    plain = F.col("collection") == name
    return plain | F.col("collection").isNull() | (F.col("collection") == "") if name == default else plain


def _once(df: DataFrame) -> DataFrame:
    return df.withColumn("collection", collection_of()).dropDuplicates(["collection", "key"])


def _first(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records of one collection by key. Keys alone are made distinct and
    sorted; the rest of a record is fetched for at most ``MOST`` of them."""
    keys = records.select(F.col("key").alias("first_key")).distinct().orderBy("first_key").limit(n)
    own = records.join(F.broadcast(keys), F.col("key") == F.col("first_key"), "left_semi")
    return _once(own).orderBy("key")


def get(records: DataFrame, collection: str | None, key: str) -> DataFrame:
    """The record of a key, no row if there is none; an empty key is an error (B1)."""
    if not key:
        raise ValueError("key must not be empty")
    return _once(records.filter(in_collection(collection) & (F.col("key") == key)))


def multi_get(records: DataFrame, references: DataFrame) -> DataFrame:
    """The records of ``references`` (ord, collection, key) in their order, column
    ``ord``; those that are missing are left out (B2, F1)."""
    wanted = references.select("ord", collection_of().alias("collection"), "key")
    found = records.withColumn("collection", collection_of()).join(wanted, ["collection", "key"])
    return found.dropDuplicates(["ord"]).orderBy("ord")


def clamp_limit(limit: int | None) -> int:
    return min(max(1, USUAL if limit is None else limit), MOST)


def range_scan(records: DataFrame, collection: str | None, begin: str = "", end: str = "", limit: int | None = None) -> DataFrame:
    """Records with ``begin <= key < end`` in key order; an empty end is none."""
    at = in_collection(collection)
    if begin:
        at = at & (F.col("key") >= begin)
    if end:
        at = at & (F.col("key") < end)
    return _first(records.filter(at & (F.col("key") != "")), clamp_limit(limit))


def prefix_scan(records: DataFrame, collection: str | None, prefix: str, limit: int | None = None) -> DataFrame:
    """Records whose key begins with ``prefix``, in key order (E18); the test is pushed to
    the scan as it stands, so no end of a range has to be made up."""
    own = records.filter(in_collection(collection) & F.col("key").startswith(prefix) & (F.col("key") != ""))
    return _first(own, clamp_limit(limit))


def page(records: DataFrame, collection: str | None, after: str = "", size: int = USUAL) -> DataFrame:
    """The page of records behind the key ``after``."""
    return range_scan(records, collection, after + "\0" if after else "", "", size)


def collections(records: DataFrame) -> DataFrame:
    """The names of all collections, sorted."""
    return records.select(collection_of().alias("collection")).distinct().orderBy("collection")


def exists(records: DataFrame) -> bool:
    """Whether there is any row; reads one at most."""
    return not records.limit(1).isEmpty()


def filter_metadata(records: DataFrame, filters: dict[str, str]) -> DataFrame:
    return records.filter(matches_filters(F.col("metadata"), filters))


def is_semantic(default: str = DEFAULT_COLLECTION) -> Column:
    """Whether a record belongs in the index: it has a title, is of the default
    collection, or has an image key, even an empty one (B14)."""
    keys = F.coalesce(F.map_keys("metadata"), F.array().cast("array<string>"))
    has_image = F.arrays_overlap(keys, F.array(*map(F.lit, IMAGE_KEYS)))
    return (text_or_empty("title") != "") | (collection_of() == default) | has_image


def absent_from(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose (collection, key) is not among ``others`` (F5, C9: entries without a record)."""
    keys = others.select(collection_of().alias("o_collection"), F.col("key").alias("o_key"))
    named = rows.withColumn("collection", collection_of())
    return named.join(keys, (F.col("collection") == F.col("o_collection")) & (F.col("key") == F.col("o_key")), "left_anti")
