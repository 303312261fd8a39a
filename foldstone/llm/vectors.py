"""Current, usable vectors of an index, shared by search and clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.model import collection_of, number_or_zero, text_or_empty

DIMENSIONS = 128


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has the right length, only finite components and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves out rows that a later version of the same key in their batch replaces."""
    for batch in batches:
        ids, version = batch["id"].to_numpy(), batch["version"].to_numpy()
        order = np.lexsort((version, ids))
        last = np.append(np.flatnonzero(np.diff(ids[order])), len(order) - 1) if len(order) else order
        if len(last) == len(order):
            yield batch
            continue
        newest = np.empty(len(order), np.int64)
        newest[order] = np.repeat(order[last], np.diff(last, prepend=-1))
        same = pc.and_(*[pc.equal(batch[c], batch[c].take(pa.array(newest))) for c in ("collection", "key")]).to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array((newest == np.arange(len(order))) | ~same))


def current(entries: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``id, collection, key, segment_id, vector`` of the entries in force.

    Of each (collection, key) the row with the highest version counts (rows that tie
    are equal); keys whose current vector is not usable have none. An absent
    collection stands for ``documents``, an absent key for "". ``id`` is a hash of
    both, by which the rows are partitioned; it is not taken to be unique.
    """
    key = text_or_empty("key")
    rows = entries.select(
        F.xxhash64(collection_of(), key).alias("id"),
        collection_of().alias("collection"),
        key.alias("key"),
        number_or_zero("segment_id").alias("segment_id"),
        F.col("vector").cast("array<float>").alias("vector"),
        number_or_zero("version").alias("version"),
    )
    # Combined by batch first, so that a key with very many versions does not fill a task.
    few = rows.mapInArrow(_newest, rows.schema).withColumn("row", F.struct("segment_id", "vector"))
    # One exchange, by id, serves this aggregate and the later lookups by id.
    last = few.repartition("id").groupBy("id", "collection", "key").agg(F.max_by("row", "version").alias("row"))
    return last.select("id", "collection", "key", "row.segment_id", "row.vector").filter(usable(F.col("vector"), dimensions))


def matrix(column: pa.Array | pa.ChunkedArray, dimensions: int = DIMENSIONS, kind: type = np.float32) -> np.ndarray:
    """An Arrow column of usable vectors as unit rows, without Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.array(flat, dtype=kind).reshape(-1, dimensions)
    scale = np.abs(rows).max(axis=1, keepdims=True)  # keeps squares in range
    rows /= np.where(scale > 0, scale, 1)
    rows /= np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))[:, None].astype(kind)
    return rows


def groups(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, positions) of each distinct value."""
    order = np.argsort(values, kind="stable")
    ends = np.flatnonzero(np.diff(values[order])) + 1
    return [(values[p[0]], p) for p in np.split(order, ends) if len(p)]
