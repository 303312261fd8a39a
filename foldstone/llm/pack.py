"""Filling fixed-capacity containers with texts (problem 6).

Hierarchical residual packing. Each task packs the items of its partition by best
fit, largest first. Containers that are nearly full are closed; the others go on to
the next round as items of their own, in fewer partitions, and are packed again.
After the last round every container is closed. A text that exceeds the capacity is
cut into full containers and a remainder; no other text is ever split.

Scale: texts are tokenized once and only sizes go on, cut off by a checkpoint. A
task packs at most ``BLOCK`` items at a time, whatever the size of its partition,
and fewer than one container in ``FANIN`` is expected to go on to a next round.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm import tokens
from foldstone.runtime import cut

CAPACITY = 4_096
#: Containers filled to this share are closed in any round.
FULL = 0.995
ROUNDS, FANIN, BLOCK = 4, 8, 50_000

_BINS = "fill bigint, closed boolean, items array<struct<doc_id:bigint,part:bigint,token_start:bigint,n_tokens:bigint>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` by container: largest first, each into the fullest
    container with room. Ties go to the smallest index."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room: list[int] = []  # distinct rooms of the open containers, sorted
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i in order:
        need = sizes[i]
        at = bisect_left(room, need)
        if at == len(room):
            b, left = len(bins), capacity
            bins.append([])
        else:
            left = room[at]
            b = by_room[left].pop()
            if not by_room[left]:
                del by_room[left]
                room.pop(at)
        bins[b].append(i)
        left -= need
        if left > 0:
            if left not in by_room:
                by_room[left] = []
                insort(room, left)
            by_room[left].append(b)
    return bins


def _round(capacity: int, full: float, last: bool):
    threshold = capacity if last else int(np.ceil(capacity * full))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fills: list[int] = []
        contents: list = []

        def flush() -> pd.DataFrame:
            bins = best_fit(fills, capacity)
            fill = [sum(fills[i] for i in b) for b in bins]
            out = pd.DataFrame({"fill": fill, "closed": [last or f >= threshold for f in fill], "items": [[x for i in b for x in contents[i]] for b in bins]})
            fills.clear()
            contents.clear()
            return out

        for batch in batches:
            done = batch["closed"].to_numpy(dtype=bool)
            if done.any():
                yield batch[done]
            for fill, items in zip(batch["fill"][~done].tolist(), batch["items"][~done]):
                fills.append(fill)
                contents.append(list(items))
                if len(fills) >= BLOCK:
                    yield flush()
        if fills:
            yield flush()

    return pack


def items_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, n_tokens) to items of at most the capacity, as containers of one."""
    rest = F.col("n_tokens") % capacity
    parts = F.expr(f"greatest(1, (n_tokens + {capacity - 1}) div {capacity})")
    item = sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    size = F.when(F.col("part") < parts - 1, capacity).when((rest == 0) & (F.col("n_tokens") > 0), capacity).otherwise(rest)
    item = item.select("doc_id", "part", (F.col("part") * capacity).alias("token_start"), size.cast("bigint").alias("n"))
    return item.select(
        F.col("n").alias("fill"),
        (F.col("n") >= capacity).alias("closed"),
        F.array(F.struct("doc_id", "part", "token_start", F.col("n").alias("n_tokens"))).alias("items"),
    )


def pack(sizes: DataFrame, capacity: int = CAPACITY, full: float = FULL, rounds: int = ROUNDS, fanin: int = FANIN) -> DataFrame:
    """``container, doc_id, part, token_start, n_tokens`` of every item.

    ``sizes`` has ``doc_id`` and ``n_tokens``; null or negative sizes count as 0. An
    item without tokens takes no room but has its place in a container. Repeated
    rows are separate items. An empty table gives no containers.
    """
    clean = sizes.select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens"))
    bins = items_of(clean, capacity)
    width = None
    for r in range(rounds):
        last = r == rounds - 1
        if width is not None:
            # only what is still open moves; closed containers stay where they are
            width = max(1, width // fanin)
            moved = bins.filter("not closed").select("fill", "closed", "items").repartition(width)
            bins = bins.filter("closed").unionByName(moved.mapInPandas(_round(capacity, full, last), _BINS))
        else:
            bins = bins.mapInPandas(_round(capacity, full, last), _BINS)
        bins = cut(bins)
        width = width or bins.rdd.getNumPartitions()
    # numbered before the items are taken apart, or each would get a number of its own
    numbered = bins.select(F.monotonically_increasing_id().alias("container"), "items")
    return numbered.select("container", F.inline("items"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``pack`` over the token counts of ``documents`` (doc_id, text)."""
    sizes = documents.select("doc_id", tokens.n_tokens("text", vocabulary).alias("n_tokens"))
    return pack(sizes, capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, share of the room in use."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    return per.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"),
        (F.sum("fill") / (F.count("*") * capacity)).alias("used"),
        F.max("fill").alias("fullest"),
    )


def faults(sizes: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``kind, id`` of containers that are too full and of texts that were lost, changed in
    size or split without need: none."""
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill")).filter(F.col("fill") > capacity)
    want = sizes.select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / capacity))).alias("parts"))
    have = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("in_parts"))
    wrong = want.join(have, "doc_id", "full").filter("not (n <=> held and parts <=> in_parts)")
    return full.select(F.lit("container").alias("kind"), F.col("container").alias("id")).unionByName(wrong.select(F.lit("text").alias("kind"), F.col("doc_id").alias("id")))
