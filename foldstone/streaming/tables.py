"""Streams over the mutation log.

State is keyed by (collection, key) and holds a version and an id, so it does not
grow with a key's history. Late and repeated changes are told by version and id, not
by a watermark, as the store does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldstone.functions.embed import Embedder
from foldstone.model import collection_of, number_or_zero, text_or_empty
from foldstone.operators.feed import operation
from foldstone.operators.search import embed_records

OUTCOME = "collection string, key string, seq bigint, op string, version bigint, mutation_id string, outcome string"
KEPT = "seq bigint, version bigint, mutation_id string, live boolean"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, version, mid, live = state.get if state.exists else (-1, 0, "", False)
    # a key's changes of one micro-batch; over batches they come in the log's order
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    said = []
    for seq, op, v, m in zip(rows["seq"], rows["op"], rows["version"], rows["mutation_id"]):
        if op == "D":
            at, version, mid, live, outcome = seq, 0, "", False, "deleted"
        elif live and (seq == at or m and m == mid):
            outcome = "duplicate"
        elif live and v and version and v < version:
            outcome = "stale"
        else:
            at, version, mid, live, outcome = seq, v, m, True, "applied"
        said.append(outcome)
    state.update((int(at), int(version), mid, bool(live)))
    yield pd.DataFrame({"collection": key[0], "key": key[1], "seq": rows["seq"], "op": rows["op"], "version": rows["version"], "mutation_id": rows["mutation_id"], "outcome": said})


def apply_changes(mutations: DataFrame) -> DataFrame:
    """A stream of mutations to one of outcomes: applied, stale, duplicate, deleted.

    Malformed changes are left out. ``mutations`` must be a stream; its changes must
    reach the query in the order of ``seq`` from batch to batch.
    """
    rows = mutations.select(
        collection_of().alias("collection"), F.col("key"), "seq", operation("op").alias("op"), number_or_zero("version").alias("version"), text_or_empty("mutation_id").alias("mutation_id")
    ).filter("key <> '' and op is not null and seq is not null")
    return rows.groupBy("collection", "key").applyInPandasWithState(_step, OUTCOME, KEPT, "append", GroupStateTimeout.NoTimeout)


def maintain_index(mutations: DataFrame, embedder: Embedder, path: str, checkpoint: str, retry: Callable[[DataFrame, Exception], None] | None = None) -> StreamingQuery:
    """Embeds the last change of each key of every batch and appends it to ``path``
    (S1): ``seq, op, collection, key, metadata, vector``, which ``vector.latest_vectors``
    reads. A batch is written at least once, under its own folder, so a batch that is
    run again replaces itself. Batches that fail go to ``retry`` if there is one."""

    def write(batch: DataFrame, number: int) -> None:
        try:
            fields = ["op", "title", "body", "metadata"]
            rows = batch.withColumn("collection", collection_of()).withColumn("op", operation("op")).filter("key <> '' and op is not null")
            last = rows.groupBy("collection", "key").agg(F.max_by(F.struct("seq", *fields), "seq").alias("r")).select("collection", "key", "r.*")
            puts = last.filter("op = 'P'")
            made = embed_records(puts, embedder).join(puts.select("collection", "key", "seq", "op"), ["collection", "key"])
            gone = last.filter("op = 'D'").select("collection", "key", "metadata", F.lit(None).cast("array<double>").alias("vector"), "seq", "op")
            made.select(gone.columns).unionByName(gone).write.mode("overwrite").parquet(f"{path}/batch={number}")
        except Exception as problem:
            if retry is None:
                raise
            retry(batch, problem)

    return mutations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PASSED = "stream string, event_id bigint, at_ms bigint, passed boolean"


def _limit(most: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "event_id"], kind="stable")
        out = []
        for at in rows["at_ms"]:
            if start < 0 or at - start >= 1000:
                start, used = at, 0
            used += 1
            out.append(used <= most)
        state.update((int(start), int(used)))
        yield pd.DataFrame({"stream": key[0], "event_id": rows["event_id"], "at_ms": rows["at_ms"], "passed": out})

    return run


def rate_limit(requests: DataFrame, most: int) -> DataFrame:
    """``stream, event_id, at_ms`` requests with ``passed``: the first ``most`` of each
    window pass, and a window starts at the first request a second or more after the
    start of the one before (S3). Works on streams; a stream's requests of one
    micro-batch are bounded by its trigger."""
    return requests.groupBy("stream").applyInPandasWithState(_limit(most), PASSED, "start bigint, used bigint", "append", GroupStateTimeout.NoTimeout)


def rate_limit_aligned(requests: DataFrame, most: int) -> DataFrame:
    """As ``rate_limit`` with windows that start on whole seconds; for batches."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream", F.expr("at_ms div 1000")).orderBy("at_ms", "event_id")
    return requests.withColumn("passed", F.row_number().over(w) <= most)


def _due(delay_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (sent,) = state.get
            state.remove()
            yield pd.DataFrame({"collection": [key[0]], "key": [key[1]], "sent_ms": [sent]})
            return
        sent = int(max(b["sent_ms"].max() for b in batches))
        state.update((sent,))
        state.setTimeoutTimestamp(max(sent + delay_ms, state.getCurrentWatermarkMs() + 1))

    return run


def delayed_deletes(sent: DataFrame, delay_ms: int = 300_000) -> DataFrame:
    """``collection, key, sent_ms`` of records sent to other nodes, once ``delay_ms`` of
    event time have passed (S4). ``sent`` has these columns and a timestamp ``at`` with a
    watermark."""
    return sent.groupBy("collection", "key").applyInPandasWithState(_due(delay_ms), "collection string, key string, sent_ms bigint", "sent_ms bigint", "append", GroupStateTimeout.EventTimeTimeout)
