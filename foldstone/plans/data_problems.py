"""Registry queries of the general data problems (1 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.model import table
from foldstone.operators import dedup, feed
from foldstone.runtime import scratch


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate_by_stamp(table(spark, sf_dir, "deliveries"))


def p1_seen_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers each producer has used, as disjoint ranges."""
    return dedup.deduplicate(table(spark, sf_dir, "deliveries")).seen.ranges.select("producer", "lo", "hi")


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.keep_one(table(spark, sf_dir, "deliveries"))
    return kept.select("delivery_id", "batch_id", "node_id", "key", "version", "updated_at_unix_ms", "mutation_id")


def p1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats a message of its own or of an earlier batch, in four batches."""
    deliveries, store = table(spark, sf_dir, "deliveries"), dedup.SeenStore(spark, scratch(spark, "seen"))
    out = None
    for i in range(4):
        found = store.take(deliveries.filter(F.col("batch_id") % 4 == i))
        out = found if out is None else out.unionByName(found)
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.current_state(feed.through_files(table(spark, sf_dir, "mutations"))).select("collection", "key", "seq")


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a feed that was appended to in three batches, out of order."""
    mutations, path = table(spark, sf_dir, "mutations"), scratch(spark, "feed")
    part = F.pmod(F.xxhash64("key", "seq"), F.lit(3))
    for i in range(3):
        feed.append_feed(mutations.filter(part == i), path)
    return feed.current_state(feed.read_feed(spark, path))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.rebuild(table(spark, sf_dir, "mutations")).select(
        "collection", "key", "seq", "title", "body", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("mutation_id", F.lit("")).alias("mutation_id")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_batches, p1_seen_ranges, p3_found, p3_files, p3_records)}

COPIES = """
  SELECT *, row_number() OVER (
    PARTITION BY coalesce(nullif(collection, ''), 'documents'), coalesce(key, ''), mutation_id
    ORDER BY coalesce(nullif(updated_at_unix_ms, 0), 9223372036854775807), delivery_id) AS copy
  FROM deliveries WHERE mutation_id <> ''
"""

FOLD = """
  WITH puts AS (
    SELECT DISTINCT coalesce(nullif(collection, ''), 'documents') AS collection, key, seq,
           substr(lower(trim(op)), 1, 1) AS op, coalesce(version, 0) AS version, coalesce(mutation_id, '') AS mid
    FROM mutations
    WHERE key <> '' AND lower(trim(op)) IN ('p', 'put', 'd', 'delete') AND seq IS NOT NULL),
  folded AS (
    SELECT collection, key, list_reduce(
      list({'seq': seq, 'op': op, 'version': version, 'mid': mid} ORDER BY seq),
      lambda s, c: CASE
        WHEN c.op = 'd' THEN {'seq': c.seq, 'op': 'd', 'version': 0::BIGINT, 'mid': ''}
        WHEN s.op = 'p' AND c.mid <> '' AND c.mid = s.mid THEN s
        WHEN s.op = 'p' AND c.version <> 0 AND s.version <> 0 AND c.version < s.version THEN s
        ELSE c END,
      {'seq': -1::BIGINT, 'op': 'd', 'version': 0::BIGINT, 'mid': ''}) AS s
    FROM puts GROUP BY collection, key)
"""

SQL = {
    "p1_found": f"SELECT delivery_id FROM ({COPIES}) WHERE copy > 1",
    "p1_kept": f"""
      SELECT delivery_id, batch_id, node_id, key, version, updated_at_unix_ms, mutation_id FROM deliveries
      WHERE delivery_id NOT IN (SELECT delivery_id FROM ({COPIES}) WHERE copy > 1)""",
    "p1_seen_ranges": """
      WITH parsed AS (
        SELECT DISTINCT
          CASE WHEN regexp_full_match(mutation_id, '.+:[0-9]+:(0|[1-9][0-9]{0,17})') THEN regexp_extract(mutation_id, '^(.+):[0-9]+:(0|[1-9][0-9]{0,17})$', 1) || ':'
               ELSE regexp_extract(mutation_id, '^([A-Za-z]+-)(0|[1-9][0-9]{0,17})$', 1) END AS producer,
          regexp_extract(mutation_id, '([0-9]+)$', 1) AS digits
        FROM deliveries
        WHERE regexp_full_match(mutation_id, '.+:[0-9]+:(0|[1-9][0-9]{0,17})|[A-Za-z]+-(0|[1-9][0-9]{0,17})')),
      numbers AS (SELECT producer, digits::BIGINT AS n FROM parsed),
      islands AS (SELECT producer, n, n - row_number() OVER (PARTITION BY producer ORDER BY n) AS island FROM numbers)
      SELECT producer, min(n) AS lo, max(n) AS hi FROM islands GROUP BY producer, island""",
    "p1_batches": """WITH named AS (SELECT *, coalesce(nullif(collection, ''), 'documents') AS c, coalesce(key, '') AS k FROM deliveries WHERE mutation_id <> ''),
      copies AS (SELECT delivery_id, row_number() OVER (PARTITION BY c, k, mutation_id ORDER BY batch_id % 4, coalesce(nullif(updated_at_unix_ms, 0), 9223372036854775807), delivery_id) AS copy FROM named)
      SELECT delivery_id FROM copies WHERE copy > 1""",
    "p3_files": f"{FOLD} SELECT collection, key, s.seq AS seq, s.version AS version, s.mid AS mutation_id FROM folded WHERE s.op = 'p'",
    "p3_found": f"{FOLD} SELECT collection, key, s.seq AS seq FROM folded WHERE s.op = 'p'",
    "p3_records": f"""{FOLD}, live AS (SELECT collection, key, s.seq AS seq FROM folded WHERE s.op = 'p')
      SELECT DISTINCT l.collection, l.key, l.seq, m.title, m.body, coalesce(m.version, 0) AS version, coalesce(m.mutation_id, '') AS mutation_id
      FROM live l JOIN mutations m ON m.seq = l.seq AND m.key = l.key AND coalesce(nullif(m.collection, ''), 'documents') = l.collection""",
}
