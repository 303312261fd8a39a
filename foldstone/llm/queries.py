"""Registry queries of the problems tagged llm, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.llm import abuse, ann, cluster, mix, pack, split, tokens
from foldstone.model import collection_of, table, text_or_empty
from foldstone.runtime import cut


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "index_entries")).withColumns({"similarity": F.round("similarity", 6), "rank": F.col("rank").cast("bigint")})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.similar_pairs(ann.nearest(table(spark, sf_dir, "index_entries")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.neighbours_in_order(cluster.clusters(table(spark, sf_dir, "index_entries")))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.describe(cluster.clusters(table(spark, sf_dir, "index_entries")))


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.clusters(table(spark, sf_dir, "index_entries"))


def p4_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and clusters that break a condition of the division: none."""
    entries = table(spark, sf_dir, "index_entries")
    return cluster.faults(entries, cluster.clusters(entries))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "records").select(collection_of().alias("collection"), text_or_empty("key").alias("key"), "body")
    return split.cut_points(records, ["collection", "key"], "body")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "records").select(collection_of().alias("collection"), text_or_empty("key").alias("key"), "body")
    return split.pieces(records, ["collection", "key"], "body").distinct()


def p5_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the tree of headings, lists and blocks; paths as text."""
    records = table(spark, sf_dir, "records").select(collection_of().alias("collection"), text_or_empty("key").alias("key"), "body")
    pieces = split.outline(records.distinct(), ["collection", "key"], "body")
    return pieces.withColumn("path", F.array_join("path", " > "))


def p5_outline_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose pieces are too long, leave something out or overlap wrongly: none."""
    records = table(spark, sf_dir, "records").select(collection_of().alias("collection"), text_or_empty("key").alias("key"), "body").distinct()
    pieces = p5_outline(spark, sf_dir).select("collection", "key", "piece", "start", "cut_at", F.md5("content").alias("digest"), F.length("content").alias("size"))
    per = pieces.groupBy("collection", "key").agg(F.sort_array(F.collect_list(F.struct("piece", "start", "cut_at", "digest", "size"))).alias("p"))  # pieces of one text
    both = records.filter("length(body) > 0").join(per, ["collection", "key"], "left")
    fits = F.forall("p", lambda x: (x["size"] <= split.LIMIT) & (x["size"] == x["cut_at"] - x["start"]) & (F.md5(F.substring(F.col("body"), (x["start"] + 1).cast("int"), x["size"])) == x["digest"]))
    follow = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i)["start"] == F.greatest(F.get("p", i - 1)["cut_at"] - split.OVERLAP, F.lit(0)))
    whole = (F.get("p", F.lit(0))["start"] == 0) & (F.element_at("p", -1)["cut_at"] == F.length("body")) & ((F.size("p") == 1) | follow)
    return both.filter(~F.coalesce(fits & whole, F.lit(False))).select("collection", "key")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.fill_report(p6_pack(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and texts that break a condition of the packing: none."""
    sizes = cut(table(spark, sf_dir, "documents").select("doc_id", tokens.n_tokens("text").alias("n_tokens")))
    return pack.faults(sizes, pack.pack(sizes))


def p7_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix as large as all documents together, which small sources can't fill."""
    counted = mix.count_documents(table(spark, sf_dir, "documents"))
    total = counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).head()[0]
    return mix.reached(counted, table(spark, sf_dir, "mix_targets"), total_tokens=total)


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of both mixes that come out more often than they may: none."""
    counted, targets = mix.count_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")
    total = counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).head()[0]
    return mix.faults(counted, targets).unionByName(mix.faults(counted, targets, total_tokens=total))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abusive(p8_scores(spark, sf_dir)).select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, sf_dir))


QUERIES = {
    "p2_found": p2_found,
    "p2_nearest": p2_nearest,
    "p4_found": p4_found,
    "p4_clusters": p4_clusters,
    "p4_members": p4_members,
    "p4_faults": p4_faults,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_outline": p5_outline,
    "p5_outline_faults": p5_outline_faults,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p6_faults": p6_faults,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_capped": p7_capped,
    "p7_faults": p7_faults,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip(a.vector, b.vector), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"

#: The five nearest of each entry by brute force.
_NEAR = f"""last AS (SELECT coalesce(nullif(collection, ''), 'documents') AS collection, coalesce(key, '') AS key, vector FROM index_entries
    QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(collection, ''), 'documents'), coalesce(key, '') ORDER BY coalesce(version, 0) DESC) = 1),
  usable AS (SELECT *, {_NORM.format(v="vector")} AS norm FROM last
    WHERE len(vector) = 128 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 128 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
  near AS (SELECT a.collection, a.key, b.key AS other, {_DOT} / a.norm / b.norm AS cosine, row_number() OVER (PARTITION BY a.collection, a.key ORDER BY cosine DESC, b.key) AS rank
    FROM usable a JOIN usable b ON a.collection = b.collection AND a.key <> b.key QUALIFY rank <= 5)"""
_SPACE = "(' ', chr(9), chr(13), chr(10))"
#: Every place a text may be cut, by kind, and the cuts one after the other.
_CUTS = f"""bodies AS (SELECT DISTINCT coalesce(nullif(collection, ''), 'documents') AS collection, coalesce(key, '') AS key, body, length(body) AS size FROM records WHERE body <> ''),
  chars AS (SELECT collection, key, unnest(string_split(body, '')) AS ch, unnest(range(1, size + 1)) AS i FROM bodies WHERE size > 2000),
  runs AS (SELECT *, ch IN {_SPACE} AS ws, count(*) FILTER (ch NOT IN {_SPACE}) OVER (PARTITION BY collection, key ORDER BY i) AS run FROM chars),
  ends AS (SELECT collection, key, max(i) AS c, count(*) FILTER (ch = chr(10)) AS feeds, bool_or(ws) AS ws, max(ch) FILTER (NOT ws) AS before FROM runs GROUP BY collection, key, run),
  marks AS (SELECT collection, key, c, CASE WHEN feeds >= 2 THEN 0 WHEN feeds = 1 THEN 1 WHEN before IN ('.', '!', '?', '。', '！', '？') THEN 2 ELSE 3 END AS kind
    FROM ends WHERE ws OR before IN ('。', '！', '？')),
  cut AS (SELECT collection, key, size, 0::BIGINT AS s, NULL::BIGINT AS c FROM bodies
    UNION ALL SELECT collection, key, size, c - 200, c FROM (
      SELECT p.collection, p.key, p.size, coalesce(arg_min(m.c, m.kind * 10000 - (m.c - p.s)), p.s + 2000) AS c FROM cut p
      LEFT JOIN marks m ON m.collection = p.collection AND m.key = p.key AND m.c > p.s + 1000 AND m.c <= p.s + 2000 WHERE p.size - p.s > 2000 GROUP BY p.collection, p.key, p.size, p.s))"""

#: p2_found: every pair by brute force, as the search must find them all. Queries named for faults give no row.
SQL: dict[str, str] = {
    "p5_found": f"WITH RECURSIVE {_CUTS} SELECT DISTINCT collection, key, c AS cut_at FROM cut WHERE c IS NOT NULL",
    "p5_pieces": f"""WITH RECURSIVE {_CUTS}, all_ends AS (SELECT DISTINCT collection, key, c AS cut_at FROM cut WHERE c IS NOT NULL UNION SELECT collection, key, size FROM bodies),
      placed AS (SELECT *, row_number() OVER w - 1 AS piece, coalesce(lag(cut_at) OVER w - 200, 0) AS start FROM all_ends WINDOW w AS (PARTITION BY collection, key ORDER BY cut_at))
      SELECT p.collection, p.key, p.piece, p.start, p.cut_at, substr(b.body, p.start + 1, p.cut_at - p.start) AS content FROM placed p JOIN bodies b ON b.collection = p.collection AND b.key = p.key""",
    "p6_faults": "SELECT '' AS kind, doc_id AS id FROM documents WHERE false",
    "p7_faults": "SELECT doc_id, source FROM documents WHERE false",
    "p5_outline_faults": "SELECT DISTINCT collection, key FROM records WHERE false",
    "p2_found": f"WITH {_NEAR} SELECT DISTINCT collection, least(key, other) AS key_a, greatest(key, other) AS key_b FROM near WHERE cosine >= 0.85",
    "p2_nearest": f"WITH {_NEAR} SELECT collection, key, other AS neighbour, round(least(cosine, 1), 6) AS similarity, rank FROM near",
    "p4_faults": "SELECT collection, key, '' AS fault FROM index_entries WHERE false",
}
