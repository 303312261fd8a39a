"""SQL of queries whose functions take several steps to say: hash embeddings, windows of requests."""

from __future__ import annotations

from foldstone.plans.inputs import HASH60, STATE
from foldstone.plans.reads import _ASKED, _ENGLISH, _SEMANTIC, _SNIPPET

QUERIES: dict = {}

#: Tokens of a text, from the hexadecimal digits of its bytes: runs of [a-z0-9], or one byte above 0x7F.
_FOUND = f"regexp_extract_all(regexp_replace(hex(encode({_ENGLISH.format(x='t')})), '(..)', '\\1 ', 'g'), '(?:(?:3[0-9]|6[1-9A-F]|7[0-9A]) )+|[89A-F][0-9A-F] ')"
_TOKEN = "CASE WHEN x < '8' THEN decode(unhex(replace(x, ' ', ''))) ELSE chr(('0x' || trim(x))::INTEGER) END"


def embedded(name: str, source: str, dimensions: int) -> str:
    """``name`` (id, dim, v): the texts ``source`` (id, t) at unit length, dimension by dimension."""
    return f"""{name}_found AS (SELECT id, t, {_FOUND} AS f FROM ({source}) WHERE t <> ''),
      {name}_tokens AS (SELECT id, unnest(CASE WHEN len(f) > 0 THEN list_transform(f, lambda x: {_TOKEN}) ELSE [t] END) AS token, unnest(range(0, greatest(len(f), 1))) AS i FROM {name}_found),
      {name}_parts AS (SELECT id, {HASH60.format(x="token")} % {dimensions} AS dim,
        CASE WHEN {HASH60.format(x="token || '#' || i")} % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END / sqrt(1 + i) AS w FROM {name}_tokens),
      {name}_sums AS (SELECT id, dim, sum(w) AS s FROM (SELECT id, dim, w FROM {name}_parts UNION ALL SELECT id, (dim + 7) % {dimensions}, 0.25 * w FROM {name}_parts) GROUP BY id, dim),
      {name} AS (SELECT id, dim, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS v FROM {name}_sums)"""


_RECORD_TEXT = "regexp_replace(coalesce(nullif(metadata['image_path'], ''), nullif(metadata['image_reference'], ''), nullif(metadata['image_uri'], ''), ''), '^file://', '')"

SQL = {
    "tokenize_embedding": f"SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE greatest(len({_FOUND}), 1) END::BIGINT AS tokens FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "hash_embed": f"""WITH {embedded("e", "SELECT doc_id AS id, text AS t FROM documents", 32)},
      wide AS (SELECT id, {", ".join(f"coalesce(max(v) FILTER (dim = {i}), 0) AS v{i}" for i in (0, 7, 31))} FROM e GROUP BY id)
      SELECT doc_id, round(v0, 6) AS v0, round(v7, 6) AS v7, round(v31, 6) AS v31 FROM documents LEFT JOIN wide ON id = doc_id""",
    "semantic_search": f"""WITH {STATE}, asked(qid, q) AS (VALUES {_ASKED}),
      own AS (SELECT *, {_RECORD_TEXT} AS image FROM state WHERE collection = 'documents' AND {_SEMANTIC}),
      {embedded("r", "SELECT key AS id, CASE WHEN image <> '' THEN image ELSE title || ' ' || body END AS t FROM own", 32)}, {embedded("a", "SELECT qid AS id, q AS t FROM asked", 32)},
      scored AS (SELECT a.id AS qid, r.id AS key, sum(a.v * r.v) AS s FROM a JOIN r USING (dim) GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, key) AS rank FROM scored QUALIFY rank <= 10)
      SELECT qid::BIGINT AS qid, rank, key, title, {_SNIPPET.replace("{q}", "q")} AS snippet, round(s, 6) AS score, false AS degraded FROM ranked JOIN own USING (key) JOIN asked USING (qid)""",
    "metrics_text": """WITH m AS (SELECT count(*)::DOUBLE AS requests_total, count(*) FILTER (event_type = 'error')::DOUBLE AS failures_total, count(*) FILTER (value > 100)::DOUBLE AS degraded_total,
        round(coalesce(avg(value), 0), 2) AS latency_average FROM events)
      SELECT 'foldstone_' || name || ' ' || value AS line FROM (UNPIVOT m ON requests_total, failures_total, degraded_total, latency_average INTO NAME name VALUE value)""",
    "stream_rate_limit": """WITH r AS (SELECT event_id, epoch_us(ts) // 1000 AS at_ms FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY at_ms ORDER BY event_id) AS place FROM r),
      starts AS (SELECT unnest(list_reduce(list(at_ms ORDER BY at_ms), lambda s, x: CASE WHEN x[1] - s[-1] >= 1000 THEN list_concat(s, x) ELSE s END)) AS start FROM (SELECT [at_ms] AS at_ms FROM r))
      SELECT 'all' AS stream, event_id, at_ms, start IS NOT NULL AND place = 1 AS passed FROM n LEFT JOIN (SELECT DISTINCT start FROM starts) ON start = at_ms""",
}
