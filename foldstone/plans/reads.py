"""Registry queries: reads, text, search (B, E, H; A13–A15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldstone.functions import embed, text, wordpiece
from foldstone.model import table
from foldstone.operators import kv, search
from foldstone.plans.inputs import STATE, filled, records
from foldstone.runtime import spread
from foldstone.sources import legacy, requests, wire

REFERENCES = [(0, "documents", "doc-0000000040"), (1, "documents", "doc-0000000014"), (2, "documents", "no such key"), (3, "archive", "doc-0000000096"), (4, "profiles", "user-0000000047")]
PHRASE = "the open invoice"
ASKED = [(0, "the open invoice on the second attempt"), (1, "quarterly sheet"), (2, "cooling unit before noon")]
PLAIN = ["collection", "key", "title", "version", "mutation_id"]


def kv_get(spark, d):
    return filled(kv.get(table(spark, d, "records"), "documents", "doc-0000000040")).select(*PLAIN)


def kv_multi_get(spark, d):
    refs = spark.createDataFrame(REFERENCES, "ord int, collection string, key string")
    return filled(kv.multi_get(table(spark, d, "records"), refs)).select("ord", *PLAIN)


def kv_range(spark, d):
    return filled(kv.range_scan(table(spark, d, "records"), "wiki", "page/", "page0", 50)).select(*PLAIN)


def kv_range_open(spark, d):
    return filled(kv.range_scan(table(spark, d, "records"), None, limit=5000)).select(*PLAIN)


def kv_page(spark, d):
    return filled(kv.page(table(spark, d, "records"), "documents", "doc-0000000040", 25)).select(*PLAIN)


def kv_collections(spark, d):
    return kv.collections(table(spark, d, "records"))


def metadata_filter(spark, d):
    return filled(kv.filter_metadata(table(spark, d, "records"), {"lang": "en", "source": "api"})).dropDuplicates(["collection", "key"]).select(*PLAIN)


def semantic_predicate(spark, d):
    return records(spark, d).select("collection", "key", kv.is_semantic().alias("semantic"))


def image_reference(spark, d):
    return records(spark, d).select("collection", "key", embed.image_reference(F.col("metadata")).alias("image"))


def index_orphans(spark, d):
    return kv.absent_from(table(spark, d, "index_entries"), records(spark, d)).select("collection", "key").distinct()


def reindex_plan(spark, d):
    return kv.absent_from(records(spark, d).filter(kv.is_semantic()), table(spark, d, "index_entries")).select("collection", "key")


def tokenize_keyword(spark, d):
    tokens = text.keyword_tokens(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).cast("bigint").alias("tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"))


def tokenize_embedding(spark, d):
    tokens = text.embedding_tokens(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).cast("bigint").alias("tokens"))


def keyword_topk(spark, d):
    return search.keyword_search(records(spark, d), PHRASE, 20, "documents")


def keyword_topk_all(spark, d):
    return search.keyword_search(records(spark, d), PHRASE, 20, "documents", {"lang": "en"}, scan_limit=None)


def snippet(spark, d):
    return records(spark, d).select("collection", "key", text.snippet(F.col("body"), F.lit(PHRASE)).alias("snippet"))


def hash_embed(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", embed.VectorizedHashEmbedder(32).embed(F.col("text")).alias("v"))
    return docs.select("doc_id", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in (0, 7, 31)])


def wordpiece_ids(spark, d):
    words = ["[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz0123456789", *[f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz0123456789"], "the", "open", "##ing", "##s", "."]
    ids = wordpiece.wordpiece(F.col("title"), {w: i for i, w in enumerate(words)}, 64)
    return records(spark, d).select("collection", "key", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids"))


def _searched(spark, d, degraded):
    state, embedder = records(spark, d), embed.VectorizedHashEmbedder(32)
    index = search.embed_records(state.filter(kv.is_semantic()), embedder)
    found = search.semantic_search(state, index, spark.createDataFrame(ASKED, "qid bigint, query string"), embedder, 10, "documents", degraded=degraded)
    return found.select("qid", "rank", "key", "title", "snippet", F.round("score", 6).alias("score"), "degraded")


def semantic_search(spark, d):
    return _searched(spark, d, False)


def semantic_degraded(spark, d):
    return _searched(spark, d, True)


def url_params(spark, d):
    r = records(spark, d)
    query = F.concat(F.lit("collection="), F.url_encode("collection"), F.lit("&begin="), F.url_encode("key"), F.lit("&limit=20x&begin=second&filter.title="), F.url_encode("title"), F.lit("&flag"))
    asked = r.select("collection", "key", requests.range_request(query).alias("r"))
    return asked.select("collection", "key", F.col("r.collection").alias("in_collection"), F.col("r.begin").alias("begin"), F.col("r.end").alias("end"), F.col("r.limit").alias("limit"), F.col("r.filters")["title"].alias("title"))


def json_record_parse(spark, d):
    e = table(spark, d, "events")
    request = F.to_json(F.struct(F.col("event_type").alias("collection"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), F.col("user_id").alias("title"), F.col("props").alias("value"), F.col("event_id").alias("version"), F.struct(F.col("event_type").alias("kind"), F.col("value").alias("amount")).alias("metadata")))
    r = requests.record_of(request)
    return e.select(r.alias("r")).select("r.collection", "r.key", "r.title", "r.body", "r.version", text.map_text(F.col("r.metadata")).alias("metadata"))


def json_record_render(spark, d):
    json = records(spark, d).withColumn("json", requests.render_record())
    return json.select(*[F.get_json_object("json", f"$.{c}").alias(c) for c in ("collection", "key", "body", "value", "version", "mutation_id")])


def wire_round_trip(spark, d):
    names = ["collection", "key", "title", "body", "metadata", "version", "updated_at_unix_ms", "mutation_id"]

    def both(batches):
        import pandas as pd

        for b in batches:
            got = [wire.decode_log_entry(wire.encode_log_entry("P", {**r, "metadata": dict(r["metadata"] or {})}))[1] for r in b.to_dict("records")]
            yield pd.DataFrame(got, columns=names)

    r = records(spark, d)
    out = r.select(*names).mapInPandas(both, ", ".join(f"{n} {r.schema[n].dataType.simpleString()}" for n in names))
    return out.select(*[n for n in names if n != "metadata"], text.map_text(F.col("metadata")).alias("metadata"))


def legacy_rows(spark, d):
    def escaped(c):
        return F.regexp_replace(F.regexp_replace(c, r"([\\|;=])", r"\\$1"), "\n", r"\\n")

    r = records(spark, d)
    line = F.concat_ws("|", F.lit("P"), *[escaped(F.col(c)) for c in ("collection", "key", "title", "body")], F.lit("a=1;b=2;a=3"), F.col("version").cast("string"), F.col("updated_at_unix_ms").cast("string"), escaped(F.col("mutation_id")))

    def parse(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([legacy.parse_log_line(t)[1] for t in b["line"]], columns=legacy.FIELDS)

    out = r.select(line.alias("line")).mapInPandas(parse, "collection string, key string, title string, body string, metadata map<string,string>, version bigint, updated_at_unix_ms bigint, mutation_id string")
    return out.select("collection", "key", "title", "body", text.map_text(F.col("metadata")).alias("metadata"), "version", "updated_at_unix_ms", "mutation_id")


QUERIES = {f.__name__: f for f in (kv_get, kv_multi_get, kv_range, kv_range_open, kv_page, kv_collections, metadata_filter, semantic_predicate, image_reference, index_orphans, reindex_plan, tokenize_keyword, tokenize_embedding, keyword_topk, keyword_topk_all, snippet, hash_embed, wordpiece_ids, semantic_search, semantic_degraded, url_params, json_record_parse, json_record_render, wire_round_trip, legacy_rows)}

_P = "collection, key, title, version, mutation_id"
_ENGLISH = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SNIPPET = """CASE WHEN instr({low}, {q}) > 41 THEN substr(body, instr({low}, {q}) - 40, 120) ELSE substr(body, 1, 120) END""".replace("{low}", _ENGLISH.format(x="body"))
_SCORE = """(CASE WHEN contains({t} || ' ' || {b}, {q}) THEN 5 ELSE 0 END + list_sum(list_transform(regexp_extract_all({q}, '[a-z0-9]+'),
  lambda w: CASE WHEN contains({t}, w) THEN 3 ELSE 0 END + CASE WHEN contains({b}, w) THEN 1 ELSE 0 END)))::DOUBLE""".replace("{t}", _ENGLISH.format(x="title")).replace("{b}", _ENGLISH.format(x="body"))
_SEMANTIC = "(title <> '' OR collection = 'documents' OR list_has_any(map_keys(coalesce(metadata, MAP {})), ['image_path', 'image_reference', 'image_uri']))"


def _keyword(source: str) -> str:
    q = f"'{PHRASE}'"
    return f"""WITH {STATE}, candidates AS ({source}), scored AS (SELECT *, {_SCORE.replace("{q}", q)} AS score FROM candidates)
      SELECT key, title, {_SNIPPET.replace("{q}", q)} AS snippet, score FROM scored WHERE score > 0 ORDER BY score DESC, key LIMIT 20"""


_REFS = ", ".join(f"({o}, '{c}', '{k}')" for o, c, k in REFERENCES)
_ASKED = ", ".join(f"({i}, '{q}')" for i, q in ASKED)

SQL = {
    "kv_get": f"WITH {STATE} SELECT {_P} FROM state WHERE collection = 'documents' AND key = 'doc-0000000040'",
    "kv_multi_get": f"WITH {STATE}, refs(ord, c, k) AS (VALUES {_REFS}) SELECT ord, {_P} FROM refs JOIN state ON c = collection AND k = key",
    "kv_range": f"WITH {STATE} SELECT {_P} FROM state WHERE collection = 'wiki' AND key >= 'page/' AND key < 'page0' ORDER BY key LIMIT 50",
    "kv_range_open": f"WITH {STATE} SELECT {_P} FROM state WHERE collection = 'documents' AND key <> '' ORDER BY key LIMIT 1000",
    "kv_page": f"WITH {STATE} SELECT {_P} FROM state WHERE collection = 'documents' AND key > 'doc-0000000040' ORDER BY key LIMIT 25",
    "kv_collections": f"WITH {STATE} SELECT DISTINCT collection FROM state",
    "metadata_filter": f"WITH {STATE} SELECT {_P} FROM state WHERE metadata['lang'] = 'en' AND metadata['source'] = 'api'",
    "semantic_predicate": f"WITH {STATE} SELECT collection, key, {_SEMANTIC} AS semantic FROM state",
    "image_reference": f"""WITH {STATE} SELECT collection, key, regexp_replace(coalesce(nullif(metadata['image_path'], ''), nullif(metadata['image_reference'], ''), nullif(metadata['image_uri'], ''), ''), '^file://', '') AS image FROM state""",
    "index_orphans": f"""WITH {STATE} SELECT DISTINCT coalesce(nullif(collection, ''), 'documents') AS collection, key FROM index_entries e
      WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.collection = coalesce(nullif(e.collection, ''), 'documents') AND s.key = e.key)""",
    "reindex_plan": f"""WITH {STATE} SELECT collection, key FROM state s WHERE {_SEMANTIC}
      AND NOT EXISTS (SELECT 1 FROM index_entries e WHERE s.collection = coalesce(nullif(e.collection, ''), 'documents') AND s.key = e.key)""",
    "tokenize_keyword": f"""SELECT doc_id, len(t)::BIGINT AS tokens, md5(array_to_string(t, ' ')) AS digest
      FROM (SELECT doc_id, regexp_extract_all({_ENGLISH.format(x="coalesce(text, '')")}, '[a-z0-9]+') AS t FROM documents)""",
    "keyword_topk": _keyword("SELECT * FROM state WHERE collection = 'documents' ORDER BY key LIMIT 1000"),
    "keyword_topk_all": _keyword("SELECT * FROM state WHERE collection = 'documents' AND metadata['lang'] = 'en'"),
    "snippet": f"WITH {STATE} SELECT collection, key, {_SNIPPET.replace('{q}', repr(PHRASE))} AS snippet FROM state",
    "semantic_degraded": f"""WITH {STATE}, asked(qid, q) AS (VALUES {_ASKED}),
      scored AS (SELECT *, {_SCORE.replace("{q}", "q")} AS score FROM state, asked WHERE collection = 'documents')
      SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank, key, title, {_SNIPPET.replace("{q}", "q")} AS snippet, score, true AS degraded
      FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    "url_params": f"WITH {STATE} SELECT collection, key, collection AS in_collection, key AS begin, '' AS end, 20 AS limit, title FROM state",
    "json_record_parse": """SELECT event_type AS collection, 'k' || event_id AS key, '' AS title, props AS body, event_id AS version, 'kind=' || event_type AS metadata FROM events""",
    "json_record_render": f"WITH {STATE} SELECT collection, key, body, body AS value, version::VARCHAR AS version, mutation_id FROM state",
    "wire_round_trip": f"""WITH {STATE} SELECT collection, key, title, body, version, updated_at_unix_ms, mutation_id,
      coalesce(array_to_string(list_sort(list_transform(map_entries(metadata), lambda e: e.key || '=' || coalesce(e.value, ''))), ';'), '') AS metadata FROM state""",
    "legacy_rows": f"WITH {STATE} SELECT collection, key, title, body, 'a=1;b=2' AS metadata, version, updated_at_unix_ms, mutation_id FROM state",
}
