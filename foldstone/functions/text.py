"""Text functions as Column expressions.

All of them are JVM-side. Case folding and tokens are ASCII, byte for byte.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(c: Column) -> Column:
    """Lower case of A–Z only (E1); ``lower`` would fold other letters too."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def keyword_tokens(c: Column) -> Column:
    """Runs of ``[a-z0-9]`` of the folded text."""
    return F.regexp_extract_all(ascii_lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def byte_text(c: Column) -> Column:
    """The UTF-8 bytes of a text, each as one character."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def embedding_tokens(c: Column) -> Column:
    """As ``keyword_tokens``, and each byte above 0x7F by itself; a text without any
    such token is its own single token (E3)."""
    found = F.regexp_extract_all(ascii_lower(byte_text(c)), F.lit("[a-z0-9]+|[\\x80-\\xff]"), F.lit(0))
    return F.when(F.size(found) > 0, found).when(F.length(c) > 0, F.array(c)).otherwise(found)


def keyword_score(title: Column, body: Column, query: Column) -> Column:
    """5 if the folded query stands in ``title body``, and per query token, repeats
    counted, 3 if it stands in the title and 1 if in the body (E11)."""
    t, b, q = ascii_lower(title), ascii_lower(body), ascii_lower(query)
    whole = F.when(F.contains(F.concat(t, F.lit(" "), b), q), 5).otherwise(0)

    def add(total: Column, token: Column) -> Column:
        return total + F.when(F.contains(t, token), 3).otherwise(0) + F.when(F.contains(b, token), 1).otherwise(0)

    return (whole + F.aggregate(keyword_tokens(query), F.lit(0), add)).cast("double")


def snippet(body: Column, query: Column, before: int = 40, size: int = 120) -> Column:
    """Up to ``size`` characters from ``before`` ahead of the query on, or the head of
    the body if the query does not occur (E13). Characters, so no letter is split."""
    at = F.instr(ascii_lower(body), ascii_lower(query))
    begin = F.when(F.length(query) == 0, 1).when(at > 0, F.greatest(at - before, F.lit(1))).otherwise(1)
    return F.substring(body, begin, F.lit(size))


def query_parameters(c: Column) -> Column:
    """A URL query string as a map; ``+`` is a blank, the first of equal names counts,
    names without ``=`` have an empty value, and bad escapes stay as they are (A15, E14)."""

    def decode(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    def pair(x: Column) -> Column:
        name = F.substring_index(x, "=", 1)
        has = F.contains(x, F.lit("="))
        value = F.when(has, F.substring(x, F.length(name) + 2, F.length(x))).otherwise("")
        return F.struct(decode(name).alias("key"), decode(value).alias("value"))

    pairs = F.transform(F.filter(F.split(c, "&"), lambda x: x != ""), pair)
    first = F.aggregate(pairs, F.slice(pairs, 1, 0), lambda acc, p: F.when(F.exists(acc, lambda a: a["key"] == p["key"]), acc).otherwise(F.array_append(acc, p)))
    return F.map_from_entries(first)


def filter_parameters(parameters: Column, prefix: str = "filter.") -> Column:
    """The parameters named ``filter.<field>``, by field."""
    own = F.map_filter(parameters, lambda k, v: F.startswith(k, F.lit(prefix)) & (F.length(k) > len(prefix)))
    return F.transform_keys(own, lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))


def map_text(c: Column) -> Column:
    """A map as ``k=v`` entries, sorted and joined by ``;``, for comparing and display."""
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(entries, ";")


def strip_file_scheme(c: Column) -> Column:
    return F.regexp_replace(c, "^file://", "")


def matches_filters(metadata: Column, filters: dict[str, str] | None) -> Column:
    """Whether every filter's field has exactly its value; a missing field does not."""
    out = F.lit(True)
    for field, value in (filters or {}).items():
        out = out & F.coalesce(metadata[field] == value, F.lit(False))
    return out


def clamp_top_k(k: int, most: int = 50) -> int:
    """A request's result size."""
    return min(max(1, k), most)


def limit_of(c: Column, default: int = 100, most: int = 1000) -> Column:
    """A requested limit: junk gives the default, the rest is clamped to 1 … most."""
    return F.least(F.greatest(F.coalesce(F.try_to_number(F.regexp_extract(c, "^\\s*([0-9]{1,9})", 1), F.lit("999999999")).cast("int"), F.lit(default)), F.lit(1)), F.lit(most))
