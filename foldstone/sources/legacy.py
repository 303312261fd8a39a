"""Text rows of older stores (A5, A9, E15): ``|`` between fields, ``\\`` before signs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGN = re.compile(r"(?s)\\(.?)")
_UNIT = re.compile(r"(?s)\\.|.")


def unescape(text: str) -> str:
    """Each backslash gives the sign behind it, ``n`` a line feed; one at the end goes."""
    return _SIGN.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def split_escaped(text: str, separator: str) -> list[str]:
    """Fields between separators that no backslash guards, still escaped."""
    out: list[list[str]] = [[]]
    for unit in _UNIT.findall(text):
        if unit == separator:
            out.append([])
        else:
            out[-1].append(unit)
    return ["".join(units) for units in out]


def parse_metadata(text: str) -> dict[str, str]:
    """``k=v;k=v``; entries without ``=`` are passed over, the first of equal names stays."""
    out: dict[str, str] = {}
    for part in split_escaped(text, ";") if text else []:
        name, equals, value = part.partition("=")
        if equals:
            out.setdefault(unescape(name), unescape(value))
    return out


def parse_record(text: str) -> dict | None:
    """A record of 5 or 8 fields, null if it has another number or numbers are broken."""
    parts = split_escaped(text, "|")
    if len(parts) not in (5, 8):
        return None
    out = dict(zip(("collection", "key", "title", "body"), map(unescape, parts)), metadata=parse_metadata(parts[4]), version=0, updated_at_unix_ms=0, mutation_id="")
    if len(parts) == 8:
        try:
            out.update(version=int(parts[5]), updated_at_unix_ms=int(parts[6]), mutation_id=unescape(parts[7]))
        except ValueError:
            return None
    return out


def parse_log_line(line: str) -> tuple[str, dict] | None:
    """``P|record`` or ``D|collection|key``; null for anything else."""
    op, bar, rest = line.partition("|")
    if not bar or op not in ("P", "D"):
        return None
    if op == "P":
        record = parse_record(rest)
        return ("P", record) if record else None
    parts = [unescape(p) for p in split_escaped(rest, "|")]
    return ("D", {"collection": parts[0], "key": parts[1]}) if len(parts) >= 2 else None


def parse_vector_row(line: str) -> tuple[dict, list[float]] | None:
    """Five record fields and the comma-separated components of a vector."""
    parts = split_escaped(line, "|")
    if len(parts) != 6:
        return None
    record = parse_record("|".join(parts[:5]))
    try:
        vector = [float(x) for x in parts[5].split(",") if x]
    except ValueError:
        return None
    return (record, vector) if record else None


FIELDS = ["collection", "key", "title", "body", "metadata", "version", "updated_at_unix_ms", "mutation_id"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Mutations of legacy log files, numbered in file order; malformed lines are left out."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, seq in zip(b["value"], b["seq"]):
                got = parse_log_line(text)
                if got:
                    rows.append((seq, got[0], *[got[1].get(f, {} if f == "metadata" else 0 if f in ("version", "updated_at_unix_ms") else "") for f in FIELDS]))
            yield pd.DataFrame(rows, columns=["seq", "op", *FIELDS])

    schema = "seq bigint, op string, collection string, key string, title string, body string, metadata map<string,string>, version bigint, updated_at_unix_ms bigint, mutation_id string"
    return lines.mapInPandas(parse, schema)
