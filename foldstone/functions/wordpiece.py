"""Greedy longest-match pieces over a vocabulary file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII words, single ASCII signs, single other characters.
_TOKEN = regex.compile(r"[A-Za-z0-9]+|[\x00-\x7f]|[^\x00-\x7f]")
LONGEST = 100


def load_vocabulary(path: str) -> dict[str, int]:
    """Token to line number; the first of equal tokens counts, CR at line ends does not."""
    out: dict[str, int] = {}
    with open(path, encoding="utf-8", newline="\n") as lines:
        for i, line in enumerate(lines):
            out.setdefault(line.rstrip("\n").rstrip("\r"), i)
    return out


def basic_tokens(text: str) -> list[str]:
    """Words folded to lower case and every other sign that is not white space."""
    return [t.lower() if t.isascii() else t for t in _TOKEN.findall(text) if not (t.isascii() and t.isspace())]


def pieces_of(token: str, vocabulary: dict[str, int]) -> list[int] | None:
    """The ids of a token's pieces from the left, or null if it cannot be built."""
    out, rest = [], token
    while rest:
        mark = "##" if out else ""
        size = next((n for n in range(len(rest), 0, -1) if mark + rest[:n] in vocabulary), 0)
        if not size:
            return None
        out.append(vocabulary[mark + rest[:size]])
        rest = rest[size:]
    return out


def piece_ids(text: str, vocabulary: dict[str, int], most: int, unknown: str = "[UNK]") -> list[int]:
    """At most ``most`` ids; tokens over ``LONGEST`` bytes or beyond the vocabulary are unknown."""
    out: list[int] = []
    for token in basic_tokens(text):
        got = pieces_of(token, vocabulary) if len(token.encode()) <= LONGEST else None
        out += [vocabulary[unknown]] if got is None else got
        if len(out) >= most:
            break
    return out[:most]


def wordpiece(text: Column, vocabulary: dict[str, int], most: int = 256, unknown: str = "[UNK]") -> Column:
    """``piece_ids`` over a column; the vocabulary goes out with the function, once a task."""
    if unknown not in vocabulary:
        raise ValueError(f"the vocabulary has no {unknown}")

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: piece_ids(t or "", vocabulary, most, unknown))

    return run(text)
