"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file and the split pattern are parameters; the file is read on each
executor once per worker process and is never part of this repository.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("FOLDSTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The split pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> int:
    return len(encoding(vocabulary, pattern).encode_ordinary(text))


def n_tokens(text: Column | str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """The number of tokens of the whole text; null and empty texts have none."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(vocabulary, pattern).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
