"""Hash embeddings and embedder back ends.

The hash is portable: the first 15 hex digits of the MD5, a non-negative 60-bit
number that any SQL engine can compute.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.functions.text import embedding_tokens, strip_file_scheme


class Embedder(Protocol):
    """Text to vectors; null where there is nothing to embed."""

    dimensions: int

    def embed(self, text: Column) -> Column: ...


def hash60(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("bigint")


def l2_normalize(vector: Column) -> Column:
    """A vector at unit length, null if it is zero (D3)."""
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(squares > 0, F.transform(vector, lambda x: x.cast("double") / F.sqrt(squares)))


class HashEmbedder:
    """Signed feature hashing of the embedding tokens.

    Token i adds ±1/√(1+i) to the dimension of its hash and a quarter of that seven
    dimensions on; the sign is the parity of a second hash that also has i in it. The
    vector is then brought to unit length. One expression, no shuffle.
    """

    def __init__(self, dimensions: int = 32):
        self.dimensions = dimensions

    def parts(self, text: Column) -> Column:
        """(dimension, weight) of each contribution, in token order."""
        d = self.dimensions

        def both(token: Column, i: Column) -> Column:
            at = F.pmod(hash60(token), F.lit(d)).cast("int")
            odd = F.pmod(hash60(F.concat(token, F.lit("#"), i.cast("string"))), F.lit(2)) == 1
            w = F.when(odd, -1.0).otherwise(1.0) / F.sqrt(1.0 + i)
            return F.array(F.struct(at.alias("dim"), w.alias("w")), F.struct(F.pmod(at + 7, F.lit(d)).alias("dim"), (0.25 * w).alias("w")))

        return F.flatten(F.transform(embedding_tokens(text), both))

    def embed(self, text: Column) -> Column:
        parts = self.parts(text)
        sums = F.transform(F.sequence(F.lit(0), F.lit(self.dimensions - 1)), lambda j: F.aggregate(parts, F.lit(0.0), lambda s, p: F.when(p["dim"] == j, s + p["w"]).otherwise(s)))
        return F.when(F.length(text) > 0, l2_normalize(sums))


class VectorizedHashEmbedder(HashEmbedder):
    """The same vectors from an Arrow-batched function: quicker for long texts, where
    the expression's pass per dimension counts."""

    def embed(self, text: Column) -> Column:
        d = self.dimensions

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import hashlib
            import math
            import re

            pattern = re.compile(rb"[a-z0-9]+|[\x80-\xff]")
            place: dict[bytes, int] = {}

            def h(b: bytes) -> int:
                return int.from_bytes(hashlib.md5(b).digest()[:8], "big") >> 4

            def one(t: str | None):
                if not t:
                    return None
                raw = t.encode()
                # a byte above 0x7F is hashed as the character of that number
                tokens = [x.decode("latin-1").encode() for x in pattern.findall(raw.lower())] or [raw]
                v = [0.0] * d
                for i, token in enumerate(tokens):
                    at = place.get(token)
                    if at is None:
                        at = h(token) % d
                        if len(place) < 100_000:
                            place[token] = at
                    w = (-1.0 if h(token + b"#" + str(i).encode()) % 2 else 1.0) / math.sqrt(1.0 + i)
                    v[at] += w
                    v[(at + 7) % d] += 0.25 * w
                norm = math.sqrt(sum(x * x for x in v))
                return [x / norm for x in v] if norm > 0 else None

            for texts in batches:
                yield texts.map(one)

        return run(text)


class OnnxTextEmbedder:
    """Mean-pooled token states of an ONNX text model, at unit length.

    The model and vocabulary files must be readable on every executor; each worker
    opens the model once. Needs ``onnxruntime``.
    """

    def __init__(self, model_path: str, vocabulary_path: str, dimensions: int, max_tokens: int = 256):
        self.model_path, self.vocabulary_path, self.dimensions, self.max_tokens = model_path, vocabulary_path, dimensions, max_tokens

    def embed(self, text: Column) -> Column:
        model, vocabulary, dimensions, most = self.model_path, self.vocabulary_path, self.dimensions, self.max_tokens

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import numpy as np
            import onnxruntime as ort

            from foldstone.functions.wordpiece import load_vocabulary, piece_ids

            session, ids = ort.InferenceSession(model), load_vocabulary(vocabulary)
            names = {i.name for i in session.get_inputs()}

            def one(t: str | None):
                if not t:
                    return None
                row = [ids["[CLS]"], *piece_ids(t, ids, max(0, most - 2)), ids["[SEP]"]]
                feed = {"input_ids": [row], "attention_mask": [[1] * len(row)], "token_type_ids": [[0] * len(row)]}
                states = session.run(None, {k: np.array(v, np.int64) for k, v in feed.items() if k in names})[0][0]
                v = states.mean(axis=0) if states.ndim == 2 else states
                if len(v) != dimensions:
                    raise ValueError(f"the model gives {len(v)} dimensions, not {dimensions}")
                return (v / np.linalg.norm(v)).astype(np.float32)

            for texts in batches:
                yield texts.map(one)

        return run(text)


def embedder(backend: str = "auto", dimensions: int = 32, **model) -> Embedder:
    """The back end asked for; ``auto`` takes a model if one is given and its runtime
    is there, and hashes otherwise (E10)."""
    if backend not in ("auto", "onnxruntime", "deterministic"):
        raise ValueError(f"unknown back end {backend!r}")
    if backend != "deterministic" and model.get("model_path"):
        try:
            import onnxruntime  # noqa: F401

            return OnnxTextEmbedder(dimensions=dimensions, **model)
        except ImportError:
            if backend == "onnxruntime":
                raise
    elif backend == "onnxruntime":
        raise ValueError("onnxruntime needs model_path and vocabulary_path")
    return VectorizedHashEmbedder(dimensions)


def image_reference(metadata: Column) -> Column:
    """The first non-empty of the image keys, "" if none."""
    given = [F.nullif(metadata[k], F.lit("")) for k in ("image_path", "image_reference", "image_uri")]
    return strip_file_scheme(F.coalesce(*given, F.lit("")))


def record_text(df: DataFrame) -> Column:
    """What is embedded of a record: its image if it names one, else title and body."""
    text = F.concat(F.coalesce(df["title"], F.lit("")), F.lit(" "), F.coalesce(df["body"], F.lit("")))
    image = image_reference(df["metadata"])
    return F.when(image != "", image).otherwise(text)
