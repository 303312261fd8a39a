import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldstone.functions import embed, text, wordpiece

TEXTS = ["", " ", "Hello, World! hello", "ÀB çd 中文 x1", "...", "a" * 5000, "the the The"]


def h(b):
    return int(hashlib.md5(b).hexdigest()[:15], 16)


def tokens(t):
    raw = t.encode()
    out = re.findall(rb"[a-z0-9]+|[\x80-\xff]", bytes(c + 32 if 65 <= c <= 90 else c for c in raw))
    return out or ([raw] if raw else [])


def vector(t, d=32):
    v = [0.0] * d
    for i, x in enumerate(tokens(t)):
        # bytes over 0x7F are hashed as characters
        x = x.decode("latin-1").encode() if len(x) == 1 else x
        w = (-1 if h(x + b"#%d" % i) % 2 else 1) / math.sqrt(1 + i)
        v[h(x) % d] += w
        v[(h(x) % d + 7) % d] += w / 4
    n = math.sqrt(sum(c * c for c in v))
    return [c / n for c in v] if n else None


def test_embeddings_equal_a_plain_version(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    for e in (embed.HashEmbedder(32), embed.VectorizedHashEmbedder(32)):
        for r in df.select("t", e.embed(F.col("t")).alias("v")).collect():
            want = vector(r["t"]) if r["t"] else None
            assert (r["v"] is None) == (want is None)
            assert want is None or r["v"] == pytest.approx(want, abs=1e-12)


def test_embedding_tokens(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", text.embedding_tokens(F.col("t")).alias("x")).collect():
        want = [x.decode("latin-1") for x in tokens(r["t"])]
        assert r["x"] == want or r["x"] == [r["t"]]


def run(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first()["r"]


def test_folding_is_ascii_only(spark):
    assert run(spark, text.ascii_lower(F.col("t")), t="ÀB İZ") == "Àb İz"
    assert run(spark, text.keyword_tokens(F.col("t")), t="Ab-c1 Éx") == ["ab", "c1", "x"]


def test_keyword_score(spark):
    score = text.keyword_score(F.col("t"), F.col("b"), F.col("q"))
    assert run(spark, score, t="Gateway", b="the gateway", q="gateway") == 9.0
    assert run(spark, score, t="x", b="gateways", q="Gateway gateway") == 2.0
    assert run(spark, score, t="x", b="y", q="") == 5.0
    assert run(spark, score, t="x", b="y", q="none") == 0.0


def test_snippet(spark):
    cut = text.snippet(F.col("b"), F.col("q"))
    body = "é" * 100 + "NEEDLE" + "z" * 200
    assert run(spark, cut, b=body, q="needle") == body[60:180]
    assert run(spark, cut, b="needle", q="needle") == "needle"
    assert run(spark, cut, b=body, q="none") == body[:120]
    assert run(spark, cut, b="", q="none") == ""


def test_query_strings(spark):
    p = text.query_parameters(F.col("t"))
    assert run(spark, p, t="a=1&b=x+y%21&a=2&flag&&c=%zz&d=1=2") == {"a": "1", "b": "x y!", "flag": "", "c": "%zz", "d": "1=2"}
    assert run(spark, p, t="") == {}
    assert run(spark, text.filter_parameters(p), t="filter.lang=en&filter.=x&q=1") == {"lang": "en"}
    for value, want in (("5", 5), ("0", 1), ("99999", 1000), ("junk", 100), ("", 100), ("7x", 7)):
        assert run(spark, text.limit_of(F.col("t")), t=value) == want


def test_normalize_and_images(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(embed.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], None]
    m = spark.createDataFrame([({"image_path": "", "image_uri": "file:///x.png"},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in m.select(embed.image_reference(F.col("m"))).collect()] == ["/x.png", "", ""]


def test_back_ends():
    assert isinstance(embed.embedder("auto"), embed.HashEmbedder)
    with pytest.raises(ValueError):
        embed.embedder("onnxruntime")
    with pytest.raises(ValueError):
        embed.embedder("other")


def test_wordpiece(tmp_path):
    path = tmp_path / "vocab"
    path.write_bytes("[UNK]\r\nun\n##aff\n##able\n!\nun\n中\n".encode())
    v = wordpiece.load_vocabulary(str(path))
    assert v == {"[UNK]": 0, "un": 1, "##aff": 2, "##able": 3, "!": 4, "中": 6}
    assert wordpiece.piece_ids("UNaffable! 中文 x", v, 99) == [1, 2, 3, 4, 6, 0, 0]
    assert wordpiece.piece_ids("unaffable un", v, 2) == [1, 2]
    assert wordpiece.piece_ids("u" * 101, v, 9) == [0]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_basic_tokens_hold_all_but_white_space(t):
    joined = "".join(wordpiece.basic_tokens(t))
    assert len(joined) == len([c for c in t if not (c.isascii() and c.isspace())])
