import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldstone.llm import split

LIMIT, OVERLAP, LEAST = 2000, 200, 1000


def kind_of(text, c):
    """The kind of the cut before character c, 0 the strongest, by the rule's own words."""
    ws = " \t\r\n"
    if text[c - 1] in ws and (c == len(text) or text[c] not in ws):
        start = c
        while start and text[start - 1] in ws:
            start -= 1
        feeds = text[start:c].count("\n")
        if feeds >= 2:
            return 0
        if feeds == 1:
            return 1
        return 2 if start and text[start - 1] in ".!?。！？" else 3
    if text[c - 1] in "。！？" and (c == len(text) or text[c] not in ws):
        return 2
    return None


def brute(text, limit, overlap, least):
    out, s = [], 0
    while len(text) - s > limit:
        best = {}
        for c in range(s + least + 1, s + limit + 1):
            kind = kind_of(text, c)
            if kind is not None:
                best[kind] = c
        out.append(best[min(best)] if best else s + limit)
        s = out[-1] - overlap
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab .!?\n\r\t。！é", max_size=150))
def test_cuts_equal_the_rule(text):
    assert split.cuts(text, 20, 4, 9) == brute(text, 20, 4, 9)


def test_long_texts():
    rnd = random.Random(3)
    words = ["word", "länger", "x" * 60, "end.", "stop!", "全部。", "\n", "\n\n", "\r\n", "  "]
    text = " ".join(rnd.choice(words) for _ in range(4000))
    assert split.cuts(text) == brute(text, LIMIT, OVERLAP, LEAST)
    assert split.cuts("a" * 10_000) == [2000, 3800, 5600, 7400, 9200]
    assert len(split.cuts("a " * 500_000)) > 500


ROWS = [("c", "a", "x" * 2000), ("c", "b", "w " * 1500), ("c", "b", "w " * 1500), (None, "n", None), ("c", "e", ""), ("c", None, "é" * 2001), ("c", "s", "short")]


def test_pieces_cover_the_text_in_order(spark):
    df = spark.createDataFrame(ROWS, "collection string, key string, body string")
    texts = {(c, k): b for c, k, b in ROWS}
    got = {}
    for r in split.pieces(df.distinct(), ["collection", "key"], "body").collect():
        got.setdefault((r["collection"], r["key"]), []).append(r)
    assert got.keys() == {k for k, b in texts.items() if b}
    for k, rows in got.items():
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows)))
        assert rows[0]["start"] == 0 and rows[-1]["cut_at"] == len(texts[k])
        assert all(len(r["content"]) <= 2000 and r["content"] == texts[k][r["start"] : r["cut_at"]] for r in rows)
        assert all(b["start"] == a["cut_at"] - 200 for a, b in zip(rows, rows[1:]))


def test_cut_points_once_for_repeated_rows(spark):
    df = spark.createDataFrame(ROWS, "collection string, key string, body string")
    clash = df.selectExpr("*", "1 as piece", "2 as start", "'x' as text", "'y' as k0", "3 as content")
    for one in (df, clash):
        got = sorted((r["collection"], r["key"] or "", r["cut_at"]) for r in split.cut_points(one, ["collection", "key"], "body").collect())
        assert got == [("c", "", 2000), ("c", "b", 2000)]
    assert split.pieces(clash, ["collection", "key"], "body").count() == split.pieces(df, ["collection", "key"], "body").count()
    assert split.cut_points(df.limit(0), ["key"], "body").count() == 0 and split.pieces(df.limit(0), ["key"], "body").count() == 0


def test_bad_limits(spark):
    with pytest.raises(ValueError):
        split.pieces(spark.createDataFrame(ROWS, "collection string, key string, body string"), ["key"], "body", 100, 60, 50)


def test_registry_cuts_are_within_bodies(spark, small):
    from foldstone.llm.queries import p5_found
    from foldstone.model import table

    bodies = {(r["collection"] or "documents", r["key"] or ""): r["body"] or "" for r in table(spark, small, "records").collect()}
    want = {(c, k, x) for (c, k), b in bodies.items() for x in brute(b, LIMIT, OVERLAP, LEAST)}
    assert {tuple(r) for r in p5_found(spark, small).collect()} == want


MARKED = """# Guide

Opening words.

## Setup

- first item
  - nested one
  - nested two
- second item

```
# no heading inside a fence
```

Title below
===========

<h2>Markup <b>here</b></h2><p>One.</p><ul><li>a</li><li>b</li></ul>
"""


def test_headings_of_all_kinds():
    assert [(r, t) for _, r, t in split.headings(MARKED)] == [(1, "Guide"), (2, "Setup"), (1, "Title below"), (2, "Markup here")]


def test_structure_keeps_whole_subtrees_and_opens_only_oversized_ones():
    tree, _ = split.structured(MARKED)
    stretches = [MARKED[a:b] for a, b in tree.packed(120, 120)]
    assert "".join(stretches) == MARKED
    assert stretches[0].startswith("# Guide") and stretches[1].startswith("## Setup")  # siblings of one section
    assert any(s.startswith("Title below") for s in stretches)
    lists = "- a\n  - aa\n  - ab\n- b\n  - ba\n  - bb\n"
    assert [lists[a:b] for a, b in split.structured(lists)[0].packed(20, 20)] == ["- a\n  - aa\n  - ab\n", "- b\n  - ba\n  - bb\n"]
    assert [lists[a:b] for a, b in split.structured(lists)[0].packed(12, 12)] == ["- a\n  - aa\n", "  - ab\n", "- b\n  - ba\n", "  - bb\n"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#-ab \n.<hp1>=", max_size=200), st.integers(12, 60))
def test_structured_pieces_hold_the_text(text, limit):
    got = split.by_structure(text, limit, 4, 5)
    assert all(0 < b - a <= limit for a, b, _ in got)
    assert "".join(text[(a if not i else got[i - 1][1]) : b] for i, (a, b, _) in enumerate(got)) == text
    assert all(b[0] == max(0, a[1] - 4) for a, b in zip(got, got[1:]))


def test_outline_of_a_table(spark):
    rows = [("c", "m", MARKED * 60), ("c", "n", None), ("c", "e", ""), ("c", "s", "short"), (None, None, "x" * 5000)]
    df = spark.createDataFrame(rows, "collection string, key string, body string")
    got = {}
    for r in split.outline(df.selectExpr("*", "1 as path", "2 as content"), ["collection", "key"], "body").collect():
        got.setdefault((r["collection"], r["key"]), []).append(r)
    assert got.keys() == {("c", "m"), ("c", "s"), (None, None)}
    long = sorted(got["c", "m"], key=lambda r: r["piece"])
    assert all(len(r["content"]) <= 2000 for r in long) and "Guide" in long[1]["path"] or "Title below" in long[1]["path"]
    assert split.outline(df.limit(0), ["key"], "body").count() == 0
