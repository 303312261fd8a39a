"""Splitting oversized texts at natural boundaries (problem 5).

A text is a tree. Its levels are what divides it, strongest first; a node's children
are the stretches between the boundaries of the next level that divides it. Nodes are
opened only when asked, and only an oversized node is ever asked:

* *By the rule* (``cuts``): levels are blocks between blank lines, lines, sentences and
  words. From a piece's start, sibling nodes are merged as long as the piece stays under
  the limit; if the merged ones leave it too short, the sibling that did not fit, and it
  alone, is opened and the merge goes on among its children.
* *By structure* (``outline``): above the blocks are the sections under headings (``#``,
  underlined or HTML), below them the items of nested lists and rows of tables. Subtrees
  under the limit stay whole; whole siblings are merged bottom-up to the limit, and only
  oversized nodes are taken apart.

Scale: one narrow pass, no shuffle; texts under the limit never reach Python. A
text is held by one task, whole, and costs time in proportion to its length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, LEAST = 2_000, 200, 1_000
SPACE = " \t\r\n"
#: Ends of sentences; the second group also ends one where no white space follows.
STOPS, WIDE_STOPS = ".!?。！？", "。！？"

_RUN = regex.compile(f"[{SPACE}]+")
_WIDE = regex.compile(f"[{WIDE_STOPS}](?![{SPACE}])")
_FENCE = regex.compile(r"^[ ]{0,3}(?:```|~~~).*?(?:^[ ]{0,3}(?:```|~~~)[ \t]*$|\Z)", regex.M | regex.S)
_HASHES = regex.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*\r?$", regex.M)
_UNDERLINED = regex.compile(r"^(\S.{0,200})\r?\n(={3,}|-{3,})[ \t]*\r?$", regex.M)
_HTML_HEADING = regex.compile(r"<h([1-6])\b[^<>]*>(.{0,500}?)</h\1\s*>", regex.I | regex.S)
_HTML_BLOCK = regex.compile(r"<(?:section|article|div|table|ul|ol|pre|blockquote|p)\b", regex.I)
_HTML_ITEM = regex.compile(r"<(?:li|tr|dt|dd)\b", regex.I)
_ITEM = regex.compile(r"^([ \t]*)(?:[-*+•][ \t]|[0-9]{1,3}[.)][ \t])", regex.M)
_TAG = regex.compile(r"<[^<>]*>")
DEPTHS = 3  # of list items that are told apart


@dataclass(frozen=True)
class Node:
    start: int
    end: int
    level: int  # the first level that may divide it

    @property
    def size(self) -> int:
        return self.end - self.start


class Tree:
    """A text and the levels that divide it, each the sorted offsets of its boundaries."""

    def __init__(self, text: str, levels: list[list[int]]):
        self.levels, self.root = levels, Node(0, len(text), 0)

    def divided(self, node: Node) -> tuple[int, int, int]:
        """The level that divides ``node``, and which of its boundaries do (from, to)."""
        for level in range(node.level, len(self.levels)):
            ends = self.levels[level]
            first, last = bisect_right(ends, node.start), bisect_left(ends, node.end)
            if first < last:
                return level, first, last
        return len(self.levels), 0, 0

    def children(self, node: Node) -> list[Node]:
        level, first, last = self.divided(node)
        if first == last:
            return []
        at = [node.start, *self.levels[level][first:last], node.end]
        return [Node(a, b, level + 1) for a, b in zip(at, at[1:])]

    def merged(self, start: int, limit: int, least: int) -> int:
        """Where the piece that begins at ``start`` ends, if more than ``limit`` follows."""
        node, low, high = self.root, start + least, start + limit
        while True:
            level, first, last = self.divided(node)
            if first == last:
                return high
            ends = self.levels[level]
            fits = bisect_right(ends, high, first, last)  # siblings before this one fit together
            if fits > first and ends[fits - 1] > low:
                return ends[fits - 1]
            begin = ends[fits - 1] if fits > first else node.start
            node = Node(begin, ends[fits] if fits < last else node.end, level + 1)  # opened next

    def packed(self, limit: int, later: int) -> list[tuple[int, int]]:
        """The text in consecutive stretches, the first at most ``limit`` long, the
        others ``later``: whole siblings merged, oversized nodes taken apart."""
        out: list[tuple[int, int]] = []

        def room() -> int:
            return later if out else limit

        def take(node: Node) -> None:
            if node.size <= room():
                out.append((node.start, node.end))
                return
            children = self.children(node)
            if not children:  # no boundary inside
                at = node.start
                while at < node.end:
                    end = min(node.end, at + room())
                    out.append((at, end))
                    at = end
                return
            at = None  # where the siblings merged so far begin
            for child in children:
                if at is not None and child.end - at > room():
                    out.append((at, child.start))
                    at = None
                if child.size > room():
                    take(child)
                elif at is None:
                    at = child.start
            if at is not None:
                out.append((at, node.end))

        if self.root.size:
            take(self.root)
        return out


def ruled(text: str) -> Tree:
    """Blocks, lines, sentences and words."""
    return Tree(text, _plain(text))


def _plain(text: str) -> list[list[int]]:
    blocks, lines, sentences, words = [], [], [], []
    for run in _RUN.finditer(text):
        feeds = text.count("\n", *run.span())
        if feeds >= 2:
            blocks.append(run.end())
        elif feeds == 1:
            lines.append(run.end())
        elif run.start() and text[run.start() - 1] in STOPS:
            sentences.append(run.end())
        else:
            words.append(run.end())
    wide = [m.end() for m in _WIDE.finditer(text)]
    return [blocks, lines, sorted(sentences + wide) if wide else sentences, words]


def headings(text: str) -> list[tuple[int, int, str]]:
    """(offset, rank 1 … 6, title) of the headings of a text, in order; lines inside
    fenced code are none."""
    fences = [m.span() for m in _FENCE.finditer(text)]
    begins = [a for a, _ in fences]

    def free(at: int) -> bool:
        i = bisect_right(begins, at)
        return not i or at >= fences[i - 1][1]

    found = [(m.start(), len(m[1]), m[2]) for m in _HASHES.finditer(text)]
    found += [(m.start(), 1 if m[2][0] == "=" else 2, m[1].strip()) for m in _UNDERLINED.finditer(text)]
    found += [(m.start(), int(m[1]), " ".join(_TAG.sub(" ", m[2]).split())) for m in _HTML_HEADING.finditer(text)]
    return sorted(h for h in found if free(h[0]))


def structured(text: str) -> tuple[Tree, list[tuple[int, int, str]]]:
    """Sections, blocks, list items, lines, sentences and words; and the headings."""
    heads = headings(text)
    sections = [sorted({at for at, rank, _ in heads if rank <= r}) for r in range(1, 7)]
    blocks, *rest = _plain(text)
    blocks = sorted({*blocks, *(m.start() for m in _HTML_BLOCK.finditer(text))})
    items = [(m.start(), min(len(m[1].expandtabs(4)) // 2, DEPTHS - 1)) for m in _ITEM.finditer(text)]
    items += [(m.start(), 0) for m in _HTML_ITEM.finditer(text)]
    nested = [sorted({at for at, depth in items if depth <= d}) for d in range(DEPTHS)]
    return Tree(text, [*sections, blocks, *nested, *rest]), heads


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[int]:
    """The offsets, in code points, at which the rule cuts ``text``."""
    if len(text) <= limit:
        return []
    tree, out, start = ruled(text), [], 0
    while tree.root.end - start > limit:
        out.append(tree.merged(start, limit, least))
        start = out[-1] - overlap
    return out


def by_rule(text: str, limit: int, overlap: int, least: int) -> list[tuple[int, int, list[str]]]:
    """(start, end, no path) of each piece."""
    out, start = [], 0
    for end in [*cuts(text, limit, overlap, least), len(text)]:
        out.append((start, end, []))
        start = end - overlap
    return out


def by_structure(text: str, limit: int, overlap: int, least: int) -> list[tuple[int, int, list[str]]]:
    """(start, end, path) of each piece; the path has the titles of the sections in
    which the piece, without its overlap, begins."""
    tree, heads = structured(text)
    out, path, h = [], [], 0
    for i, (start, end) in enumerate(tree.packed(limit, limit - overlap)):
        while h < len(heads) and heads[h][0] <= start:
            path = [p for p in path if p[0] < heads[h][1]] + [(heads[h][1], heads[h][2])]
            h += 1
        out.append((start - overlap if i else start, end, [title for _, title in path]))
    # a first stretch shorter than the overlap leaves less to repeat
    return [(max(0, a), b, p) for a, b, p in out]


def _check(limit: int, overlap: int, least: int) -> None:
    if not 0 <= overlap < least < limit:
        raise ValueError("needs 0 <= overlap < least < limit")


def _split(df: DataFrame, keys: list[str], text: str, limit: int, divide: Callable[[str], list[tuple[int, int, list[str]]]]) -> DataFrame:
    k = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    body = df.filter(F.length(text) > 0).select(*k, F.col(text).alias("text"))
    names = [f"k{i}" for i in range(len(keys))]
    zero, size = F.lit(0).cast("bigint"), F.length("text").cast("bigint")
    whole = body.filter(F.length("text") <= limit).select(*names, zero.alias("piece"), zero.alias("start"), size.alias("cut_at"), F.array().cast("array<string>").alias("path"), F.col("text").alias("content"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *key, t in b.itertuples(index=False):
                rows += [(*key, n, start, end, path, t[start:end]) for n, (start, end, path) in enumerate(divide(t))]
            yield pd.DataFrame(rows, columns=[*names, "piece", "start", "cut_at", "path", "content"])

    kinds = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keys))
    schema = f"{kinds}, piece bigint, start bigint, cut_at bigint, path array<string>, content string"
    out = whole.unionByName(body.filter(F.length("text") > limit).mapInPandas(split, schema))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], "piece", "start", "cut_at", "path", "content")


def pieces(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """``keys``, ``piece`` (from 0), ``start``, ``cut_at`` and the piece's ``content``,
    by the rule.

    Every row of ``df`` is split by itself, so repeated rows give repeated pieces.
    Texts of at most ``limit`` characters come out as one piece; null and empty
    texts give none. Other columns of ``df`` are dropped.
    """
    _check(limit, overlap, least)
    return _split(df, keys, text, limit, lambda t: by_rule(t, limit, overlap, least)).drop("path")


def outline(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """As ``pieces``, by structure, with ``path``, the titles of the sections a piece is
    in (empty for texts that are one piece). Nothing is lost: pieces without their
    overlaps, in order, are the text."""
    _check(limit, overlap, overlap + 1)
    return _split(df, keys, text, limit, lambda t: by_structure(t, limit, overlap, overlap + 1))


def cut_points(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """``keys`` and ``cut_at`` of every cut of the rule, once each however often a row is
    repeated.

    Null, empty and short texts have no cuts.
    """
    _check(limit, overlap, least)

    @F.pandas_udf("array<bigint>")
    def cut_udf(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cuts(t, limit, overlap, least))

    long = df.filter(F.length(text) > limit)
    return long.select(*keys, F.explode(cut_udf(F.col(text))).alias("cut_at")).distinct()
