"""Abusive, hateful or sexual content (problem 8).

Documents are scored by their passages, and a passage by its nearest labelled
examples: exact TF-IDF cosine over letter grams, found through an inverted index
with the largest weight of each gram in each block of examples, so that blocks (and
first of all the whole index) are skipped where no example can be similar enough.
The nearest examples vote, weighted by similarity and drawn to the base rate. Votes are
calibrated on labelled documents held out from the fit, so a score is the share of
documents with such votes that reviewers found abusive; the nearest abusive example is
the evidence.

*Fitting.* Reviewed documents are labelled, not their passages. A passage of a
document found abusive is a candidate if its grams occur clearly more often in such
documents than elsewhere; the passages of harmless documents that resemble a candidate are its
counter-examples. Candidates that their own neighbours vote down are dropped, and
the rest are the examples, so harmless uses of the same words vote against. The fit
reads at most ``MAX_LABELLED`` reviewed documents, those with the smallest hashes, and of
these as many as have ``MAX_LETTERS`` letters in all; every candidate and every
counter-example of theirs is an example.

*Calibration.* ``FOLDS`` times a fit without one part of the labelled documents scores that
part; isotonic regression turns the votes into shares, and the threshold is the vote at
which most held-out documents are told right.

Scale: scoring is one pass over the documents without a shuffle, in which each text
is decoded and folded whole and its grams are arrays from there on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm.mailtext import GRAM, Letters, grams_of, readable
from foldstone.runtime import cut

TERMS = 26**GRAM
#: Bounds of what is fitted on: reviewed documents, and letters of theirs in all.
MAX_LABELLED, MAX_LETTERS = 20_000, 200_000_000
#: Examples less similar than this do not count; how many count; the weight of the base
#: rate, in documents.
FLOOR, NEAREST, PRIOR = 0.4, 30, 0.2
#: A passage of several reviewed documents votes with their number, up to this.
MOST_VOTES = 3
#: How far above the base rate, as a share of what is left, a passage's grams must be for
#: a candidate, and the weight of the base rate in those shares.
ABOVE, SMOOTH = 0.2, 3.0
FOLDS = 3
#: Labelled documents in which no vote tells anything give this threshold.
USUAL = 0.5
BLOCK = 32
#: Passages that are turned into grams at a time while fitting.
PORTION = 20_000


def _expand(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all ranges, and the range each belongs to."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of], of


def weigh(codes: np.ndarray, passage: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, passage, weight) of each distinct gram of each passage, at unit length."""
    both, tf = np.unique(passage.astype(np.int64) * TERMS + codes, return_counts=True)
    p, c = np.divmod(both, TERMS)
    w = tf * idf[c].astype(np.float64)
    norm = np.sqrt(np.bincount(p, w * w, minlength=n))
    return c, p, w / np.maximum(norm[p], 1e-12)


@dataclass
class Examples:
    """The inverted index over labelled passages."""

    idf: np.ndarray
    passages: list[bytes]
    label: np.ndarray  # share of abusive documents among those with the passage
    docs: np.ndarray  # how many documents have it
    doc: np.ndarray  # one of those documents
    most: np.ndarray  # per gram: its largest weight in any example
    block_start: np.ndarray  # per gram: its blocks in the arrays below
    block: np.ndarray
    block_most: np.ndarray
    posting_start: np.ndarray  # per (gram, block): its postings in the arrays below
    posting: np.ndarray
    posting_weight: np.ndarray
    base: float
    floor: float = FLOOR
    nearest: int = NEAREST
    votes: np.ndarray = field(default_factory=lambda: np.zeros(1))  # calibration: votes, and the scores they stand for
    scores: np.ndarray = field(default_factory=lambda: np.zeros(1))
    threshold: float = USUAL  # of votes

    @classmethod
    def build(cls, passages: list[bytes], label: np.ndarray, docs: np.ndarray, doc: np.ndarray, idf: np.ndarray, base: float) -> Examples:
        order = sorted(range(len(passages)), key=lambda i: passages[i])  # alike passages share blocks
        passages, label, docs, doc = [passages[i] for i in order], label[order], docs[order], doc[order]
        codes, which = grams_of(passages) if passages else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        c, p, w = weigh(codes, which, len(passages), idf)
        sort = np.lexsort((p, c))
        c, p, w = c[sort], p[sort], w[sort]
        pair = c * (len(passages) // BLOCK + 1) + p // BLOCK
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        block_most = np.maximum.reduceat(w, starts) if len(starts) else w
        most = np.zeros(TERMS, np.float32)
        np.maximum.at(most, c, np.nextafter(w.astype(np.float32), np.float32(2)))
        block_start = np.searchsorted(c[starts], np.arange(TERMS + 1))
        return cls(idf, passages, label, docs, doc, most, block_start, p[starts] // BLOCK, block_most, np.append(starts, len(p)), p, w, base)

    def similar(self, codes: np.ndarray, passage: np.ndarray, n: int, floor: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, example, cosine) of all pairs whose cosine is at least ``floor``."""
        floor = self.floor if floor is None else floor
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(codes) or not len(self.label):
            return none
        w = self.idf[codes]
        # The whole index is the first block; repeated grams only make the true norm longer.
        bound = np.bincount(passage, w * self.most[codes], minlength=n) / np.sqrt(np.maximum(np.bincount(passage, w * w, minlength=n), 1e-12))
        kept = np.flatnonzero(bound >= floor)
        if not len(kept):
            return none
        new = np.full(n, -1, np.int64)
        new[kept] = np.arange(len(kept))
        at = new[passage] >= 0
        c, p, w = weigh(codes[at], new[passage[at]], len(kept), self.idf)
        out = []
        blocks = len(self.label) // BLOCK + 1
        step = max(1, 4_000_000 // max(blocks, BLOCK))
        for a in range(0, len(kept), step):
            lo, hi = np.searchsorted(p, [a, a + step])
            cc, pp, ww = c[lo:hi], p[lo:hi] - a, w[lo:hi]
            m = min(step, len(kept) - a)
            entry, of = _expand(self.block_start[cc], self.block_start[cc + 1] - self.block_start[cc])
            cell = pp[of] * blocks + self.block[entry]
            able = np.bincount(cell, ww[of] * self.block_most[entry], minlength=m * blocks) >= floor - 1e-9
            go = able[cell]
            entry, of = entry[go], of[go]
            place, which = _expand(self.posting_start[entry], self.posting_start[entry + 1] - self.posting_start[entry])
            pair = pp[of[which]] * len(self.label) + self.posting[place]
            pairs, where = np.unique(pair, return_inverse=True)
            cosine = np.bincount(where, ww[of[which]] * self.posting_weight[place], minlength=len(pairs))
            good = cosine >= floor
            q, e = np.divmod(pairs[good], len(self.label))
            out.append((kept[q + a], e, cosine[good]))
        q, e, s = (np.concatenate(x) for x in zip(*out))
        return q, e, s

    def vote(self, q: np.ndarray, e: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes, nearest abusive example and its cosine of each passage that has any."""
        order = np.lexsort((e, -s, q))
        q, e, s = q[order], e[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        near = rank < self.nearest
        q, e, s = q[near], e[near], s[near]
        w = s * np.minimum(self.docs[e], MOST_VOTES)
        score = (np.bincount(q, w * self.label[e], minlength=n) + PRIOR * self.base) / (np.bincount(q, w, minlength=n) + PRIOR)
        best, cosine = np.full(n, -1, np.int64), np.zeros(n)
        bad = np.flatnonzero(self.label[e] >= 0.5)[::-1]
        best[q[bad]], cosine[q[bad]] = e[bad], s[bad]
        score[np.bincount(q, minlength=n) == 0] = 0
        return score, best, cosine


Passage = tuple[bytes, bool]  # its letters, and whether it may be an example


def fit(passages: list[list[Passage]], label: np.ndarray, doc: np.ndarray, floor: float = FLOOR, nearest: int = NEAREST) -> Examples:
    """Examples from reviewed documents: their passages, labels (0 … 1) and ids."""
    where: dict[bytes, int] = {}
    total, bad, one, able = [], [], [], []
    for own, y, d in zip(passages, label, doc):
        for p, example in dict(own).items():
            i = where.setdefault(p, len(where))
            if i == len(total):
                total.append(0)
                bad.append(0.0)
                one.append(d)
                able.append(False)
            total[i] += 1
            bad[i] += y
            able[i] |= example
            if y >= 0.5:
                one[i] = d
    texts = list(where)
    n, y, one, may = np.array(total, np.float64), np.array(bad), np.array(one, np.int64), np.array(able, bool)
    base = float(np.mean(label)) if len(label) else 0.0

    def terms() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passage, gram) pairs, some passages at a time, so that memory is bounded."""
        for at in range(0, len(texts), PORTION):
            codes, which = grams_of(texts[at : at + PORTION])
            p, c = np.divmod(np.unique(which.astype(np.int64) * TERMS + codes), TERMS)
            yield p + at, c

    df, bad_df, all_df = np.zeros(TERMS), np.zeros(TERMS), np.zeros(TERMS)
    for p, c in terms():
        df += np.bincount(c, minlength=TERMS)
        bad_df += np.bincount(c, y[p], minlength=TERMS)
        all_df += np.bincount(c, n[p], minlength=TERMS)
    idf = np.log((1 + len(texts)) / (1 + df)).astype(np.float32)
    share = (bad_df + SMOOTH * base) / (all_df + SMOOTH)
    suspicion = np.zeros(len(texts))
    for p, c in terms():
        w = idf[c].astype(np.float64) ** 2
        if not len(p):
            continue
        own = slice(p[0], p[-1] + 1)
        suspicion[own] = np.bincount(p - p[0], w * share[c]) / np.maximum(np.bincount(p - p[0], w), 1e-12)
    rate = y / np.maximum(n, 1)
    suspects = np.flatnonzero(may & (rate >= 0.5) & (suspicion >= base + ABOVE * (1 - base)))
    other = np.flatnonzero(rate < 0.5)

    def pick(which_ones: np.ndarray) -> list[bytes]:
        return [texts[i] for i in which_ones]

    def index_of(chosen: np.ndarray) -> Examples:
        made = Examples.build(pick(chosen), rate[chosen], n[chosen], one[chosen], idf, base)
        made.floor, made.nearest = floor, nearest
        return made

    def against(suspects: np.ndarray) -> np.ndarray:
        """The harmless passages that resemble a suspect."""
        first, close = index_of(suspects), np.zeros(len(other), bool)
        for at in range(0, len(other), PORTION):
            part = pick(other[at : at + PORTION])
            q, _, _ = first.similar(*grams_of(part), len(part))
            close[q + at] = True
        return other[close]

    index = index_of(np.concatenate([suspects, against(suspects)]))
    votes, _, _ = index.vote(*index.similar(*grams_of(pick(suspects)), len(suspects)), len(suspects))
    suspects = suspects[votes >= 0.5]
    return index_of(np.concatenate([suspects, against(suspects)]))


def votes_of(passages: list[list[Passage]], examples: Examples) -> np.ndarray:
    """The highest vote of each document's passages."""
    out, sizes = np.zeros(len(passages)), [len(own) for own in passages]
    of, flat = np.repeat(np.arange(len(passages)), sizes), [p for own in passages for p, _ in own]
    for at in range(0, len(flat), PORTION):
        part = flat[at : at + PORTION]
        votes, _, _ = examples.vote(*examples.similar(*grams_of(part), len(part)), len(part))
        np.maximum.at(out, of[at : at + PORTION], votes)
    return out


def isotonic(votes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (vote, share) of the increasing function closest to the labels."""
    order = np.argsort(votes, kind="stable")
    x, first = np.unique(votes[order], return_index=True)
    y, n = np.add.reduceat(label[order], first), np.diff(np.append(first, len(order)))
    blocks: list[list[float]] = []  # labels, documents, first and last vote
    for a, b, v in zip(y.tolist(), n.tolist(), x.tolist()):
        blocks.append([a, b, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, b, _, v = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2], v]
    return np.array([v for b in blocks for v in b[2:]]), np.array([b[0] / b[1] for b in blocks for _ in range(2)])


def best_threshold(votes: np.ndarray, label: np.ndarray) -> float:
    """The vote from which on documents are best taken for abusive: that with the fewest
    errors; of several, the middle of the widest stretch between two votes."""
    order = np.argsort(votes, kind="stable")
    v, y = votes[order], label[order]
    errors = np.concatenate([[0.0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0.0]])  # below i harmless, from i on abusive
    low, high = np.concatenate([[0.0], v]), np.concatenate([v, [1.0]])
    possible = np.flatnonzero((high > low) & (errors <= errors[high > low].min() + 1e-9)) if len(v) else np.zeros(0, np.int64)
    if not len(possible) or possible[-1] == len(v):  # nothing is told apart
        return USUAL
    best = possible[np.argmax(high[possible] - low[possible])]
    return float((low[best] + high[best]) / 2)


def calibrated(passages: list[list[Passage]], label: np.ndarray, doc: np.ndarray, folds: int = FOLDS, floor: float = FLOOR, nearest: int = NEAREST) -> Examples:
    """``fit`` on all, with scores and threshold from what fits on parts say of the rest."""
    examples = fit(passages, label, doc, floor, nearest)
    if len(doc) < 2 * folds:
        return examples
    # documents with the same passages are of one fold, or copies would vote for themselves
    fold = np.array([zlib.crc32(b"\n".join(sorted(p for p, _ in own))) % folds for own in passages])
    votes = np.zeros(len(doc))
    for f in range(folds):
        inside, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(inside) and len(held):
            votes[held] = votes_of([passages[i] for i in held], fit([passages[i] for i in inside], label[inside], doc[inside], floor, nearest))
    examples.votes, examples.scores = isotonic(votes, label)
    examples.threshold = best_threshold(votes, label)
    return examples


def score_texts(texts: list[str | None], examples: Examples) -> pa.RecordBatch:
    """``SCORED`` without ids and sources, for each text."""
    letters = Letters([readable(t) if t else "" for t in texts])
    codes, passage = letters.grams()
    n = len(letters.start)
    votes, best, cosine = examples.vote(*examples.similar(codes, passage, n), n)
    order = np.lexsort((-votes, letters.text))
    firsts = order[np.flatnonzero(np.diff(letters.text[order], prepend=-1))] if n else np.zeros(0, np.int64)
    out, doc, sim = np.zeros(len(texts)), np.full(len(texts), -1, np.int64), np.zeros(len(texts))
    out[letters.text[firsts]] = votes[firsts]
    hit = firsts[best[firsts] >= 0]
    doc[letters.text[hit]], sim[letters.text[hit]] = examples.doc[best[hit]], cosine[hit]
    own, like = [None] * len(texts), [None] * len(texts)
    for t, i in zip(letters.text[hit].tolist(), hit.tolist()):
        own[t], like[t] = letters.passage(i).decode(), examples.passages[best[i]].decode()
    score = np.where(out > 0, np.interp(out, examples.votes, examples.scores) if len(examples.votes) > 1 else out, 0.0)
    columns = [pa.array(score), pa.array((out > 0) & (out >= examples.threshold)), pa.array(out), pa.array(own, pa.string()), pa.array(like, pa.string()), pa.array(doc, mask=doc < 0), pa.array(sim)]
    return pa.RecordBatch.from_arrays(columns, names=["score", "abusive", "votes", "passage", "evidence", "evidence_doc_id", "evidence_similarity"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [readable(t) if t else "" for t in batch["text"].to_pylist()]
        letters, own = Letters(texts), [[] for _ in texts]
        for p, t, e in zip(letters.passages(), letters.text.tolist(), letters.example.tolist()):
            own[t].append(p if e else b"-" + p)
        packed = [b"\n".join(x) for x in own]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(packed, pa.binary()), pa.array([len(p) for p in packed], pa.int64())], names=["doc_id", "label", "passages", "letters"])


def labelled(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_letters: int = MAX_LETTERS) -> tuple[list[list[Passage]], np.ndarray, np.ndarray]:
    """Passages, labels and ids of the reviewed among ``documents``; a document's label
    is the mean of its reviews that are not null, and documents without one don't count."""
    reviewed = labels.filter("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("abusive").cast("double")).alias("label"))
    chosen = reviewed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # at most max_labelled rows go out; their passages are kept, so that sizes can be asked first
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    made = cut(rows.mapInArrow(_passages, "doc_id bigint, label double, passages binary, letters bigint"))
    sizes = made.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "letters").toArrow()
    fits = np.cumsum(sizes["letters"].to_numpy()) <= max_letters
    few = made if fits.all() else made.filter(F.col("doc_id").isin(sizes["doc_id"].to_numpy()[fits].tolist()))
    got = few.select("doc_id", "label", "passages").toArrow().sort_by("doc_id")
    passages = [[(p[1:], False) if p[:1] == b"-" else (p, True) for p in b.split(b"\n")] if b else [] for b in got["passages"].to_pylist()]
    return passages, got["label"].to_numpy(), got["doc_id"].to_numpy()


SCORED = "doc_id bigint, source string, score double, abusive boolean, votes double, passage string, evidence string, evidence_doc_id bigint, evidence_similarity double"


def scores(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_letters: int = MAX_LETTERS, folds: int = FOLDS, floor: float = FLOOR, nearest: int = NEAREST) -> DataFrame:
    """For every document its ``score``, whether it counts as ``abusive``, the ``votes``
    behind both, the letters of the ``passage`` they are for, and as evidence the nearest
    abusive example: its letters, document and similarity (null and 0 where there is none).

    Needs ``doc_id, text, source`` and ``doc_id, abusive``; other columns play no part.
    Null and empty texts score 0, and so does everything if nothing is labelled.
    Repeated rows are scored each; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(calibrated(*labelled(documents, labels, max_labelled, max_letters), folds, floor, nearest))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                said = score_texts(batch["text"].to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], *said.columns], names=["doc_id", "source", *said.schema.names])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(score, SCORED)


def abusive(scored: DataFrame) -> DataFrame:
    return scored.filter("abusive")


def rates(scored: DataFrame) -> DataFrame:
    """Per source (null is one): documents, abusive ones, their share, the mean score."""
    bad = F.count_if("abusive")
    return scored.groupBy("source").agg(F.count("*").alias("documents"), bad.alias("abusive"), (bad / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))
