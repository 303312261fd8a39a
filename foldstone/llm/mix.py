"""Mixing sources to target weights (problem 7).

Tokens are summed per source. Unless a size is asked for, the mix is as large as the
targets allow: its total is the smallest, over the sources, of ``tokens * max_repeats /
share``, so every source reaches its share and none repeats a record more often than it
may. A mix of ``total_tokens`` may be larger than that: sources whose share would take more
repeats than they may have give all they may, the rest of the total is spread over the
others in proportion to their shares, and the gaps are reported. A source's rate
is its part of the total over its tokens; a record comes out floor(rate) times, and
once more if its hash falls under the fraction.

Targets without documents can't be met: their shares are spread over the others in
proportion. Sources without a target, and records without a source, have no part.

Scale: one pass to tokenize, one aggregate with one row per source, and a narrow
join of that with the counted records; a source that holds a third of all rows is
pre-aggregated map-side like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldstone.llm import tokens
from foldstone.runtime import cut

#: Parts of the hash that decides on the last copy.
PARTS = 1 << 53


def rates(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``source, target_share, max_repeats, tokens, share, rate``; ``share`` is the
    target spread over the sources that have tokens, ``rate`` 0 where there are none, and
    what a source that is held back by ``max_repeats`` can have of ``total_tokens`` otherwise.

    Targets whose share or repeats are null or not positive get rate 0; a source
    listed more than once counts with the sum of its shares and its least repeats.
    """
    have = counted.filter("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    want = targets.filter("source is not null").groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.min("max_repeats"), F.lit(0)).alias("max_repeats"))
    both = want.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    usable = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("tokens") > 0)
    both = both.withColumns({"part": F.when(usable, F.col("target_share")), "most": F.when(usable, F.col("tokens") * F.col("max_repeats"))})
    # tokens a unit of share at which a source is used up; the table has one row per target
    both = both.withColumn("used_up", F.col("most") / F.col("part"))
    if total_tokens is None:
        per_share = F.min("used_up")
    else:
        # sources before this one give all they have; the others share what is left
        order = Window.partitionBy(F.col("part").isNull()).orderBy("used_up", "source")
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        both = both.withColumn("level", (F.lit(float(total_tokens)) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("part").over(after))
        first = F.when(F.col("level") <= F.col("used_up"), F.col("used_up"))  # the first source that is not used up tells
        per_share = F.coalesce(F.min_by("level", first), F.max("used_up"))
    totals = both.agg(F.sum("part").alias("shares"), per_share.alias("per_share"))
    # one row against one row per target
    joined = both.join(F.broadcast(totals), F.lit(True))
    aimed = F.least(F.col("part") * F.col("per_share"), F.col("most").cast("double"))
    joined = joined.withColumn("aimed", F.coalesce(aimed, F.lit(0.0)))
    rate = F.least(F.col("aimed") / F.col("tokens"), F.col("max_repeats").cast("double"))
    whole = F.sum("aimed").over(Window.partitionBy(F.lit(0)))  # one row per target
    share = F.col("part") / F.col("shares") if total_tokens is None else F.when(whole > 0, F.col("aimed") / whole)
    return joined.select("source", "target_share", "max_repeats", "tokens", F.coalesce(share, F.lit(0.0)).alias("share"), F.coalesce(F.when(F.col("part").isNotNull(), rate), F.lit(0.0)).alias("rate"))


def draw(counted: DataFrame, rate: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, source, n_tokens, repeats`` of every record that comes out at least once."""
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(PARTS)) / PARTS
    # one row per target: a table of weights that does not grow with the records
    drawn = counted.join(F.broadcast(rate.select("source", "rate")), "source")
    repeats = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return drawn.select("doc_id", "source", "n_tokens", repeats.cast("bigint").alias("repeats")).filter("repeats > 0")


def count_documents(documents: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens``, kept, since a mix reads it twice."""
    return cut(documents.select("doc_id", "source", tokens.n_tokens("text", vocabulary).alias("n_tokens")))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = tokens.VOCABULARY, total_tokens: int | None = None) -> DataFrame:
    """The chosen records of ``documents`` (doc_id, source, text) with their repeats.

    Texts that are null or empty have no tokens; they come out as often as their
    source's rate says. Empty tables give an empty mix.
    """
    counted = count_documents(documents, vocabulary)
    return draw(counted, rates(counted, targets, total_tokens), seed)


def shares(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = tokens.VOCABULARY, total_tokens: int | None = None) -> DataFrame:
    """Per target: tokens at hand, rate, records, tokens in the mix, the share asked
    for (``target_share``), the one aimed at (``share``), the one reached and the gap."""
    return reached(count_documents(documents, vocabulary), targets, seed, total_tokens)


def reached(counted: DataFrame, targets: DataFrame, seed: int = 0, total_tokens: int | None = None) -> DataFrame:
    """``shares`` over counted documents (doc_id, source, n_tokens)."""
    rate = rates(counted, targets, total_tokens)
    drawn = draw(counted, rate, seed).groupBy("source").agg(F.sum("repeats").alias("records"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"))
    total = drawn.agg(F.sum("mixed_tokens").alias("all_tokens"))
    out = rate.join(drawn, "source", "left").join(F.broadcast(total), F.lit(True), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "source", "target_share", "share", "max_repeats", "tokens", "rate", zero("records"), zero("most_repeats"), zero("mixed_tokens"),
        F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
        (F.col("target_share") - F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0))).alias("gap"),
    )


def faults(counted: DataFrame, targets: DataFrame, seed: int = 0, total_tokens: int | None = None) -> DataFrame:
    """``doc_id, source`` of records that come out too often, or as often as no rate allows: none."""
    rate = rates(counted, targets, total_tokens).select("source", "rate", "max_repeats")
    both = draw(counted, rate, seed).select("doc_id", "source", "repeats").join(F.broadcast(rate), "source")
    return both.filter((F.col("repeats") > F.col("max_repeats")) | (F.abs(F.col("repeats") - F.col("rate")) >= 1)).select("doc_id", "source")
