"""Exact set-similarity join: all pairs of texts whose word sets reach a Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import clean_text, lit_or_col
from citeloom.operators.skew import split_join
from citeloom.session import materialise


def word_set(text: Column | str) -> Column:
    """Distinct cleaned words, the longest first (then by text): one order for all texts, rare words mostly in front.

    Texts without a letter or digit, and NULL, give an empty array.
    """
    words = F.array_distinct(F.filter(F.split(clean_text(lit_or_col(text)), "_"), lambda w: w != ""))
    ordered = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.coalesce(F.transform(ordered, lambda s: s["w"]), F.array().cast("array<string>"))


def blocks(words: Column | str, least: float) -> Column:
    """Hashed blocks of a word set: two sets of similarity ``least`` or more share one.

    Both sets hold at least ``ceil(least * n)`` common words, so the first two common words (in the order of all words)
    stand among the first ``n - ceil(least * n) + 2`` of either: pairs of those are the blocks. Only sets of at most two
    words can match by a single common word; these add one block a word.
    """
    words = lit_or_col(words)
    n = F.size(words)
    front = F.slice(words, 1, n - F.ceil(n * least - 1e-9).cast("int") + 2)
    pairs = F.flatten(
        F.transform(front, lambda a, i: F.transform(F.slice(front, i + 2, n), lambda b: F.xxhash64(a, b)))
    )
    alone = F.transform(words, lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")
    return F.concat(F.when(n <= 2, alone).otherwise(none), F.when(n >= 2, pairs).otherwise(none))


def signature(words: str) -> Column:
    """64 bits, one set for each word of the column: words of one set without their bit in another's are not in that set."""
    return F.expr(f"aggregate({words}, 0L, (bits, w) -> bits | shiftleft(1L, cast(pmod(xxhash64(w), 64) as int)))")


def similar_sets(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b): all pairs of word sets of ``left`` and ``right`` (columns ``words``) of Jaccard similarity ``least`` or more.

    Sets are compared once however many rows carry them. Blocks only lead to pairs, each of which is compared exactly, so
    a collision of hashes loses and adds nothing. Blocks of any size are split (``split_join``). Empty sets match nothing.
    ``least`` must be 0.5 or more: below, larger sets could match by a single word.
    """
    if not 0.5 <= least <= 1:
        raise ValueError("0.5 <= least <= 1 is required")

    def keyed(side: DataFrame, name: str) -> DataFrame:
        spread = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few bytes a set become dozens of blocks
        sets = side.select(F.col("words").alias(name)).filter(F.size(name) > 0).distinct().repartition(spread, name)
        signed = sets.withColumn(f"s{name}", signature(name))
        return materialise(signed.select(name, f"s{name}", F.explode(blocks(name, least)).alias("block")), "word-blocks")

    met = split_join(keyed(left, "a"), keyed(right, "b"), "block")
    needed = (F.size("a") + F.size("b")) * (least / (1 + least)) - 1e-9
    # Most pairs of a block are ruled out by their bits alone, in compiled code.
    possible = F.size("a") - F.bit_count(F.expr("sa & ~sb")) >= needed
    return met.filter(possible).filter(F.size(F.array_intersect("a", "b")) >= needed).select("a", "b").distinct()
