"""Problem 6: keys cited together, and how far beyond chance.

Method: external sort of packed 64-bit pair codes. Keys get dense 31-bit numbers in byte order; each basket emits one
long per pair; the codes are sorted in runs (Spark's external sorter spills and merges them) and run-length counted,
once before the shuffle as a combiner and once after it; the odds ratio has a continuity correction of one half. Should there
be more keys than 31 bits can number, pairs are counted as two numbers instead of one code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import WS
from citeloom.operators.skew import hot_first_join
from citeloom.session import materialise

SECTION = ("paper_id", "kind", "pos")
ID_BITS = 31


def baskets(sections: DataFrame) -> DataFrame:
    """(basket, keys): one row per section, deliveries merged; keys trimmed, distinct, none empty (maybe no key)."""
    keys = F.filter(
        F.transform("citations", lambda k: F.regexp_replace(k, f"^{WS}+|{WS}+$", "")),
        lambda k: k.isNotNull() & (k != ""),
    )
    # Parts are told apart by length, NULL parts by -1: no two sections share an encoding.
    parts = [
        F.concat(
            F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(-1)).cast("string"),
            F.lit(":"),
            F.coalesce(F.col(c).cast("string"), F.lit("")),
        )
        for c in SECTION
    ]
    rows = sections.select(F.unhex(F.md5(F.concat(*parts))).alias("basket"), F.array_distinct(keys).alias("keys"))
    return (
        rows.select("basket", F.explode_outer("keys").alias("k"))
        .groupBy("basket")
        .agg(F.collect_set("k").alias("keys"))
    )


def dictionary(found: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(key, n, id), and the number, of keys in at least ``least`` baskets; ``id`` is dense and follows the keys' byte order.

    Rarer keys cannot be part of a pair counted ``least`` times, so leaving them out loses nothing.
    """
    counts = found.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    ordered = (
        counts.filter(F.col("n") >= least)
        .repartitionByRange("key")
        .sortWithinPartitions("key")
        .withColumn("at", F.monotonically_increasing_id())
    )
    ordered = materialise(ordered, "p6-keys")
    part = F.shiftright("at", 33)
    sizes = sorted(ordered.groupBy(part.alias("part")).count().collect())  # one row a partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["count"]
    start = found.sparkSession.createDataFrame(starts, "part long, start long")  # as small as the list of partitions
    local = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ordered.withColumn("part", part).join(F.broadcast(start), "part")
    return numbered.select("key", "n", (F.col("start") + local).alias("id")), total


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up neighbouring rows of equal code in a sorted stream of (code, n)."""
    last: int | None = None
    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        code = b.column(0).to_numpy(zero_copy_only=False)
        n = b.column(1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        sums = np.add.reduceat(n, starts)
        codes = code[starts]
        if last is not None:
            if codes[0] == last:
                sums[0] += held
            else:
                codes, sums = np.concatenate(([last], codes)), np.concatenate(([held], sums))
        last, held = int(codes[-1]), int(sums[-1])
        if len(codes) > 1:
            yield pa.record_batch([pa.array(codes[:-1]), pa.array(sums[:-1])], names=["code", "n_ab"])
    if last is not None:
        yield pa.record_batch(
            [pa.array([last], pa.int64()), pa.array([held], pa.int64())], names=["code", "n_ab"]
        )


def pair_counts(found: DataFrame, words: DataFrame, rows: int, least: int, packed: bool = True) -> DataFrame:
    """(a, b, n_ab): pairs of numbers, a < b, counted in at least ``least`` baskets; ``rows`` is the number of keys in all baskets.

    A basket's pairs are made one by one, so a basket of any size is held as its own keys only.
    """
    flat = found.filter(F.size("keys") > 1).select("basket", F.explode("keys").alias("key"))
    numbered = hot_first_join(flat, words.select("key", "id", "n"), "key", "n", rows)
    ids = numbered.groupBy("basket").agg(F.sort_array(F.collect_set("id")).alias("ids")).filter(F.size("ids") > 1)
    firsts = ids.select("ids", F.posexplode("ids").alias("at", "a"))
    pairs = firsts.select("a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("b"))
    if not packed:
        return pairs.groupBy("a", "b").agg(F.count("*").alias("n_ab")).filter(F.col("n_ab") >= least)
    code = F.shiftleft("a", 32).bitwiseOR(F.col("b"))
    runs = pairs.select(code.alias("code"), F.lit(1).cast("long").alias("n")).sortWithinPartitions("code")
    schema = "code long, n_ab long"
    merged = runs.mapInArrow(_run_lengths, schema).repartition("code").sortWithinPartitions("code")
    counted = merged.mapInArrow(_run_lengths, schema).filter(F.col("n_ab") >= least)
    return counted.select(F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND((1 << 32) - 1).alias("b"), "n_ab")


def associations(sections: DataFrame, least: int = 5) -> DataFrame:
    """Pairs of keys cited together in at least ``least`` sections.

    Columns: ``key_a`` < ``key_b`` (byte order), ``n_ab``, ``n_a``, ``n_b``, ``n_all`` (all sections, with or
    without citations), ``lift`` (times chance) and ``odds_ratio`` (corrected by one half). A section delivered twice
    counts once, NULL and empty keys not at all; an empty table gives no rows.
    """
    found = materialise(baskets(sections), "p6-baskets")
    n_all, n_keys = found.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    numbered, n_words = dictionary(found, least)
    words = materialise(numbered, "p6-dictionary")
    pairs = pair_counts(found, words, n_keys, least, n_words < 1 << ID_BITS)
    a = words.select(F.col("id").alias("a"), F.col("key").alias("key_a"), F.col("n").alias("n_a"))
    b = words.select(F.col("id").alias("b"), F.col("key").alias("key_b"), F.col("n").alias("n_b"))
    total = F.lit(n_all).cast("long")
    both, only_a, only_b = F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    neither = total - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .select(
            "key_a",
            "key_b",
            "n_ab",
            "n_a",
            "n_b",
            total.alias("n_all"),
            (both * total / (F.col("n_a") * F.col("n_b"))).alias("lift"),
            ((both + 0.5) * (neither + 0.5) / ((only_a + 0.5) * (only_b + 0.5))).alias("odds_ratio"),
        )
    )


def beyond_chance(sections: DataFrame, least: int = 5, times: int = 5) -> DataFrame:
    """(key_a, key_b) of pairs in at least ``least`` sections and at least ``times`` as often as chance."""
    pairs = associations(sections, least)
    exact = F.col("n_ab").cast("decimal(38,0)") * F.col("n_all") >= F.lit(times) * F.col("n_a").cast(
        "decimal(20,0)"
    ) * F.col("n_b")
    return pairs.filter(exact).select("key_a", "key_b")
