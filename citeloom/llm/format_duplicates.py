"""Problem 5: records that are identical but for white space, case, punctuation and field order.

Method: every row gets a canonical key (only letters and digits, fields by name). Partial counts find the hot keys
exactly; hot keys are aggregated in two levels (salted, then whole), all others in one shuffle. The representative
is the smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.skew import SALTS, hot_first_join, hot_threshold
from citeloom.session import materialise

NOT_ALNUM = r"[^\p{L}\p{N}]+"
IGNORED_FIELD = "raw"


def squeeze(x: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.lower(F.regexp_replace(x, NOT_ALNUM, ""))


def canonical_record(key: Column, entry_type: Column, fields: Column) -> Column:
    """128-bit key of a record's canonical form, NULL for records whose title has no letter or digit.

    NULL fields count as absent, a NULL type or key as empty; field order and the field ``raw`` do not matter.
    """
    entries = F.transform(
        F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull()),
        lambda e: F.struct(squeeze(e["key"]).alias("k"), squeeze(e["value"]).alias("v")),
    )
    kept = F.array_sort(F.filter(entries, lambda e: e["k"] != IGNORED_FIELD))
    titled = F.exists(kept, lambda e: (e["k"] == "title") & (e["v"] != ""))
    text = F.concat_ws(
        "\u0001",
        squeeze(F.coalesce(key, F.lit(""))),
        squeeze(F.coalesce(entry_type, F.lit(""))),
        F.array_join(F.transform(kept, lambda e: F.concat(e["k"], F.lit("\u0002"), e["v"])), "\u0001"),
    )
    return F.when(titled, F.unhex(F.md5(text)))


def keyed(bib: DataFrame) -> DataFrame:
    """(entry_id, ckey) of every row with an identifier, written once so that counting, choosing and joining read 24 bytes a row."""
    rows = bib.filter("entry_id IS NOT NULL").select(
        F.col("entry_id").cast("long").alias("entry_id"),
        canonical_record(F.col("key"), F.col("entry_type"), F.col("fields")).alias("ckey"),
    )
    return materialise(rows, "p5-keys")


def groups(rows: DataFrame, total: int) -> DataFrame:
    """One row per canonical key: ``first_id``, ``copies``. Rows without a key are left out."""
    rows = rows.filter(F.col("ckey").isNotNull())
    # Partial counts: combined before the shuffle, so a hot key costs each task one row.
    # At most HOT_SHARE keys can reach the threshold, which bounds the broadcast.
    counts = rows.groupBy("ckey").agg(F.count("*").alias("n")).filter(F.col("n") >= hot_threshold(total))
    hot = counts.select("ckey", F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(hot), "ckey", "left")
    aggs = (F.min("entry_id").alias("first_id"), F.count("*").alias("copies"))
    salted = (
        marked.filter("hot")
        .withColumn("salt", F.pmod(F.xxhash64("entry_id"), F.lit(SALTS)))
        .groupBy("ckey", "salt")
        .agg(*aggs)
        .groupBy("ckey")
        .agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    )
    plain = marked.filter("hot IS NULL").groupBy("ckey").agg(*aggs)
    return salted.unionByName(plain)


def collapse(bib: DataFrame) -> DataFrame:
    """One row per record: ``entry_id`` (the smallest), ``copies``.

    Rows without a title of at least one letter or digit are their own records with one copy. An empty table gives
    no rows; columns besides ``entry_id``, ``key``, ``entry_type``, ``fields`` are not looked at.
    """
    rows = keyed(bib)
    total = rows.count()
    single = rows.filter(F.col("ckey").isNull()).select("entry_id", F.lit(1).cast("long").alias("copies"))
    return groups(rows, total).select(F.col("first_id").alias("entry_id"), "copies").unionByName(single)


def copies(bib: DataFrame) -> DataFrame:
    """(first_id, entry_id) for every row that is a copy of an earlier one; the first row itself is not listed."""
    rows = keyed(bib)
    total = rows.count()
    repeated = materialise(groups(rows, total).filter(F.col("copies") > 1), "p5-groups")
    joined = hot_first_join(rows.filter(F.col("ckey").isNotNull()), repeated, "ckey", "copies", total)
    return joined.filter(F.col("entry_id") != F.col("first_id")).select("first_id", "entry_id")
