"""Citations against a bibliography: key maps, rewriting, keys that are missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import CITE_COMMANDS, EXTENDED_CITE_COMMANDS, cite_pattern, split_keys
from citeloom.operators.bibliography import normalized_key
from citeloom.operators.skew import hot_first_join
from citeloom.session import materialise


def key_map(bib: DataFrame) -> DataFrame:
    """(key, new): the normalised key of every entry of a consolidated bibliography."""
    return bib.select("key", normalized_key().alias("new"))


def _commands(text: Column, extended: bool) -> Column:
    pattern = cite_pattern(EXTENDED_CITE_COMMANDS if extended else CITE_COMMANDS)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.arrays_zip(whole.alias("old"), inner.alias("inner"))


def rewrite(sections: DataFrame, keys: DataFrame, row_id: str | Sequence[str], extended_cites: bool = False) -> DataFrame:
    """Adds ``normalized``: ``content`` with every known cite key replaced; unknown keys stay, spacing becomes ``, ``.

    The replacements of a text are applied one after the other to the evolving text, in text order. Only (row, key)
    pairs are shuffled to find the new keys, keys that many rows cite are broadcast, and texts without a citation never move.
    ``row_id`` (a column or several) must be unique. NULL content stays NULL. A column of the name ``normalized`` would be overwritten.
    """
    row = F.struct(*([row_id] if isinstance(row_id, str) else row_id))
    pattern = cite_pattern(EXTENDED_CITE_COMMANDS if extended_cites else CITE_COMMANDS)
    citing = F.coalesce(F.col("content").rlike(pattern), F.lit(False))
    plain = sections.filter(~citing).withColumn("normalized", F.col("content"))
    texts = sections.filter(citing)
    uses = (
        texts.select(row.alias("_row"), F.posexplode(_commands(F.col("content"), extended_cites)).alias("_at", "c"))
        .select("_row", "_at", F.col("c.old").alias("_old"), F.posexplode(split_keys(F.col("c.inner"))).alias("_k", "key"))
    )
    uses = materialise(uses, "citations")  # read three times below; far smaller than the texts
    per_key = uses.groupBy("key").agg(F.count("*").alias("_n"))
    known = keys.select("key", "new").join(per_key, "key")
    mapped = hot_first_join(uses, known, "key", "_n", uses.count(), "left").select(
        "_row", "_at", "_old", "_k", F.coalesce("new", "key").alias("_new")
    )
    # Keys go back to their commands and commands to their texts: one shuffle by row serves both.
    parts = mapped.repartition("_row").groupBy("_row", "_at", "_old").agg(F.array_sort(F.collect_list(F.struct("_k", "_new"))).alias("_keys"))
    command = F.substring_index("_old", "{", 1)
    text = F.concat(
        command, F.lit("{"), F.array_join(F.transform("_keys", lambda k: k["_new"]), ", "), F.lit("}")
    )
    swaps = (
        parts.select("_row", F.struct("_at", "_old", text.alias("_text")).alias("_s"))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list("_s")).alias("_swaps"))
    )
    folded = F.aggregate("_swaps", F.col("content"), lambda acc, s: F.replace(acc, s["_old"], s["_text"]))
    joined = texts.withColumn("_row", row).join(swaps, "_row")  # every citing text has a swap
    return joined.withColumn("normalized", folded).drop("_row", "_swaps").select(*plain.columns).unionByName(plain)


def rewrite_with_map(content: Column | str, mapping: Column) -> Column:
    """The same rewriting for one small bibliography as a MAP column, without a join."""
    content = F.col(content) if isinstance(content, str) else content

    def swap(acc: Column, c: Column) -> Column:
        new = F.transform(split_keys(c["inner"]), lambda k: F.coalesce(F.try_element_at(mapping, k), k))
        text = F.concat(F.substring_index(c["old"], "{", 1), F.lit("{"), F.array_join(new, ", "), F.lit("}"))
        return F.replace(acc, c["old"], text)

    return F.aggregate(_commands(content, False), content, swap)


def missing(sections: DataFrame, bib: DataFrame) -> DataFrame:
    """(key, n_sections): cited keys that the bibliography lacks."""
    cited = sections.select(F.explode(F.array_distinct("citations")).alias("key")).filter("key <> ''")
    return cited.groupBy("key").agg(F.count("*").alias("n_sections")).join(bib.select("key"), "key", "left_anti")
