"""Queries of the training-data operators, over the whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import cooccurrence, entity_matching, format_duplicates, leakage, name_variants, packing, pii, splitting, survivorship
from citeloom.session import materialise, table


def p1_matches(spark: SparkSession, folder: str) -> DataFrame:
    return entity_matching.matches(table(spark, folder, "bib"), table(spark, folder, "dblp"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_matches(spark, folder).select("entry_id", "hit_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every field is a bundle of its own, as the project's merge is field by field; the rules decide between equals."""
    chosen = survivorship.survivors(table(spark, folder, "bib_versions"), survivorship.SINGLE, survivorship.RULES)
    return chosen.select("dup_group", "field_name", "version_id")


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    return survivorship.records(table(spark, folder, "bib_versions"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = splitting.pieces(table(spark, folder, "sections"), "section_id", "content")
    return cut.filter("n_pieces > 1 AND piece = 0").select("section_id", "cut")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(table(spark, folder, "sections"), "section_id", "content")


def p3_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Each text put together again from its pieces without their overlaps, whether all fit and overlap as they should."""
    parts = splitting.pieces(table(spark, folder, "sections"), "section_id", "content")
    held = parts.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "size", "text"))).alias("p"))
    before = lambda i: F.try_element_at("p", i)  # noqa: E731 - element i counts from 1, so it is the piece in front
    end = lambda x: x["start"] + x["size"]
    fresh = F.transform("p", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], end(before(i)) - x["start"] + 1, x["size"])))
    laps = F.forall(
        F.transform("p", lambda x, i: (i == 0) | (x["start"] == F.greatest(end(before(i)) - splitting.OVERLAP, F.lit(0)))), lambda ok: ok
    )
    return held.select(
        "section_id",
        F.md5(F.array_join(fresh, "")).alias("content_md5"),
        F.forall("p", lambda x: (x["size"] <= splitting.LIMIT) & (x["size"] == F.length(x["text"]))).alias("fits"),
        laps.alias("laps"),
    )


def _name_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return name_variants.clusters(*(table(spark, folder, t) for t in ("author_names", "papers", "bib")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return name_variants.same(_name_clusters(spark, folder))


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _name_clusters(spark, folder)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return format_duplicates.copies(table(spark, folder, "bib"))


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    return format_duplicates.collapse(table(spark, folder, "bib"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrence.beyond_chance(table(spark, folder, "sections"))


def p6_associations(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccurrence.associations(table(spark, folder, "sections"))
    return pairs.withColumns({c: F.round(c, 6) for c in ("lift", "odds_ratio")})


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of keys cited together, in however few sections."""
    pairs = cooccurrence.associations(table(spark, folder, "sections"), least=1)
    return pairs.withColumns({c: F.round(c, 6) for c in ("lift", "odds_ratio")})


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(table(spark, folder, "documents"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(table(spark, folder, "documents"))


def p7_placed(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each text lies in as few pieces as it can, in containers that are not overfull."""
    placed = materialise(packing.containers(table(spark, folder, "documents")), "p7-placed")
    load = placed.groupBy("container").agg(F.sum("tokens").alias("used"))
    docs = placed.join(load, "container").groupBy("doc_id").agg(
        F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("used").alias("used")
    )
    least = F.greatest(F.ceil(F.col("tokens") / packing.CAPACITY), F.lit(1))
    return docs.select("doc_id", (F.col("pieces") == least).alias("whole"), (F.col("used") <= packing.CAPACITY).alias("fits"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return hits.select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(table(spark, folder, "documents"))


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found,
        p1_matches,
        p2_found,
        p2_records,
        p3_found,
        p3_pieces,
        p3_rejoined,
        p4_found,
        p4_clusters,
        p5_found,
        p5_records,
        p6_found,
        p6_associations,
        p6_pairs,
        p7_containers,
        p7_fill,
        p7_placed,
        p8_found,
        p9_found,
        p9_redacted,
    )
}
