"""Survey text of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KIND_RANK = {"section": 0, "subsection": 1}


def survey_parts(papers: DataFrame, sections: DataFrame, text: str = "normalized") -> DataFrame:
    """(ord, paper_id, part): the rendered text of each paper, its sections before its subsections.

    ``papers`` has one row per ``ord``; papers without sections get their comment block only. NULL titles and authors
    print as nothing.
    """
    rank = F.when(F.col("kind") == "section", 0).otherwise(1)
    body = F.concat(F.lit("\\section{"), F.coalesce("title", F.lit("")), F.lit("}\n\n"), F.coalesce(text, F.lit("")), F.lit("\n\n"))
    bodies = sections.select("ord", F.struct(rank.alias("rank"), F.col("pos"), body.alias("body")).alias("s"))
    ordered = F.array_sort(F.collect_list("s"))
    per_paper = bodies.groupBy("ord").agg(F.array_join(F.transform(ordered, lambda s: s["body"]), "").alias("_body"))
    head = F.concat(
        F.lit("% Paper ID: "), F.col("paper_id"), F.lit("\n% Title: "), F.coalesce("title", F.lit("")),
        F.lit("\n% Authors: "), F.coalesce("authors", F.lit("")), F.lit("\n\n"),
    )
    return papers.join(per_paper, "ord", "left").select(
        "ord", "paper_id", F.concat(head, F.coalesce("_body", F.lit(""))).alias("part")
    )


def survey_text(parts: DataFrame) -> DataFrame:
    """One row (survey_text): all papers in input order. At scale write ``survey_parts`` instead."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "part")))
    return parts.agg(F.array_join(F.transform(ordered, lambda s: s["part"]), "").alias("survey_text"))
