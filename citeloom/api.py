"""The one call: ``extract_survey(paper_ids)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from citeloom.config import Options
from citeloom.plans import pipeline
from citeloom.session import get_spark
from citeloom.sources.archive import read_mirror


def sources(spark: SparkSession, options: Options) -> pipeline.Sources:
    """Tables where the options name some, the online services for the rest."""
    read = lambda path: spark.read.parquet(path) if path else None
    dblp = read(options.dblp_table)
    by_search = dblp is not None and "query" in dblp.columns
    return pipeline.Sources(
        read_mirror(spark, options.mirror) if options.mirror else None,
        read(options.arxiv_table),
        dblp if by_search else None,
        None if by_search else dblp,
        options.offline,
    )


def extract_survey(paper_ids: Sequence[str], options: Options | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    """``{"survey_text", "bibtex"}`` of papers by id.

    Archives and answers are downloaded, or read from where ``options`` (by default the environment) says. Uses the active Spark session,
    else a local one.
    """
    options = options or Options()
    spark = spark or SparkSession.getActiveSession() or get_spark()
    return pipeline.extract_survey(spark, paper_ids, options=options, sources=sources(spark, options))
