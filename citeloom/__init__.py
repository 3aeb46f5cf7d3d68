"""Literature-survey extraction on Spark: LaTeX archives in, survey text and BibTeX out."""

__version__ = "0.2.0"


def extract_survey(paper_ids, options=None, spark=None):
    """``{"survey_text", "bibtex"}`` of papers by id; see ``citeloom.api``."""
    from citeloom.api import extract_survey as run

    return run(paper_ids, options, spark)
