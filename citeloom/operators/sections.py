"""Related-work sections of LaTeX documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import UNICODE, cite_keys, is_related_title, trim_ws

# How the title of a section begins; STARRED_TITLE also takes the star and the short title.
TITLE = r"^\s*\{([^}]*)\}"
STARRED_TITLE = r"^\*?(?:\s*\[[^\]]*\])?\s*\{([^}]*)\}"


def _parts(text: Column, command: str) -> Column:
    """What follows each literal ``\\section`` (or ``\\subsection``), in order."""
    parts = F.split(text, r"\\" + command)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def extract_sections(latex: DataFrame, starred: bool = False, extended_cites: bool = False) -> DataFrame:
    """Sections and subsections whose title names related work: input (ord, paper_id, latex), output ``sections``.

    A part runs to the next command of its own kind, so a subsection's text may cross sections and a related subsection
    in a related section is listed twice. Titles end at the first ``}``. ``pos`` counts all parts of a kind. NULL and
    empty documents give none.
    """
    pattern = UNICODE + (STARRED_TITLE if starred else TITLE)
    found = None
    for kind in ("section", "subsection"):
        parts = latex.select("ord", "paper_id", F.posexplode(_parts(F.col("latex"), kind)).alias("pos", "part"))
        kept = parts.withColumn("title", trim_ws(F.regexp_extract("part", pattern, 1))).filter(is_related_title("title"))
        content = trim_ws(F.regexp_replace("part", pattern.replace("([^}]*)", "[^}]*"), ""))
        rows = kept.select("ord", "paper_id", F.lit(kind).alias("kind"), "pos", "title", content.alias("content"))
        found = rows if found is None else found.unionByName(rows)
    return found.withColumn("citations", cite_keys("content", extended_cites))
