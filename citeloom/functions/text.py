"""Scalar text functions as Column expressions (no Python at run time).

Fixed values: the related-work phrases, the cite commands and the arXiv patterns must equal what existing corpora
were extracted with, so they are stated here in plain text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RELATED_PHRASES = (
    "related work",
    "background",
    "literature review",
    "prior work",
    "previous work",
    "state of the art",
    "comparative analysis",
    "context",
    "existing work",
    "existing approaches",
    "existing methods",
    "review of the literature",
    "previous approaches",
    "foundation",
)
CITE_COMMANDS = ("cite", "citep", "citet", "citealp", "citeauthor")
EXTENDED_CITE_COMMANDS = CITE_COMMANDS + ("parencite", "autocite", "citeyear", "citealt", "textcite")
ARXIV_IN_TEXT = r"arXiv:?\s*([0-9]+\.[0-9]+)"
ARXIV_AS_KEY = r"^([0-9]{4}\.[0-9]+)$"
ARXIV_FIELDS = ("title", "journal", "note", "raw")
SIGNIFICANT_BYTES = 3
SIGNIFICANT_WORDS = 3

WS = r"\p{IsWhite_Space}"
#: Makes ``\s``, ``\d`` and ``\b`` of a pattern those of Unicode.
UNICODE = "(?U)"
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]"


def lit_or_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(x: Column | str) -> Column:
    """Trim every Unicode white-space character at both ends (Spark's ``trim`` knows spaces only)."""
    return F.regexp_replace(lit_or_col(x), f"^{WS}+|{WS}+$", "")


def clean_text(x: Column | str) -> Column:
    """Letters and digits in lower case, everything else a separator, words joined by ``_``; NULL gives ``''``."""
    words = F.split(F.regexp_replace(lit_or_col(x), NOT_WORD, " "), f"{WS}+")
    return F.lower(F.concat_ws("_", F.filter(words, lambda w: w != "")))


def clean_title(x: Column | str) -> Column:
    """Collapse white space, then strip ASCII punctuation and white space at both ends."""
    return F.regexp_replace(F.regexp_replace(lit_or_col(x), r"(?U)\s+", " "), r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")


def nonempty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def before(x: Column, mark: str) -> Column:
    """Text before the first ``mark``, or all of it."""
    return F.substring_index(x, mark, 1)


def normalize_citation_key(author: Column | str, title: Column | str, year: Column | str) -> Column:
    """``lastname_three_significant_words_year``.

    A missing author gives ``unknown``, an empty one an empty first part; missing titles and years are left out.
    """
    author, title, year = map(lit_or_col, (author, title, year))
    first = F.when(author.contains(","), before(author, ",")).otherwise(before(author, " and "))
    last = F.element_at(F.split(clean_text(trim_ws(before(first, "et al"))), "_"), -1)
    # A missing title cleans to "", which has no significant word.
    words = F.slice(
        F.filter(F.split(clean_text(title), "_"), lambda w: F.octet_length(w) > SIGNIFICANT_BYTES), 1, SIGNIFICANT_WORDS
    )
    years = F.filter(F.array(clean_text(year)), lambda y: y != "")
    head = F.when(author.isNull(), F.lit("unknown")).otherwise(last)
    return F.array_join(F.concat(F.array(head), words, years), "_")


def extract_arxiv_id(fields: Column | str, key: Column | str) -> Column:
    """First arXiv id in title, journal, note, raw; else the key itself when it is one; else NULL."""
    fields, key = lit_or_col(fields), lit_or_col(key)
    tries = [nonempty(F.regexp_extract(fields[f], UNICODE + ARXIV_IN_TEXT, 1)) for f in ARXIV_FIELDS]
    return F.coalesce(*tries, nonempty(F.regexp_extract(key, ARXIV_AS_KEY, 1)))


def cite_pattern(commands: tuple[str, ...] = CITE_COMMANDS) -> str:
    return r"\\(?:" + "|".join(commands) + r")\{([^}]+)\}"


def cite_groups(text: Column | str, extended: bool = False) -> Column:
    """The argument of every citation command, in text order."""
    pattern = cite_pattern(EXTENDED_CITE_COMMANDS if extended else CITE_COMMANDS)
    return F.regexp_extract_all(lit_or_col(text), F.lit(pattern), F.lit(1))


def split_keys(group: Column) -> Column:
    return F.transform(F.split(group, ","), trim_ws)


def cite_keys(text: Column | str, extended: bool = False) -> Column:
    """Sorted, distinct cite keys of a text; empty keys are kept, NULL text gives NULL."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(cite_groups(text, extended), split_keys))))


def is_related_title(title: Column | str) -> Column:
    """True if the lower-case title contains one of the related-work phrases."""
    return F.coalesce(F.lower(lit_or_col(title)).rlike("|".join(RELATED_PHRASES)), F.lit(False))


def dblp_query(title: Column | str) -> Column:
    """Search string of a title: ``{``, ``}``, ``*`` dropped, spaces as ``+``."""
    return F.translate(F.translate(lit_or_col(title), "{}*", ""), " ", "+")


def dblp_authors(texts: Column | str) -> Column:
    """Author list of a hit, homonym numbers dropped, joined by `` and ``."""

    def one(name: Column) -> Column:
        words = F.filter(F.split(name, f"{WS}+"), lambda w: w != "")
        numbered = (F.size(words) >= 2) & F.element_at(words, -1).rlike(r"^\p{N}+$")
        return F.when(numbered, F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(name)

    return F.array_join(F.transform(lit_or_col(texts), one), " and ")


def truncate_bytes(x: Column | str, limit: int = 100) -> Column:
    """Texts over ``limit`` bytes keep ``limit - 3`` bytes (never half a character) and ``...``."""
    x = lit_or_col(x)
    head = F.make_valid_utf8(F.substring(x.cast("binary"), 1, limit - 3).cast("string"))
    return F.when(F.octet_length(x) > limit, F.concat(F.regexp_replace(head, "\ufffd+$", ""), F.lit("..."))).otherwise(x)
