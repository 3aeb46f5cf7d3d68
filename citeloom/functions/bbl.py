"""Parsing one ``\\bibitem`` as Column expressions: author, year and title in the four known styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import UNICODE, clean_title, lit_or_col, nonempty, trim_ws

# Fixed values.
ITEM_HEAD = r"\\bibitem(?:\[[^\]]*\])?\{([^}]+)\}"
PERSON = r"\\bibinfo\{person\}\{([^}]+)\}"
YEAR = r"\b(19\d{2}|20\d{2})\b"
ARTICLE_TITLE = r"\\showarticletitle\{([^}]+)\}"
QUOTED = r"(?:``|\"|')([^`\"']+)(?:''|\"|')"
AUTHOR_FIELD = r"\bibfield{author}"


def bibliography_items(text: Column | str) -> Column:
    """Array of the items of the first ``thebibliography`` environment (each starting at its ``\\bibitem``)."""
    text = lit_or_col(text)
    body = F.element_at(F.split(text, r"\\begin\{thebibliography\}", 2), 2)
    body = F.element_at(F.split(body, r"\\end\{thebibliography\}", 2), 1)
    body = F.regexp_replace(body, UNICODE + r"\\bibitem(\[[^\]]*\])?%\s*\n\s*", r"\\bibitem$1")
    parts = F.split(body, r"(?=\\bibitem(?:\[[^\]]*\])?\{[^}]+\})")
    items = F.filter(parts, lambda p: p.rlike("^" + ITEM_HEAD))
    has = text.contains(r"\begin{thebibliography}")
    return F.when(has, items).otherwise(F.array().cast("array<string>"))


def item_key(item: Column | str) -> Column:
    return F.regexp_extract(lit_or_col(item), ITEM_HEAD, 1)


def _nested(depth: int) -> str:
    """Text with balanced braces up to ``depth`` levels; possessive, so it never backtracks."""
    inner = r"[^{}]*+"
    for _ in range(depth):
        inner = r"[^{}]*+(?:\{" + inner + r"\}[^{}]*+)*+"
    return inner


SHALLOW = "^(" + _nested(4) + r")\}"


def braced_argument(text: Column) -> Column:
    """The text up to the brace that closes the one ``text`` starts behind (code points, so any script is safe).

    NULL if it never closes. Up to four levels of braces are matched by one regular expression; deeper or unbalanced text is walked.
    """
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        done = acc["done"] | (depth <= 0)
        return F.struct(
            depth.alias("depth"),
            F.when(done, acc["out"]).otherwise(F.concat(acc["out"], ch)).alias("out"),
            done.alias("done"),
        )

    walked = F.aggregate(F.split(text, ""), start, step, lambda acc: F.when(acc["done"], acc["out"]))
    return F.when(text.rlike(SHALLOW), F.regexp_extract(text, SHALLOW, 1)).otherwise(walked)


def tagged_author(item: Column) -> Column:
    """Persons of ``\\bibfield{author}{...}``, joined by ``, ``; NULL if there are none."""
    behind = F.try_element_at(F.split(item, r"\\bibfield\{author\}\{", 2), F.lit(2))
    return nonempty(F.array_join(F.regexp_extract_all(braced_argument(behind), F.lit(PERSON), F.lit(1)), ", "))


def plain_author(item: Column) -> Column:
    """Second physical line of the item up to ``et al.``, else up to ``et~al.``; NULL for one-line items."""
    line = trim_ws(F.try_element_at(F.split(trim_ws(item), "\n"), F.lit(2)))
    cut = F.when(line.contains("et al."), F.substring_index(line, "et al.", 1)).otherwise(
        F.substring_index(line, "et~al.", 1)
    )
    return trim_ws(cut)


def item_author(item: Column | str) -> Column:
    item = lit_or_col(item)
    return F.when(item.contains(AUTHOR_FIELD), tagged_author(item)).otherwise(plain_author(item))


def item_year(item: Column | str) -> Column:
    return nonempty(F.regexp_extract(lit_or_col(item), UNICODE + YEAR, 1))


def item_title(item: Column | str) -> Column:
    """Tagged title, else the second ``\\newblock`` block, else (without blocks) the first quoted span."""
    item = lit_or_col(item)
    tagged = nonempty(F.regexp_extract(item, ARTICLE_TITLE, 1))
    blocks = F.filter(F.transform(F.split(item, r"\\newblock"), trim_ws), lambda b: b != "")
    block = F.try_element_at(blocks, F.lit(2))
    quoted = nonempty(F.regexp_extract(item, QUOTED, 1))
    return clean_title(F.when(tagged.isNotNull(), tagged).when(item.contains(r"\newblock"), block).otherwise(quoted))


def item_fields(item: Column | str) -> Column:
    """MAP of the fields present in an item: author, year, title, raw."""
    item = lit_or_col(item)
    pairs = {"author": item_author(item), "year": item_year(item), "title": item_title(item), "raw": trim_ws(item)}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
