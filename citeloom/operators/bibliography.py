"""Bibliographies: parsing ``.bbl`` files, last-wins consolidation, normalised keys, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.config import Options
from citeloom.functions import bbl
from citeloom.functions.text import extract_arxiv_id, lit_or_col, normalize_citation_key

ENTRY_TYPE = "article"
ORDER = ("ord", "file_ord", "pos")


def parse_bbl(files: DataFrame, options: Options | None = None, ids: tuple[str, ...] = ("ord", "file_ord")) -> DataFrame:
    """Entries of ``.bbl`` texts: input ``ids`` and content, output the ``bib`` schema.

    Texts without a ``thebibliography`` environment and NULL texts give no entry; further columns are dropped. One file
    is parsed in one task, as it is one string; files are independent.
    """
    options = options or Options()
    items = files.select(*ids, F.posexplode(bbl.bibliography_items("content")).alias("pos", "item"))
    item = F.col("item")
    if options.fix_label_lines:  # the label of an item goes onto one line
        label = F.regexp_extract(item, "^" + bbl.ITEM_HEAD, 0)
        behind = F.substring(item, F.length(label) + 1, F.length(item))
        item = F.concat(F.regexp_replace(label, r"\s*\n\s*", " "), behind)
    return items.select(
        *ids,
        "pos",
        bbl.item_key(item).alias("key"),
        F.lit(ENTRY_TYPE).alias("entry_type"),
        bbl.item_fields(item).alias("fields"),
    )


def consolidate(bib: DataFrame, scope: str = "global", tie: str | None = None) -> DataFrame:
    """The last entry of every key in (ord, file_ord, pos), per paper with ``scope="paper"``.

    One partially combined aggregate: a key that a third of all rows carry costs every task one row. ``tie`` names a
    column that settles equal positions (larger wins). NULL keys form one group; an empty table gives no rows.
    """
    keys = ("key",) if scope == "global" else ("ord", "key")
    kept = [c for c in ("ord", "file_ord", "pos", "entry_type", "fields", *([tie] if tie else [])) if c not in keys]
    order = F.struct(*ORDER, *([tie] if tie else []))
    last = F.max_by(F.struct(*kept), order).alias("e")
    out = bib.groupBy(*keys).agg(last).select(*keys, "e.*")
    return out.select("ord", "file_ord", "pos", "key", "entry_type", "fields", *([tie] if tie else []))


def set_field(fields: Column | str, name: str, value: Column) -> Column:
    """The map with one field set; a NULL value leaves it as it was, a NULL map becomes one of that field."""
    f = F.coalesce(lit_or_col(fields), F.create_map().cast("map<string,string>"))
    rest = F.map_filter(f, lambda k, _: k != name)
    return F.when(value.isNull(), lit_or_col(fields)).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def promoted(bib: DataFrame, names: tuple[str, ...] = ("author", "title", "year", "raw")) -> DataFrame:
    """Hot fields as columns of their own, so that a scan of the written table reads only what a query names."""
    f = F.col("fields")
    rest = F.map_filter(f, lambda k, _: ~k.isin(*names))
    return bib.withColumns({n: f[n] for n in names} | {"other_fields": rest}).drop("fields")


def get(bib: DataFrame, key: str) -> DataFrame:
    """The entries of a key."""
    return bib.filter(F.col("key") == key)


def normalized_key(fields: Column | str = "fields") -> Column:
    f = lit_or_col(fields)
    return normalize_citation_key(f["author"], f["title"], f["year"])


def arxiv_id(fields: Column | str = "fields", key: Column | str = "key") -> Column:
    return extract_arxiv_id(fields, key)


def render_entry(entry_type: Column | str, key: Column | str, fields: Column | str) -> Column:
    """BibTeX text of one entry: fields by name without ``raw``, braces dropped from values, a blank line after it."""
    entries = F.array_sort(F.map_entries(F.map_filter(lit_or_col(fields), lambda k, v: (k != "raw") & v.isNotNull())))
    lines = F.transform(
        entries, lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = {"), F.translate(e["value"], "{}", ""), F.lit("},\n"))
    )
    kind = F.coalesce(lit_or_col(entry_type), F.lit(ENTRY_TYPE))
    return F.concat(F.lit("@"), kind, F.lit("{"), lit_or_col(key), F.lit(",\n"), F.array_join(lines, ""), F.lit("}\n\n"))


def rendered(bib: DataFrame, dedup_normalized: bool = False) -> DataFrame:
    """(key, normalized_key, bibtex) of a consolidated bibliography, one row an entry.

    With ``dedup_normalized`` only the smallest original key of each normalised key is kept.
    """
    out = bib.select("key", normalized_key().alias("normalized_key"), "entry_type", "fields")
    if dedup_normalized:
        out = out.groupBy("normalized_key").agg(F.min_by(F.struct("key", "entry_type", "fields"), "key").alias("e"))
        out = out.select("e.key", "normalized_key", "e.entry_type", "e.fields")
    return out.select("key", "normalized_key", render_entry("entry_type", "normalized_key", "fields").alias("bibtex"))


def bibtex_text(bib: DataFrame, dedup_normalized: bool = False) -> DataFrame:
    """One row (bibtex): all entries by original key. The single string is the result asked for; at scale use
    ``rendered`` and write its rows."""
    parts = rendered(bib, dedup_normalized)
    ordered = F.array_sort(F.collect_list(F.struct("key", "bibtex")))
    return parts.agg(F.array_join(F.transform(ordered, lambda e: e["bibtex"]), "").alias("bibtex"))
