"""Verifying entries against arXiv and DBLP tables, and merging what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import dblp_authors
from citeloom.operators.similarity import similar_sets, word_set
from citeloom.operators.skew import split_join
from citeloom.session import materialise
from citeloom.sources.bibtex import parse_bibtex

# The scores of a hit.
YEAR_EQUAL, TITLE_EQUAL, TITLE_WITHIN, TITLE_WORDS, AUTHOR_WORDS = 1, 3, 2, 1, 2
SHARED_TITLE_WORDS, SHARED_AUTHOR_WORDS, LEAST_SCORE = 2, 5, 2


def _words(x: Column, pattern: str) -> Column:
    return F.filter(F.split(x, pattern), lambda w: w != "")


def _shared(a: Column, b: Column) -> Column:
    """Words of ``a`` (with repeats) that ``b`` contains."""
    return F.size(F.filter(a, lambda w: F.array_contains(b, w)))


def match_score(title: Column, year: Column, author: Column, h_title: Column, h_year: Column, h_names: Column) -> Column:
    """Score of a DBLP hit for an entry; every argument but the hit's names must be present."""
    mine = F.translate(F.lower(title), "{}", "")
    theirs = F.lower(h_title)
    white = r"\p{IsWhite_Space}+"
    titles = (
        F.when(mine == theirs, TITLE_EQUAL)
        .when(mine.contains(theirs) | theirs.contains(mine), TITLE_WITHIN)
        .when(_shared(_words(mine, white), _words(theirs, white)) > SHARED_TITLE_WORDS, TITLE_WORDS)
        .otherwise(0)
    )
    authors = F.when(
        _shared(_words(author, "[ ~]"), _words(h_names, "[ ~]")) >= SHARED_AUTHOR_WORDS, AUTHOR_WORDS
    ).otherwise(0)
    return F.when(year == h_year, YEAR_EQUAL).otherwise(0) + titles + F.coalesce(authors, F.lit(0))


def _asked(entries: DataFrame, *more: str) -> DataFrame:
    """key, title, year, author (and ``more``) of the entries that can be searched: those with all three."""
    f = F.col("fields")
    names = ("title", "year", "author")
    return entries.select("key", *more, *[f[x].alias(x) for x in names]).filter(" AND ".join(f"{x} IS NOT NULL" for x in names))


def _compared(hits: DataFrame, *ids: str) -> DataFrame:
    """What a hit is scored by, without the rest of its record."""
    names = F.filter(F.transform(F.col("info.authors.author"), lambda a: a["text"]), lambda t: t.isNotNull())
    return hits.select(
        *ids, F.col("info.title").alias("h_title"), F.col("info.year").alias("h_year"), F.array_join(names, " and ").alias("h_names")
    )


def _best(pairs: DataFrame) -> DataFrame:
    """(key, hit_pos, score) of the best hit, the first of equals; none if a hit of the entry lacks title or year."""
    score = match_score(*[F.col(c) for c in ("title", "year", "author", "h_title", "h_year", "h_names")])
    scored = pairs.select("key", "hit_pos", score.alias("score"), (F.col("h_title").isNull() | F.col("h_year").isNull()).alias("broken"))
    best = scored.groupBy("key").agg(
        F.max_by(F.struct("hit_pos", "score"), F.struct("score", -F.col("hit_pos"))).alias("b"), F.bool_or("broken").alias("broken")
    )
    return best.filter(~F.col("broken") & (F.col("b.score") >= LEAST_SCORE)).select("key", "b.hit_pos", "b.score")


def best_matches(entries: DataFrame, hits: DataFrame, on: str = "key") -> DataFrame:
    """(key, info, score): the best hit of each entry, the first of equals, if it scores at least ``LEAST_SCORE``.

    ``entries`` has (key, fields) and the column ``on``, by which it meets ``hits`` (``on``, hit_pos, info): its key or, for answers that
    several entries share, its query. Entries lacking title, year or author match nothing, and neither does an entry one of whose
    hits lacks title or year. Keys must be unique in ``entries``, positions among the hits of one ``on``.
    """
    more = () if on == "key" else (on,)
    asked, compared = _asked(entries, *more), _compared(hits, on, "hit_pos")
    # A search that many entries share holds many rows; a key holds one.
    best = _best(split_join(materialise(asked, "searched"), materialise(compared, "hits"), on) if more else asked.join(compared, on))
    named = best if on == "key" else best.join(entries.select("key", on), "key")
    return named.join(hits.select(on, "hit_pos", "info"), [on, "hit_pos"]).select("key", "info", "score")


#: Word-set similarity of the titles from which a record of a local table answers a search.
SEARCH_SIMILARITY = 0.5


def search_matches(entries: DataFrame, records: DataFrame, least: float = SEARCH_SIMILARITY) -> DataFrame:
    """(key, info, score): ``best_matches`` where a table of (hit_id, info) stands for the search service.

    A record answers an entry if the sets of their title words have a Jaccard similarity of ``least`` or more; all such
    records are found and scored. Titles are compared once, only keys, titles, years and names are shuffled, and the records of
    the winners are fetched last. Equal scores go to the smaller ``hit_id``. Titles without a letter or digit match nothing.
    """
    asked = materialise(_asked(entries).withColumn("a", word_set("title")).filter("size(a) > 0"), "asked")
    held = _compared(records, "hit_id").withColumnRenamed("hit_id", "hit_pos").withColumn("b", word_set("h_title")).filter("size(b) > 0")
    held = materialise(held, "held")
    near = similar_sets(asked.select(F.col("a").alias("words")), held.select(F.col("b").alias("words")), least)
    # The records of each title go to the titles like it, and from there to the entries.
    offered = materialise(near.join(held, "b").drop("b"), "offered")
    best = _best(split_join(asked, offered, "a"))
    return best.join(records.select(F.col("hit_id").alias("hit_pos"), "info"), "hit_pos").select("key", "info", "score")


def dblp_fields(info: Column) -> Column:
    """MAP of the fields a matched hit contributes."""
    names = F.filter(F.transform(info["authors"]["author"], lambda a: a["text"]), lambda t: t.isNotNull())
    values = {
        "title": info["title"],
        "year": info["year"],
        "booktitle": info["venue"],
        "url": info["url"],
        "volume": info["volume"],
        "doi": info["doi"],
        "author": F.when(F.size(names) > 0, dblp_authors(names)),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def merged(fields: Column, verified: Column, source: Column) -> Column:
    """Fields with the verified ones written over them, ``raw`` kept, the source noted."""
    base = F.map_filter(fields, lambda k, _: (k != "verified_source") & ~F.coalesce(F.map_contains_key(verified, k) & (k != "raw"), F.lit(False)))
    new = F.map_filter(verified, lambda k, _: (k != "raw") & (k != "verified_source"))
    tagged = F.map_concat(base, new, F.create_map(F.lit("verified_source"), source))
    return F.when(verified.isNotNull(), tagged).otherwise(fields)


def verify(
    entries: DataFrame, arxiv: DataFrame | None, hits: DataFrame | None = None, records: DataFrame | None = None, on: str = "key"
) -> DataFrame:
    """``entries`` with verified fields: arXiv before DBLP before as it was; key and type never change.

    Input (key, arxiv_id, fields, …) with unique keys; ``arxiv`` has (arxiv_id, bibtex). DBLP is either ``hits`` (``on``, hit_pos,
    info), the answers to the entries' searches, or ``records`` (hit_id, info), a table to search. Entries that arXiv answers are not
    searched. Of several answers for one id the first by text counts. Adds ``verified`` (boolean).
    """
    none = entries.select("key", F.lit(None).cast("map<string,string>").alias("_v"), F.lit("").alias("_source")).filter("false")
    found, open_ = none, entries
    if arxiv is not None:
        one = arxiv.groupBy("arxiv_id").agg(F.min("bibtex").alias("bibtex"))
        answers = parse_bibtex(one, "bibtex").select("arxiv_id", F.col("entry.fields").alias("_v")).filter("_v IS NOT NULL")
        answers = materialise(answers, "answers")
        found = entries.select("key", "arxiv_id").join(answers, "arxiv_id").select("key", "_v", F.lit("arXiv").alias("_source"))
        open_ = entries.join(answers.select("arxiv_id"), "arxiv_id", "left_anti")
    if hits is not None or records is not None:
        best = best_matches(open_, hits, on) if hits is not None else search_matches(open_, records)
        found = found.unionByName(best.select("key", dblp_fields(F.col("info")).alias("_v"), F.lit("DBLP").alias("_source")))
    # An entry has one answer at most, so its whole row moves once.
    return entries.join(found, "key", "left").select(
        *[F.col(c) for c in entries.columns if c != "fields"],
        merged(F.col("fields"), F.col("_v"), F.col("_source")).alias("fields"),
        F.col("_v").isNotNull().alias("verified"),
    ).select(*entries.columns, "verified")


def stats(verified: DataFrame) -> DataFrame:
    """(entries, verified, from_arxiv, from_dblp) counts."""
    source = F.col("fields")["verified_source"]
    return verified.agg(
        F.count("*").alias("entries"),
        F.count_if("verified").alias("verified"),
        F.count_if(F.col("verified") & (source == "arXiv")).alias("from_arxiv"),
        F.count_if(F.col("verified") & (source == "DBLP")).alias("from_dblp"),
    )
