"""Queries of the extraction operators over the whole test tables."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.config import Options
from citeloom.functions import bbl
from citeloom.functions.text import (
    cite_keys,
    clean_text,
    clean_title,
    dblp_authors,
    dblp_query,
    is_related_title,
    truncate_bytes,
)
from citeloom.operators import bibliography, citations, rendering, sections, verification
from citeloom.plans import pipeline
from citeloom.session import materialise, table
from citeloom.sources import archive, latex_source
from citeloom.sources.bibtex import parse_bibtex
from citeloom.sources.dblp import read_hits

TIE = "entry_id"


def _joined(a: Column | str) -> Column:
    return F.array_join(a, "|", "<null>")


def clean_titles(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("fields")["title"]
    return table(spark, folder, "bib").filter(t.isNotNull()).select("entry_id", clean_text(t).alias("clean"), clean_title(t).alias("title"))


def norm_citation_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "bib").select("entry_id", bibliography.normalized_key().alias("normalized_key"))


def arxiv_id_extract(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "bib").select("entry_id", bibliography.arxiv_id().alias("arxiv_id"))
    return found.filter("arxiv_id IS NOT NULL")


def parse_bbl_entries(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.col("fields")["raw"]
    items = table(spark, folder, "bib").filter(raw.isNotNull()).select("entry_id", raw.alias("raw"))
    wrapped = F.concat(F.lit("\\begin{thebibliography}{9}\n"), F.col("raw"), F.lit("\n\\end{thebibliography}\n"))
    entries = bibliography.parse_bbl(items.select(F.col("entry_id").alias("ord"), F.lit(0).alias("file_ord"), wrapped.alias("content")))
    f = F.col("fields")
    return entries.select(
        F.col("ord").alias("entry_id"), "key", f["author"].alias("author"), f["year"].alias("year"), f["title"].alias("title")
    )


def bbl_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One ``.bbl`` text per paper and file, made of its entries' items in order; several deliveries of a position stay."""
    bib = table(spark, folder, "bib").filter(F.col("fields")["raw"].isNotNull())
    part = F.struct("pos", TIE, F.col("fields")["raw"].alias("raw"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["raw"]), "\n\n")
    text = F.concat(F.lit("\\begin{thebibliography}{9}\n"), body, F.lit("\n\\end{thebibliography}\n"))
    return bib.groupBy("ord", "file_ord").agg(text.alias("content"))


def parse_bbl_files(spark: SparkSession, folder: str) -> DataFrame:
    entries = bibliography.parse_bbl(bbl_documents(spark, folder))
    return entries.select("ord", "file_ord", "pos", "key", F.col("fields")["year"].alias("year"))


def bib_consolidate(spark: SparkSession, folder: str) -> DataFrame:
    last = bibliography.consolidate(table(spark, folder, "bib"), tie=TIE)
    return last.select("key", "entry_id", "ord", "entry_type", F.col("fields")["title"].alias("title"))


def bib_consolidate_paper(spark: SparkSession, folder: str) -> DataFrame:
    return bibliography.consolidate(table(spark, folder, "bib"), "paper", TIE).select("ord", "key", "entry_id")


def bib_promoted(spark: SparkSession, folder: str) -> DataFrame:
    tagged = bibliography.set_field("fields", "year", F.regexp_extract(F.col("fields")["year"], r"\d{4}", 0))
    wide = bibliography.promoted(table(spark, folder, "bib").select("entry_id", "key", tagged.alias("fields")))
    others = F.array_sort(F.map_keys("other_fields"))
    return wide.select("entry_id", "key", "author", "title", "year", _joined(others).alias("others"))


def cite_keys_sections(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "sections")
    return s.select("section_id", _joined(cite_keys("content")).alias("keys"))


def latex_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One LaTeX text per paper, made of its rows in (pos, section_id) order."""
    s = table(spark, folder, "sections").filter("content IS NOT NULL")
    text = F.concat(F.lit("\\"), F.col("kind"), F.lit("{"), F.coalesce("title", F.lit("")), F.lit("}\n"), F.col("content"), F.lit("\n\n"))
    part = F.struct("pos", "section_id", text.alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "")
    return s.groupBy("ord", "paper_id").agg(body.alias("latex"))


def related_sections(spark: SparkSession, folder: str) -> DataFrame:
    found = sections.extract_sections(latex_documents(spark, folder))
    return found.select("ord", "kind", "pos", "title", F.md5("content").alias("content_md5"), _joined("citations").alias("citations"))


def related_titles(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "sections")
    return s.groupBy("title").agg(F.count("*").alias("n"), F.first(is_related_title("title")).alias("related"))


def normalize_citations(spark: SparkSession, folder: str) -> DataFrame:
    bib = bibliography.consolidate(table(spark, folder, "bib"), tie=TIE)
    done = citations.rewrite(table(spark, folder, "sections"), citations.key_map(bib), "section_id")
    return done.select("section_id", F.md5("normalized").alias("normalized_md5"))


def missing_citations(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "sections").select(cite_keys("content").alias("citations"))
    return citations.missing(s, bibliography.consolidate(table(spark, folder, "bib"), tie=TIE))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """Bibliography rows under their own identifier as key."""
    b = table(spark, folder, "bib")
    return b.select(F.col("entry_id").alias("key"), "fields", bibliography.arxiv_id().alias("arxiv_id"), "entry_type")


def dblp_best_match(spark: SparkSession, folder: str) -> DataFrame:
    best = verification.search_matches(_entries(spark, folder), table(spark, folder, "dblp"))
    return best.select(F.col("key").alias("entry_id"), F.col("info.url").alias("url"), "score")


def dblp_json_hits(spark: SparkSession, folder: str) -> DataFrame:
    hit = F.struct(F.array(F.struct("info")).alias("hit"), F.lit("1").alias("@total"))
    response = F.to_json(F.struct(F.struct(hit.alias("hits")).alias("result")))
    responses = table(spark, folder, "dblp").select(F.col("hit_id").alias("key"), response.alias("json"))
    found = read_hits(responses)
    names = F.transform("info.authors.author", lambda a: a["text"])
    return found.select(
        F.col("key").alias("hit_id"),
        F.col("info.title").alias("title"),
        dblp_query("info.title").alias("query"),
        F.when(F.size(names) > 0, dblp_authors(names)).alias("authors"),
    )


def arxiv_answers(spark: SparkSession, folder: str) -> DataFrame:
    """arXiv BibTeX for the ids that entries name, made of the last entry that names each."""
    b = table(spark, folder, "bib").withColumn("arxiv_id", bibliography.arxiv_id()).filter("arxiv_id IS NOT NULL")
    f = F.col("fields")
    last = b.filter(f["title"].isNotNull() & f["author"].isNotNull()).groupBy("arxiv_id").agg(
        F.max_by(F.struct(f["title"].alias("t"), f["author"].alias("a"), f["year"].alias("y")), "entry_id").alias("e")
    )
    clean = lambda c: F.translate(c, "{}\\\"", "")
    text = F.concat(
        F.lit("@misc{"), F.col("arxiv_id"), F.lit(",\n  title = {"), clean(F.col("e.t")), F.lit("},\n  author = \""),
        clean(F.col("e.a")), F.lit("\",\n  year = "), F.coalesce(F.regexp_extract("e.y", r"\d{4}", 0), F.lit("")),
        F.lit("\n}\n"),
    )
    return last.select("arxiv_id", text.alias("bibtex"))


def bibtex_parse(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_bibtex(arxiv_answers(spark, folder), "bibtex")
    f = F.col("entry.fields")
    return parsed.select(
        "arxiv_id", F.col("entry.key").alias("key"), F.col("entry.entry_type").alias("entry_type"),
        f["title"].alias("title"), f["author"].alias("author"), f["year"].alias("year"),
    )


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    return verification.verify(entries, arxiv_answers(spark, folder), records=table(spark, folder, "dblp"))


def verify_merge(spark: SparkSession, folder: str) -> DataFrame:
    f = F.col("fields")
    return _verified(spark, folder).select(
        F.col("key").alias("entry_id"), "verified", f["verified_source"].alias("source"), f["title"].alias("title"),
        f["author"].alias("author"), f["year"].alias("year"), f["booktitle"].alias("booktitle"), f["doi"].alias("doi"),
    )


def verify_stats(spark: SparkSession, folder: str) -> DataFrame:
    return verification.stats(_verified(spark, folder))


def paper_files(spark: SparkSession, folder: str) -> DataFrame:
    """Source files per paper: a root that includes one file per section, in (pos, section_id) order."""
    s = table(spark, folder, "sections").filter("content IS NOT NULL")
    name = F.concat(F.lit("sec/s"), F.col("section_id").cast("string"))
    leaves = s.select("ord", "paper_id", F.concat(name, F.lit(".tex")).alias("path"), "content")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "section_id", name.alias("name"))))
    lines = F.array_join(F.transform(ordered, lambda p: F.concat(F.lit("\\input{"), p["name"], F.lit("}"))), "\n")
    root = F.when(F.col("ord") % 3 == 0, "main.tex").when(F.col("ord") % 3 == 1, "zz.tex").otherwise("article.tex")
    roots = s.groupBy("ord", "paper_id").agg(F.concat(F.lit("\\documentclass{article}\n"), lines).alias("content"))
    return roots.select("ord", "paper_id", root.alias("path"), "content").unionByName(leaves)


def main_tex_choice(spark: SparkSession, folder: str) -> DataFrame:
    return latex_source.main_files(paper_files(spark, folder))


def include_expand(spark: SparkSession, folder: str) -> DataFrame:
    latex = latex_source.expand_includes(paper_files(spark, folder))
    return latex.select("ord", "paper_id", F.md5("latex").alias("latex_md5"), F.length("latex").alias("size"))


def included_files(spark: SparkSession, folder: str) -> DataFrame:
    latex = latex_source.expand_includes(paper_files(spark, folder))
    return latex.select("ord", "paper_id", _joined("included").alias("included"))


def pack(files: DataFrame) -> DataFrame:
    """(paper_id, content): (ord, paper_id, path, content) files in ZIP archives or (papers of an even number) compressed tars, figures beside them."""

    @F.pandas_udf("binary")
    def packed(number: pd.Series, files: pd.Series) -> pd.Series:
        out = []
        for n, members in zip(number, files):
            data = {m["path"]: m["content"].encode() for m in members} | {"fig/a.png": b"\xff\xd8", "../outside.tex": b"no"}
            held = io.BytesIO()
            if n % 2:
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for path, text in data.items():
                        z.writestr(path, text)
            else:
                with tarfile.open(fileobj=held, mode="w:gz", compresslevel=1) as t:
                    for path, text in data.items():
                        info = tarfile.TarInfo(path)
                        info.size = len(text)
                        t.addfile(info, io.BytesIO(text))
            out.append(held.getvalue())
        return pd.Series(out)

    grouped = files.groupBy("ord", "paper_id").agg(F.collect_list(F.struct("path", "content")).alias("files"))
    return grouped.select("paper_id", packed("ord", "files").alias("content"))


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    files = archive.one_archive(materialise(archive.read_files(pack(paper_files(spark, folder))), "texts"))
    return files.select("paper_id", "path", F.md5("content").alias("content_md5"))


def described_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with the title and authors that a BibTeX text of theirs gives; papers of an even number have none."""
    papers = _last_papers(spark, folder)

    def field(column: str, name: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(f",\n  {name} = {{ "), F.col(column), F.lit(" }"))).otherwise("")

    text = F.concat(F.lit("@misc{x"), field("title", "title"), field("authors", "author"), F.lit("\n}"))
    answers = papers.filter("ord % 2 = 1").select(F.col("paper_id").alias("arxiv_id"), text.alias("bibtex"))
    return latex_source.with_metadata(papers.select("ord", "paper_id"), answers)


def search_answers(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
    """(query, json): what a search service would say to the entries' searches: the records of that title, by ``hit_id``.

    Searches of an even number of characters also get a hit without a year, which voids all others.
    """
    asked = entries.select(dblp_query(F.col("fields")["title"]).alias("query")).filter("query <> ''").distinct()
    asked = asked.withColumn("t", clean_text(F.translate("query", "+", " "))).filter("t <> ''")
    records = table(spark, folder, "dblp").select("hit_id", "info", clean_text("info.title").alias("t"))
    hits = asked.join(records, "t").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("hit_id", "info"))).alias("h"))
    listed = F.transform("h", lambda h: F.struct(h["info"].alias("info")))
    void = F.transform(F.slice("h", 1, 1), lambda h: F.struct(h["info"].withField("year", F.lit(None).cast("string")).alias("info")))
    listed = F.when(F.length("query") % 2 == 0, F.concat(listed, void)).otherwise(listed)
    found = F.struct(listed.alias("hit"), F.size(listed).cast("string").alias("@total"))
    return hits.select("query", F.to_json(F.struct(F.struct(found.alias("hits")).alias("result"))).alias("json"))


def verify_by_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every paper's own entries against arXiv's and DBLP's answers, which meet them by id and by search."""
    entries = bibliography.consolidate(table(spark, folder, "bib"), "paper", TIE).drop(TIE)
    sources = pipeline.Sources(arxiv=arxiv_answers(spark, folder), answers=search_answers(spark, folder, entries), offline=True)
    f = F.col("fields")
    return pipeline.verified(entries, sources, Options()).select(
        "ord", "key", "verified", f["verified_source"].alias("source"), f["title"].alias("title"), f["year"].alias("year")
    )


def bbl_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The ``.bbl`` files of every paper, in whatever folder, numbered by path; other endings and cases are none."""
    named = paper_files(spark, folder).withColumn("path", F.when(F.col("path").startswith("sec/"), F.regexp_replace("path", r"\d\.tex$", ".bbl")).otherwise(F.col("path")))
    cased = named.withColumn("path", F.when(F.col("ord") % 5 == 0, F.regexp_replace("path", r"\.bbl$", ".BBL")).otherwise(F.col("path")))
    return latex_source.bbl_files(cased.dropDuplicates(["ord", "path"])).select("ord", "paper_id", "file_ord", "path")


def bib_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the key that most papers use."""
    return bibliography.get(table(spark, folder, "bib"), "b1").select("entry_id", "ord", "entry_type")


def whole_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``packed_archives`` with headings over the sections and the papers' ``.bbl`` files."""
    head = F.concat(F.lit("\\"), F.col("kind"), F.lit("{"), F.coalesce("title", F.lit("")), F.lit("}\n"))
    s = table(spark, folder, "sections").filter("content IS NOT NULL")
    heads = s.select("ord", F.concat(F.lit("sec/s"), F.col("section_id").cast("string"), F.lit(".tex")).alias("path"), head.alias("head"))
    files = paper_files(spark, folder).join(heads, ["ord", "path"], "left")
    files = files.select("ord", "paper_id", "path", F.concat(F.coalesce("head", F.lit("")), "content").alias("content"))
    bbl = bbl_documents(spark, folder).join(s.select("ord", "paper_id").distinct(), "ord")
    path = F.concat(F.lit("out/f"), F.lpad(F.col("file_ord").cast("string"), 4, "0"), F.lit(".bbl"))
    return pack(files.unionByName(bbl.select("ord", "paper_id", path.alias("path"), "content")))


def survey_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The whole way: archives to the survey text of each paper, citations rewritten against all papers' bibliographies."""
    papers = table(spark, folder, "sections").filter("content IS NOT NULL").select("ord", "paper_id").distinct()
    text = lambda c, name: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name} = {{ "), F.col(c), F.lit(" }\n"))).otherwise("")
    told = _last_papers(spark, folder).select(F.col("paper_id").alias("arxiv_id"), F.concat(text("title", "title"), text("authors", "author")).alias("bibtex"))
    archives = materialise(whole_archives(spark, folder), "archives")
    parts = pipeline.build(papers, archives, told).survey_parts()
    return parts.select("ord", "paper_id", F.md5("part").alias("part_md5"), F.length("part").alias("size"))


def bibtex_render(spark: SparkSession, folder: str) -> DataFrame:
    return bibliography.rendered(bibliography.consolidate(table(spark, folder, "bib"), tie=TIE))


def _last_papers(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "papers").groupBy("ord", "paper_id").agg(
        F.max_by(F.struct("title", "authors"), F.struct("loaded_at", "fetched_at")).alias("p")
    )
    return papers.select("ord", "paper_id", "p.*")


def survey_render(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "sections")
    last = s.groupBy("ord", "paper_id", "kind", "pos").agg(F.max_by(F.struct("title", "content"), "section_id").alias("s"))
    parts = rendering.survey_parts(
        _last_papers(spark, folder), last.select("ord", "kind", "pos", "s.title", F.col("s.content").alias("normalized"))
    )
    return parts.select("ord", "paper_id", F.md5("part").alias("part_md5"), F.length("part").alias("size"))


def paper_metadata(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "papers").select("ord", "paper_id", "loaded_at", truncate_bytes("title", 60).alias("title"))
    return p.select("ord", "paper_id", F.unix_micros("loaded_at").alias("loaded_us"), "title")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Related sections of every paper with citations rewritten against the consolidated bibliography."""
    found = sections.extract_sections(latex_documents(spark, folder))
    bib = bibliography.consolidate(table(spark, folder, "bib"), tie=TIE)
    done = citations.rewrite(found, citations.key_map(bib), ("ord", "paper_id", "kind", "pos"))
    return done.select("ord", "paper_id", "kind", "pos", "title", "normalized")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clean_titles,
        norm_citation_key,
        arxiv_id_extract,
        parse_bbl_entries,
        parse_bbl_files,
        bib_consolidate,
        bib_consolidate_paper,
        bib_promoted,
        cite_keys_sections,
        related_sections,
        related_titles,
        normalize_citations,
        missing_citations,
        dblp_best_match,
        dblp_json_hits,
        bibtex_parse,
        verify_merge,
        verify_stats,
        main_tex_choice,
        include_expand,
        included_files,
        archive_files,
        described_papers,
        verify_by_search,
        bbl_scan,
        bib_lookup,
        survey_pipeline,
        bibtex_render,
        survey_render,
        paper_metadata,
    )
}
