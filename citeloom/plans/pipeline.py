"""The whole way from archives to survey text and BibTeX."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.config import Options
from citeloom.errors import ApiError, wrapped
from citeloom.functions.text import dblp_query
from citeloom.operators import bibliography, citations, rendering, sections, verification
from citeloom.session import materialise
from citeloom.sources import archive, dblp, fetch, latex_source
from citeloom.sources.bibtex import parse_bibtex


@dataclass
class Corpus:
    """The tables of a run, written once each; all can be queried on their own."""

    papers: DataFrame
    files: DataFrame
    sections: DataFrame
    bib: DataFrame
    normalized: DataFrame

    def survey_parts(self) -> DataFrame:
        return rendering.survey_parts(self.papers, self.normalized)

    def register(self, spark: SparkSession) -> None:
        """Temporary views for SQL."""
        for name in ("papers", "files", "sections", "bib", "normalized"):
            getattr(self, name).createOrReplaceTempView(name)


@dataclass
class Sources:
    """Where archives and answers come from: a table, or for None (unless ``offline``) the online service.

    ``archives`` has (paper_id, content); ``arxiv`` (arxiv_id, bibtex) describes papers and verifies entries; DBLP is ``answers`` (query,
    json) to searches, or ``records`` (hit_id, info) to search in. What is fetched is written, so nothing is asked for twice.
    """

    archives: DataFrame | None = None
    arxiv: DataFrame | None = None
    answers: DataFrame | None = None
    records: DataFrame | None = None
    offline: bool = False
    get: Callable[[str], bytes] = fetch.http_get

    def archives_of(self, papers: DataFrame, options: Options) -> DataFrame:
        if self.archives is not None:
            return self.archives
        if self.offline:
            raise ApiError("No archives given")
        return materialise(fetch.archives(papers, options, self.get), "archives")

    def metadata_of(self, papers: DataFrame, options: Options) -> DataFrame | None:
        """(arxiv_id, bibtex) of papers."""
        if self.arxiv is not None or self.offline:
            return self.arxiv
        return materialise(fetch.metadata(papers.selectExpr("paper_id AS arxiv_id"), options, self.get), "metadata")

    def bibtex_of(self, ids: DataFrame, options: Options) -> DataFrame | None:
        """(arxiv_id, bibtex) of the ids that entries name."""
        if self.arxiv is not None or self.offline:
            return self.arxiv
        return materialise(fetch.bibtex(ids, options, self.get), "bibtex")

    def hits_of(self, queries: DataFrame, options: Options) -> DataFrame | None:
        """(query, hit_pos, info): the hits of distinct searches; None where records are searched or nothing is known."""
        if self.records is not None or (self.answers is None and self.offline):
            return None
        found = self.answers
        if found is None:
            found = materialise(fetch.dblp(queries, options, self.get), "answers")
        one = found.groupBy("query").agg(F.min("json").alias("json"))
        return dblp.read_hits(one, "query")


def files_of(papers: DataFrame, sources: Sources, options: Options) -> DataFrame:
    """``files`` rows (with ``error``) of the asked papers: each archive is unpacked where it is read, once a paper."""
    asked = papers.select("paper_id").distinct()
    archives = sources.archives_of(papers, options)
    # No archive moves: the ids are broadcast where Spark measures them small, and only texts are shuffled later.
    kept = archives.join(asked, "paper_id", "left_semi").select("paper_id", "content")
    lacking = asked.join(archives.select("paper_id"), "paper_id", "left_anti").select("paper_id", F.lit(None).cast("binary").alias("content"))
    read = materialise(archive.read_files(kept, options.permissive), "texts")
    if not options.permissive and (none := lacking.first()) is not None:
        raise ApiError(f"No source for {none['paper_id']}")
    if options.permissive:
        read = read.unionByName(archive.read_files(lacking, True))
    return materialise(papers.select("ord", "paper_id").join(archive.one_archive(read), "paper_id"), "files")


def verified(entries: DataFrame, sources: Sources, options: Options) -> DataFrame:
    """Entries (ord, file_ord, pos, key, entry_type, fields; keys unique in an ``ord``) with what arXiv and DBLP say of them.

    Each arXiv id and each DBLP search (by the title as it is sent) is asked for once, however many entries share it; the answers meet
    the entries by id and by search, never by the cite key, which different works share. Entries that arXiv answers are not searched.
    """
    asked = entries.select(
        F.struct("ord", "key").alias("key"),
        bibliography.arxiv_id().alias("arxiv_id"),
        dblp_query(F.col("fields")["title"]).alias("query"),
        "file_ord", "pos", "entry_type", "fields",
    )
    asked = materialise(asked, "asked")
    arxiv = sources.bibtex_of(asked.select("arxiv_id").filter("arxiv_id IS NOT NULL").distinct(), options)
    searched = asked.filter("query <> ''")
    if arxiv is not None:
        readable = parse_bibtex(arxiv.select("arxiv_id", "bibtex"), "bibtex").filter("entry IS NOT NULL").select("arxiv_id")
        searched = searched.join(readable, "arxiv_id", "left_anti")
    hits = sources.hits_of(searched.select("query").distinct(), options)
    checked = verification.verify(asked, arxiv, hits, sources.records if hits is None else None, "query")
    return checked.select("key.ord", "file_ord", "pos", "key.key", "entry_type", "fields", "verified")


def build(
    papers: DataFrame,
    archives: DataFrame | None,
    arxiv: DataFrame | None,
    answers: DataFrame | None = None,
    options: Options | None = None,
    sources: Sources | None = None,
) -> Corpus:
    """Corpus of (ord, paper_id) papers from (paper_id, content) archives; see ``Sources`` for the tables.

    Entries are verified before papers are merged. Without ``sources`` nothing is fetched.
    """
    options = options or Options()
    sources = sources or Sources(archives, arxiv, answers, offline=True)
    files = files_of(papers, sources, options)
    described = latex_source.with_metadata(papers, sources.metadata_of(papers, options))
    if not options.permissive and (silent := described.filter("NOT described").first()) is not None:
        raise ApiError(f"Failed to download BibTeX of {silent['paper_id']}")
    latex = latex_source.expand_includes(files)
    found = materialise(sections.extract_sections(latex, options.starred, options.extended_cites), "sections")
    entries = bibliography.consolidate(bibliography.parse_bbl(latex_source.bbl_files(files), options), "paper")
    checked = verified(entries, sources, options).drop("verified")
    bib = materialise(bibliography.consolidate(checked, options.scope), "bib")
    if options.scope == "global":
        normalized = citations.rewrite(found, citations.key_map(bib), ("ord", "kind", "pos"), options.extended_cites)
    else:
        normalized = _rewrite_per_paper(found, bib)
    return Corpus(described.drop("described"), files, found, bib, normalized)


def _rewrite_per_paper(found: DataFrame, bib: DataFrame) -> DataFrame:
    """Rewriting where each paper has its own keys: one small map a paper, without mixing papers."""
    pair = F.struct("key", bibliography.normalized_key().alias("value"))
    maps = bib.filter("key IS NOT NULL").groupBy("ord").agg(F.map_from_entries(F.collect_list(pair)).alias("_map"))
    empty = F.create_map().cast("map<string,string>")
    joined = found.join(maps, "ord", "left")
    return joined.withColumn(
        "normalized", citations.rewrite_with_map("content", F.coalesce("_map", empty))
    ).drop("_map")


def extract_survey(
    spark: SparkSession,
    paper_ids: Sequence[str],
    archives: DataFrame | None = None,
    arxiv: DataFrame | None = None,
    answers: DataFrame | None = None,
    options: Options | None = None,
    sources: Sources | None = None,
) -> dict[str, str]:
    """``{"survey_text", "bibtex"}`` of the papers, in input order.

    Empty input raises ``NoPaperIdsProvided``; a paper without an archive, root document or description raises ``ApiError`` (unless
    ``permissive``); other failures, those of tasks too, arrive as the library's errors.
    """
    options = options or Options()
    papers = archive.paper_list(spark, paper_ids)
    try:
        corpus = build(papers, archives, arxiv, answers, options, sources)
        if not options.permissive:
            rootless = papers.join(latex_source.main_files(corpus.files), ["ord", "paper_id"], "left_anti").first()
            if rootless is not None:
                raise ApiError(f"No LaTeX main file found in {rootless['paper_id']}")
        text = rendering.survey_text(corpus.survey_parts()).first()["survey_text"]
        bib = bibliography.bibtex_text(corpus.bib, options.dedup_normalized).first()["bibtex"]
    except Exception as cause:  # noqa: BLE001
        raise wrapped(cause) from cause
    return {"survey_text": text, "bibtex": bib}
