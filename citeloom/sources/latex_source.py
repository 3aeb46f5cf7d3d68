"""From the files of a paper to one LaTeX text, its bibliography files and its metadata."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import UNICODE, trim_ws, truncate_bytes

# Fixed values.
ROOT_NAMES = ("main.tex", "paper.tex", "article.tex", "manuscript.tex")
UNKNOWN_TITLE, UNKNOWN_AUTHORS = "Unknown Title", "Unknown Authors"
DEEPEST = 2
INCLUDE = r"\\(?:input|include)\{([^}]+)\}"
METADATA = r"\s*=\s*\{([\s\S]*?)\}"

_INCLUDE = re.compile(INCLUDE)


def includes(text: str) -> list[str]:
    """The names that a text includes, in order."""
    return _INCLUDE.findall(text)


def main_files(files: DataFrame) -> DataFrame:
    """(ord, paper_id, path) of each paper's root document.

    A root-level file of a usual name goes first, in their order; then the first ``.tex`` file (by path) at most one
    folder deep that has ``\\documentclass``; then the first such file of any kind. Papers without one have no row.
    """
    tex = files.filter(F.col("path").endswith(".tex") & (F.size(F.split("path", "/")) <= DEEPEST))
    rank = F.when(F.col("content").contains("\\documentclass"), 10).otherwise(20)
    for i, name in reversed(list(enumerate(ROOT_NAMES))):
        rank = F.when(F.col("path") == name, i).otherwise(rank)
    return tex.groupBy("ord", "paper_id").agg(F.min_by("path", F.struct(rank.alias("r"), F.col("path"))).alias("path"))


def expand(texts: dict[str, str], root: str) -> str:
    """The text of ``root`` with each included file put in once, depth first; other references become nothing."""
    return expand_listed(texts, root)[0]


def expand_listed(texts: dict[str, str], root: str) -> tuple[str, list[str]]:
    """``expand`` and the paths of the included files, in the order in which they are met (the root is not one)."""
    done: dict[str, None] = {}

    def find(name: str) -> str | None:
        path = posixpath.normpath(name)
        for p in (path, path if path.endswith(".tex") else path + ".tex"):
            if p in texts:
                return p
        return None

    out: list[str] = []
    stack: list[tuple[str, Iterator[re.Match], int]] = []

    def enter(path: str) -> None:
        done[path] = None
        stack.append((path, _INCLUDE.finditer(texts[path]), 0))

    enter(root)
    while stack:  # a stack of our own: includes may be nested deeper than Python's
        path, found, at = stack.pop()
        m = next(found, None)
        if m is None:
            out.append(texts[path][at:])
            continue
        out.append(texts[path][at : m.start()])
        stack.append((path, found, m.end()))
        target = find(m.group(1))
        if target is not None and target not in done:
            enter(target)
    return "".join(out), list(done)[1:]


def expand_includes(files: DataFrame) -> DataFrame:
    """(ord, paper_id, latex, included): the expanded root document of every paper that has one, and the files it took in.

    References are resolved among the paper's own files only. All files of a paper meet in one task; a paper is
    bounded by its archive.
    """
    tex = files.filter(F.col("content").isNotNull())
    rows = tex.groupBy("ord", "paper_id").agg(F.collect_list(F.struct("path", "content")).alias("files"))
    rows = rows.join(main_files(files).withColumnRenamed("path", "root"), ["ord", "paper_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [
                expand_listed({f["path"]: f["content"] for f in found}, root) for found, root in zip(pdf["files"], pdf["root"])
            ]
            out = pdf[["ord", "paper_id"]]
            yield out.assign(latex=[text for text, _ in done], included=[paths for _, paths in done])

    return rows.mapInPandas(run, "ord int, paper_id string, latex string, included array<string>")


def bbl_files(files: DataFrame) -> DataFrame:
    """(ord, paper_id, file_ord, path, content) of the ``.bbl`` files, numbered by path within a paper."""
    kept = files.filter(F.col("path").endswith(".bbl"))
    order = Window.partitionBy("ord", "paper_id").orderBy("path")
    return kept.withColumn("file_ord", F.row_number().over(order) - 1).select("ord", "paper_id", "file_ord", "path", "content")


def _metadata_field(bibtex: Column, name: str, default: str) -> Column:
    """The value, trimmed and cut; an empty value stays empty, as only a missing one has a default."""
    pattern = UNICODE + name + METADATA
    value = F.when(bibtex.rlike(pattern), trim_ws(F.regexp_extract(bibtex, pattern, 1)))
    return F.coalesce(truncate_bytes(value), F.lit(default))


def with_metadata(papers: DataFrame, arxiv: DataFrame | None) -> DataFrame:
    """``papers`` (ord, paper_id) with title and authors from the arXiv BibTeX table (arxiv_id, bibtex).

    Values over 100 bytes are cut; missing ones get the usual defaults. ``described`` is false where the table has no text at all.
    """
    if arxiv is None:
        arxiv = papers.select(F.col("paper_id").alias("arxiv_id"), F.lit(None).cast("string").alias("bibtex"))
    one = arxiv.groupBy(F.col("arxiv_id").alias("paper_id")).agg(F.min("bibtex").alias("bibtex"))
    return papers.join(one, "paper_id", "left").select(
        "ord",
        "paper_id",
        _metadata_field(F.col("bibtex"), "title", UNKNOWN_TITLE).alias("title"),
        _metadata_field(F.col("bibtex"), "author", UNKNOWN_AUTHORS).alias("authors"),
        F.col("bibtex").isNotNull().alias("described"),
    )
