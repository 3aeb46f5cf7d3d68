"""Source archives: listing papers, reading mirrors, unpacking."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.errors import ApiError, NoPaperIdsProvided
from citeloom.schemas import PAPERS_IN
from citeloom.sources.latex_source import includes

TEXT_SUFFIXES = ("tex", "bbl")


def paper_list(spark: SparkSession, paper_ids: Sequence[str]) -> DataFrame:
    """(ord, paper_id) in the given order; repeated ids are kept, an empty list is an error."""
    if not paper_ids:
        raise NoPaperIdsProvided()
    return spark.createDataFrame([(i, str(p)) for i, p in enumerate(paper_ids)], PAPERS_IN)


def read_mirror(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, content) of a folder of archives named by paper id (``/`` of old ids as ``_``)."""
    raw = spark.read.format("binaryFile").load(f"{folder}/*")
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(F.regexp_replace(name, r"(\.tar\.gz|\.tgz|\.zip|\.tar)$", "").alias("paper_id"), "content")


def unpack(content: bytes) -> list[tuple[str, bytes]]:
    """(path, bytes) of an archive's files: ZIP, else tar in any compression; unsafe paths are passed over."""
    if not content:
        raise ApiError("empty archive")
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            members = [(m.filename, z.read(m)) for m in z.infolist() if not m.is_dir()]
    except zipfile.BadZipFile:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            members = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
    for name, data in members:
        path = posixpath.normpath(name)
        if not path.startswith(("/", "..")):
            out.append((path, data))
    return out


def text_members(content: bytes) -> list[tuple[str, str]]:
    """(path, text) of an archive's ``.tex`` and ``.bbl`` files, and of files of any other name that those include."""
    members = dict(unpack(content))
    texts = {p: data.decode("utf-8") for p, data in members.items() if p.rpartition(".")[2] in TEXT_SUFFIXES}
    waiting = list(texts)
    while waiting:
        for name in includes(texts[waiting.pop()]):
            path = posixpath.normpath(name)
            if path in members and path not in texts:
                texts[path] = members[path].decode("utf-8")
                waiting.append(path)
    return list(texts.items())


def read_files(archives: DataFrame, permissive: bool = False) -> DataFrame:
    """(paper_id, source, path, content, error) of (paper_id, content): the decoded texts of each archive.

    Kept are ``.tex`` and ``.bbl`` members and whatever else they include; figures never leave the task that reads the archive, and
    no archive is shuffled. ``source`` is a checksum, so that files of two archives of one paper can be told apart (``one_archive``). A text
    that is not UTF-8 and an archive that cannot be read stop the job, or with ``permissive`` give one row with an ``error`` and no
    content. Archives are not written to disk. A missing archive (NULL) counts as unreadable.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["paper_id", "source", "path", "content", "error"]
        for pdf in batches:
            rows: list[tuple] = []
            for paper, source, content in zip(pdf["paper_id"], pdf["source"], pdf["content"]):
                try:
                    found = text_members(bytes(content) if content is not None else b"")
                    rows += [(paper, source, path, text, None) for path, text in found]
                except Exception as cause:  # noqa: BLE001 - any broken archive
                    if not permissive:
                        raise
                    rows.append((paper, source, None, None, f"{type(cause).__name__}: {cause}"))
            yield pd.DataFrame(rows, columns=columns)

    summed = archives.select("paper_id", F.coalesce(F.md5("content"), F.lit("")).alias("source"), "content")
    return summed.mapInPandas(read, "paper_id string, source string, path string, content string, error string")


def one_archive(files: DataFrame) -> DataFrame:
    """``read_files`` rows of one archive a paper: of several the readable one of the smallest checksum. They are read twice: pass a written table."""
    rank = F.struct(F.col("error").isNotNull().alias("bad"), F.col("source"))
    chosen = files.groupBy("paper_id").agg(F.min(rank)["source"].alias("source"))
    return files.join(chosen, ["paper_id", "source"]).dropDuplicates(["paper_id", "path"]).drop("source")
