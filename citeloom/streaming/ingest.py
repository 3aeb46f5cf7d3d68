"""Archives that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom.operators import bibliography, sections
from citeloom.sources import archive, latex_source

BINARY_FILES = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def watch(spark: SparkSession, folder: str, files_per_batch: int = 200) -> DataFrame:
    """Stream of (paper_id, content, arrived) of the archives that appear in a folder."""
    raw = (
        spark.readStream.format("binaryFile").schema(BINARY_FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(
        F.regexp_replace(name, r"(\.tar\.gz|\.tgz|\.zip|\.tar)$", "").alias("paper_id"),
        "content",
        F.col("modificationTime").alias("arrived"),
    )


def ingest(stream: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes ``files``, ``sections`` and ``bib`` rows of arriving archives below ``out``, a folder per batch.

    A batch that is run again after a failure overwrites its own folder, so every archive counts once. Broken
    archives go to ``errors`` and stop nothing. Papers have ``ord`` 0 within a batch; merge by ``paper_id``.
    """

    def write(batch: DataFrame, number: int) -> None:
        # The texts are written, not kept by executors: archives are unpacked once even if an executor is lost.
        path, spark = f"{out}/files/batch={number}", batch.sparkSession
        archive.read_files(batch, permissive=True).write.mode("overwrite").parquet(path)
        read = archive.one_archive(spark.read.parquet(path)).withColumn("ord", F.lit(0))
        good = read.filter("error IS NULL")
        found = sections.extract_sections(latex_source.expand_includes(good))
        found.write.mode("overwrite").parquet(f"{out}/sections/batch={number}")
        entries = bibliography.parse_bbl(latex_source.bbl_files(good), ids=("paper_id", "file_ord"))
        entries.write.mode("overwrite").parquet(f"{out}/bib/batch={number}")
        bad = read.filter("error IS NOT NULL").select("paper_id", "error")
        bad.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def citation_counts(sections_stream: DataFrame, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window, key, n): citations of each key per window of ``fetched_at``; rows later than ``delay`` are dropped."""
    return (
        sections_stream.withWatermark("fetched_at", delay)
        .select("fetched_at", F.explode("citations").alias("key"))
        .groupBy(F.window("fetched_at", window), "key")
        .agg(F.count("*").alias("n"))
    )
