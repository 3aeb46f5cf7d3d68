"""Session helpers: reading tables, cutting lineage in the shared folder, loss-safe hot-key handling."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import citeloom

# Functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(citeloom)

_written: dict[str, list[str]] = {}
_paths: dict[int, tuple[DataFrame, str]] = {}


def get_spark(app: str = "citeloom", cores: str = "*") -> SparkSession:
    """A local session with the settings this library expects; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the project's parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one, else a local one (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"{tempfile.gettempdir()}/citeloom-{os.getpid()}"
    os.makedirs(folder, exist_ok=True)
    return f"file://{folder}"


def materialise(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage: write ``df`` once as a parquet table in the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the plan once, and unlike ``localCheckpoint()`` the rows survive the
    loss of an executor. The tables are removed by ``release``, by ``clear_materialised`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citeloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    app = spark.sparkContext.applicationId
    if app not in _written:
        atexit.register(_clear_quietly, spark)
    _written.setdefault(app, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote, once their last reader has run; other DataFrames are left alone."""
    for df in tables:
        held = _paths.pop(id(df), None)
        if held is not None:
            sc = df.sparkSession.sparkContext
            if held[1] in (paths := _written.get(sc.applicationId, [])):
                paths.remove(held[1])
                _delete(sc, held[1])


def _delete(sc, path: str) -> None:
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def clear_materialised(spark: SparkSession) -> None:
    """Remove every table that ``materialise`` wrote for this application."""
    sc = spark.sparkContext
    for path in _written.pop(sc.applicationId, []):
        _delete(sc, path)
    _paths.clear()


def _clear_quietly(spark: SparkSession) -> None:
    try:
        clear_materialised(spark)
    except Exception:  # noqa: BLE001 - the JVM may already be gone
        pass
