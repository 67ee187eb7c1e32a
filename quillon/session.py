"""Session helpers: loading tables and making the package importable on Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Batches to Python workers: (setting, Spark's default, ours). Long texts make the default batches large;
#: a session's own setting is left alone.
BATCHES = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"),
)
ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the driver's path.

    On a cluster without that path, ship it with ``--py-files`` instead; the entry added here is then unused.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    for key, default, held in BATCHES:
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, held)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a private folder in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quillon-")
            atexit.register(shutil.rmtree, _own[app], True)
        base = _own[app]
    return f"{base.rstrip('/')}/quillon"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """(file system, path) for reading or writing bytes inside a task."""
    from pyarrow import fs

    if "://" not in uri and ":/" in uri:
        scheme, _, rest = uri.partition(":")
        uri = f"{scheme}://{rest}"
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def saved(df: DataFrame) -> DataFrame:
    """Written to shared storage and read again: its lineage is cut, and lost executors lose nothing."""
    path = new_path(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
