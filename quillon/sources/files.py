"""Batch ingest of files: contents are read by Spark, unreadable ones counted and left out."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, size, hash) of the files under a folder, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.col("length").alias("size"), F.substring(F.sha1("content"), 1, 12).alias("hash"))


def embedded(files: DataFrame, make: Callable[[], Callable[[bytes], list[float] | None]]) -> DataFrame:
    """Adds ``img`` by a pluggable decoder and encoder; a file that it can't read gets null."""

    @F.pandas_udf("array<double>")
    def run(contents: pd.Series) -> pd.Series:
        embed, out = make(), []
        for c in contents:
            try:
                out.append(embed(c))
            except Exception:  # any decoder error marks the file as unreadable
                out.append(None)
        return pd.Series(out, dtype=object)

    return files.withColumn("img", run("content"))
