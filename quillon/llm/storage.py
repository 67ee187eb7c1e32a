"""Shared storage for the operators: tables and binary files that every executor can read.

All of it lives under ``spark.checkpoint.dir``, which the cluster shares.  A binary file counts only
if the manifest (a table written with Spark's commit protocol) names it; each attempt of a task writes
under a name of its own, so a retried or lost attempt can leave an orphan but never a half-read file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import file_system, new_path

__all__ = ["file_system", "local_schema", "new_path", "only", "put_back", "set_aside", "store"]

def store(df: DataFrame, label: str) -> DataFrame:
    """Write a table to shared storage and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """The table with its own columns of the given working names renamed, and {name: new name} of those.

    Without such a clash the table stays as it is.  ``put_back`` undoes it.
    """
    taken, wanted, moved = {c.lower() for c in df.columns}, {n.lower() for n in names}, {}
    for c in df.columns:
        if c.lower() in wanted:
            new = f"_{c}"
            while new.lower() in taken | wanted:
                new = f"_{new}"
            taken.add(new.lower())
            moved[c] = new
    return df.withColumnsRenamed(moved), moved


def put_back(df: DataFrame, moved: dict[str, str]) -> DataFrame:
    """Columns that ``set_aside`` renamed under their own names again."""
    return df.withColumnsRenamed({new: c for c, new in moved.items()})


def only(df: DataFrame, columns: list[str], moved: dict[str, str]) -> DataFrame:
    """The named columns alone, those that were set aside under their own names."""
    return df.select(*[F.col(moved.get(c, c)).alias(c) for c in columns])


def local_schema(df: DataFrame, *dropped: str) -> list[str]:
    """Input columns other than those a result is about to define (names compare case-insensitively)."""
    gone = {d.lower() for d in dropped}
    return [c for c in df.columns if c.lower() not in gone]
