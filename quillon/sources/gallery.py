"""The collection of embedded items, and the other views the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, label, img, txt, tags); the second tower is the embedding with its halves swapped."""
    e = table(spark, sf_dir, "embeddings").withColumn("img", F.col("embedding").cast("array<double>"))
    return e.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("img_"), F.lpad(F.col("vec_id").cast("string"), 5, "0")).alias("path"),
        "label",
        "img",
        F.concat(F.slice("img", 33, 32), F.slice("img", 1, 32)).alias("txt"),
        F.array(F.concat(F.lit("c"), F.col("label").cast("string")), F.concat(F.lit("m"), (F.col("vec_id") % 7).cast("string"))).alias("tags"),
    )


def queries(items: DataFrame) -> DataFrame:
    """(qid, qv, qtags): the stated query set, every item whose id is divisible by 20; a share of the table."""
    return items.where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), F.col("img").alias("qv"), F.col("tags").alias("qtags"))


def likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, id): items a user bought or clicked."""
    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    return e.crossJoin(F.broadcast(n)).select("user_id", (F.col("event_id") % F.col("n")).alias("id")).distinct()


def clustered(spark: SparkSession, n: int, *, dim: int = 64, blobs: int = 64, noise: float = 0.2, seed: int = 0) -> DataFrame:
    """(id, blob, img): n unit vectors around random centres, as real embeddings lie; a row depends on seed and id alone."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        centres = np.random.default_rng(seed).normal(size=(blobs, dim))
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                own = np.random.default_rng([seed, i])
                blob = int(own.integers(blobs))
                v = centres[blob] + noise * own.normal(size=dim)
                rows.append((i, blob, (v / np.linalg.norm(v)).tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "blob", "img"), r, strict=True)) for r in rows], schema=pa.schema([("id", pa.int64()), ("blob", pa.int32()), ("img", pa.list_(pa.float64()))]))

    return spark.range(n).mapInArrow(run, "id long, blob int, img array<double>")
