"""Capacity arithmetic: bytes per encoding, cells, shards, staged search, latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query

#: Bytes per vector, and milliseconds per serving stage.
ENCODINGS = (("float32", 2048), ("float16", 1024), ("int8", 512), ("PQ-64", 64), ("binary", 64))
STAGES = (("embed", 12.0), ("coarse", 0.5), ("scan", 6.0), ("exact", 2.0), ("gather", 4.0))
SIZES = (690_000, 1_000_000, 1_000_000_000, 2_000_000_000)
PER_SHARD, PROBES, KEEP_EXACT = 1_000_000, 32, 50
_N = "n AS (SELECT unnest([690000, 1000000, 1000000000, 2000000000])::BIGINT AS n)"


def sizes(spark):
    return spark.createDataFrame([(n,) for n in SIZES], "n long")


@query(f"WITH {_N}, e(encoding, b) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in ENCODINGS) + """) SELECT n, encoding, n * b AS bytes, CASE WHEN n * b < 1024 THEN printf('%.1f B', (n * b)::DOUBLE) WHEN n * b < 1048576 THEN printf('%.1f KB', n * b / 1024.0) WHEN n * b < 1073741824 THEN printf('%.1f MB', n * b / 1048576.0) WHEN n * b < 1099511627776 THEN printf('%.1f GB', n * b / 1073741824.0) ELSE printf('%.1f TB', n * b / 1099511627776.0) END AS shown FROM n, e""")
def memory_plan(spark, sf):
    e = spark.createDataFrame(list(ENCODINGS), "encoding string, b long")
    b = F.col("n") * F.col("b")
    shown = F.when(b < 2**10, F.format_string("%.1f B", b.cast("double")))
    for k, u in enumerate(("KB", "MB", "GB")):
        shown = shown.when(b < 2 ** (10 * (k + 2)), F.format_string(f"%.1f {u}", b / float(2 ** (10 * (k + 1)))))
    return sizes(spark).crossJoin(F.broadcast(e)).select("n", "encoding", b.alias("bytes"), shown.otherwise(F.format_string("%.1f TB", b / float(2**40))).alias("shown"))


@query(f"WITH {_N}, p AS (SELECT n, CAST(round_even(sqrt(n), 0) AS BIGINT) AS cells FROM n) SELECT n, cells, round({PROBES} * (n / cells::DOUBLE), 6) AS scanned, round({PROBES} / cells::DOUBLE, 9) AS fraction, greatest(1, CAST(round_even(n / {PER_SHARD}.0, 0) AS BIGINT)) AS shards, n * 128 AS resident_bytes, {KEEP_EXACT} / n::DOUBLE AS exact_fraction FROM p")
def index_plan(spark, sf):
    """Cells of about the root of n, rows scanned, shards, and the staged search's resident bytes."""
    p = sizes(spark).withColumn("cells", F.rint(F.sqrt("n")).cast("long"))
    return p.select("n", "cells", F.round(PROBES * (F.col("n") / F.col("cells")), 6).alias("scanned"), F.round(PROBES / F.col("cells"), 9).alias("fraction"), F.greatest(F.lit(1), F.rint(F.col("n") / PER_SHARD).cast("long")).alias("shards"), (F.col("n") * 128).alias("resident_bytes"), (KEEP_EXACT / F.col("n")).alias("exact_fraction"))


@query("WITH s(stage, ms) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in STAGES) + ") SELECT true AS sharded, sum(ms) AS total FROM s UNION ALL SELECT false, sum(ms) FROM s WHERE stage <> 'gather'")
def latency_budget(spark, sf):
    s = spark.createDataFrame(list(STAGES), "stage string, ms double")
    one = lambda d, flag: d.agg(F.sum("ms").alias("total")).select(F.lit(flag).alias("sharded"), "total")
    return one(s, True).unionByName(one(s.where("stage <> 'gather'"), False))
