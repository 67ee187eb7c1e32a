"""Streaming jobs: windowed monitoring, idempotent appends, counted ingest, votes as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import calibrate
from ..session import new_path
from ..sources.store import first_of


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files, event times as timestamps."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def daily(stream: DataFrame, *, late: str = "2 days") -> DataFrame:
    """Daily counts and means with a watermark for late rows."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"))
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.date_format("window.start", "yyyy-MM-dd").alias("window_id"), "n", "total")


def monitor(stream: DataFrame, reference: DataFrame, sink: str, *, checkpoint: str):
    """Each micro-batch's days against a frozen reference, verdicts appended to a table of files."""

    def judge(batch: DataFrame, number: int) -> None:
        live = batch.select(F.date_format("ts", "yyyy-MM-dd").alias("window_id"), "value")
        calibrate.monitor(reference, live).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)


def append_new(stream: DataFrame, key: str, *, within: tuple[str, str] | None = None) -> DataFrame:
    """First row of each key only: what a repeated crawl would add.

    ``within`` (time column, delay) forgets keys once the watermark has passed them, which bounds the state;
    without it every key is remembered.
    """
    if within is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(*within).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, sink: str, *, checkpoint: str):
    """Append batches and their row counts; a batch replayed after a failure overwrites itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{sink}/rows/batch={number}")
        batch.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{sink}/meta/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def votes(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running council over votes (score, confidence) that arrive one by one."""
    w = F.greatest(F.col("confidence"), F.lit(0.0))
    return stream.groupBy(*keys).agg(F.count("score").alias("n_valid"), F.sum(F.when(F.col("score").isNotNull(), F.col("score") * w)).alias("sw"), F.sum(F.when(F.col("score").isNotNull(), w)).alias("w"), F.max("score").alias("hi"), F.min("score").alias("lo"))


def polled(stream: DataFrame, seconds: int, act: Callable[[DataFrame, int], None], *, checkpoint: str):
    """Look for new rows every ``seconds`` and hand each batch to ``act``: a crawl's polling loop as a trigger."""
    return stream.writeStream.foreachBatch(act).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint)


def drained(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote: files in shared storage, its state beside them.

    An aggregate (``keys`` given) writes the changed rows of each batch; the last row of each key stands.
    """
    spark, folder = stream.sparkSession, new_path(stream.sparkSession, "stream")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    q = stream.writeStream.foreachBatch(save).outputMode("update" if keys else "append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{folder}/rows/*")
    return (first_of(rows, keys, [F.desc("_batch")]) if keys else rows).drop("_batch")
