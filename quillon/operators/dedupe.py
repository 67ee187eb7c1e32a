"""Near-duplicate removal among vectors, in the order of the rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..session import saved
from . import blocks


def close_pairs(items: DataFrame, threshold: float, *, column: str = "img") -> DataFrame:
    """(i, j), i < j, with cosine at or over the threshold, by dense products of tiles.

    Only close pairs become rows.  The products are all items by all items, dealt evenly over tasks whatever
    the vectors' directions; products near the threshold are summed again as ``vec.dot`` does.
    """

    def close(files: list, stretch: list) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for q in files:
            ids, left = np.asarray(q["qid"]), blocks.matrix(q["qv"].combine_chunks())
            for t in stretch:
                own, right = np.asarray(t["id"]), blocks.matrix(t[column].combine_chunks())
                if ids.min() >= own.max():
                    continue
                s = left @ right.T
                s = blocks.exactly(s, left, right, np.abs(s - threshold) <= 1e-9)
                i, j = ((s >= threshold) & (ids[:, None] < own[None, :])).nonzero()
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j])], names=["i", "j"])

    return blocks.against(items.select(F.col("id").alias("qid"), F.col(column).alias("qv")), items.select("id", column), close, "i long, j long", second_column=column)


def greedy_keep(items: DataFrame, threshold: float, *, column: str = "img") -> DataFrame:
    """(id, kept): a row is kept iff no kept row with a smaller id lies within the threshold.

    Of equal vectors only the first can stay, so one row of each takes part and a large group of copies forms
    no pairs.  Rows without an undecided earlier neighbour are decided in rounds; each round writes its state.
    """
    rows = items.select("id", F.col(column).alias("v")).withColumn("own", F.coalesce(vec.dot("v", "v") >= threshold, F.lit(False)))
    # a vector that isn't within the threshold of itself (zero, null) has no copies
    firsts = saved(rows.where("own").groupBy("v").agg(F.min("id").alias("id")).select("id", "v").unionByName(rows.where("not own").select("id", "v")))
    pairs = saved(close_pairs(firsts, threshold, column="v"))
    state = saved(firsts.select("id", F.lit(None).cast("boolean").alias("kept")))
    while True:
        known = state.select(F.col("id").alias("i"), F.col("kept").alias("k"))
        seen = pairs.join(known, "i").groupBy("j").agg(F.bool_or(F.coalesce("k", F.lit(False))).alias("hit"), F.bool_or(F.col("k").isNull()).alias("wait"))
        now = state.join(seen, state["id"] == seen["j"], "left")
        kept = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("wait", F.lit(False)), True)
        state = saved(now.select("id", kept.alias("kept")))
        if not state.where("kept is null").limit(1).count():
            decided = state.withColumnRenamed("id", "_id")
            return items.select("id").join(decided, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def crawl(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(node, level): breadth-first levels from the seeds along edges (src, dst), at most ``depth`` deep."""
    seen = saved(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    for n in range(1, depth + 1):
        front = seen.where(F.col("level") == n - 1)
        step = edges.join(front, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        fresh = step.join(seen, "node", "left_anti").withColumn("level", F.lit(n))
        seen = saved(seen.unionByName(fresh))
    return seen

