"""Searches over trained cells and codes, for every item whose id is divisible by 20.

The queries of ``retrieval_queries`` with SQL state a model of stored vectors.  Here models are
trained on at most SAMPLE rows, candidates are shares of the table, and both were chosen from recall against
exact search, which the tests demand to be 0.9.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import blocks, index, retrieve
from ..session import saved
from ..sources.gallery import queries, gallery
from .registry import query

SAMPLE = 20_000
CELLS, PROBES, CASCADE_PROBES = 32, 22, 26
BOOKS, WORDS, SUB = 16, 16, 4
#: Shares of the table that product codes leave for the exact look, and that each level of the cascade leaves.
SHORT, KEEP = 0.2, (0.5, 0.25, 0.1)


def sample(items: DataFrame) -> DataFrame:
    """At most SAMPLE rows for training, those with the least hash of their id."""
    return saved(items.select("id", "img").orderBy(F.xxhash64("id"), "id").limit(SAMPLE))


def share(items: DataFrame, *of: float, k: int) -> list[int]:
    """Shares of the table as counts, no fewer than k."""
    n = items.count()
    return [max(k, math.ceil(s * n)) for s in of]


def model(spark, **values) -> DataFrame:
    """One row with trained arrays."""
    kinds = {1: "array<double>", 2: "array<array<double>>", 3: "array<array<array<double>>>"}
    return F.broadcast(spark.createDataFrame([tuple(v.tolist() for v in values.values())], ", ".join(f"{n} {kinds[v.ndim]}" for n, v in values.items())))


def show(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query()
def ivf_trained(spark, sf):
    """Top ten by trained cells, with rows scanned."""
    items = gallery(spark, sf).select("id", "img", "tags")
    m = model(spark, cents=index.kmeans(sample(items), CELLS))
    filed = retrieve.assign_cells(items.crossJoin(m), F.col("cents")).drop("cents", "tags")
    hits = retrieve.ivf_search(queries(items).crossJoin(m), filed, F.col("cents"), 10, PROBES)
    return hits.select("qid", "id", "rank", F.round("score", 6).alias("score"), "scanned")


def _by_codes(items: DataFrame, m: DataFrame, column: str = "img") -> DataFrame:
    """Top ten after an exact second look at the best SHORT of the table by product codes."""
    coded = items.crossJoin(m).select("id", retrieve.pq_encode(F.col(column), F.col("books"), SUB).alias("codes"))
    turn = items.select(F.col("id").alias("qid"), F.col(column).alias("turn"))
    asked = queries(items).join(turn, "qid").crossJoin(m).select("qid", "qv", retrieve.adc_tables(F.col("turn"), F.col("books"), SUB).alias("tables"))
    out, (short,) = None, share(items, SHORT, k=10)
    for part in retrieve.parts(asked, times=1 + BOOKS * WORDS // 64):
        scored = coded.crossJoin(F.broadcast(part.drop("qv"))).select("qid", "id", F.round(retrieve.adc_score(F.col("codes"), F.col("tables")), 9).alias("score"))
        best = retrieve.top_k(scored, short).select("qid", "id").join(items.select("id", "img"), "id")
        best = best.join(F.broadcast(part.select("qid", "qv")), "qid").select("qid", "id", vec.dot("img", "qv").alias("score"))
        out = best if out is None else out.unionByName(best)
    return show(retrieve.top_k(out, 10))


@query()
def pq_trained(spark, sf):
    items = gallery(spark, sf).select("id", "img", "tags")
    return _by_codes(items, model(spark, books=index.pq_train(sample(items), BOOKS, WORDS)))


@query()
def opq_trained(spark, sf):
    """Product codes after a trained rotation."""
    items = gallery(spark, sf).select("id", "img", "tags")
    rotation, books = index.opq_train(sample(items), BOOKS, WORDS)
    return _by_codes(index.turned(items, rotation), model(spark, books=books), "turn")


@query()
def cascade_trained(spark, sf):
    """Top five by trained cells, sign bits, trained product codes, int8 products and exact ones."""
    items = gallery(spark, sf).select("id", "img", "tags")
    some = sample(items)
    scale = items.agg((F.max(F.array_max(F.transform("img", lambda x: F.abs(x)))) / 127).alias("scale"))
    m = F.broadcast(model(spark, cents=index.kmeans(some, CELLS), books=index.pq_train(some, BOOKS, WORDS)).crossJoin(scale))
    i8 = lambda c: retrieve.int8_codes(F.col(c), F.array_repeat("scale", 64))
    coded = retrieve.assign_cells(blocks.in_order(items.drop("tags"), "id", "img").crossJoin(m), F.col("cents"))
    coded = coded.select("id", "img", "cell", vec.bits("img").alias("sign"), retrieve.pq_encode(F.col("img"), F.col("books"), SUB).alias("codes"), i8("img").alias("i8"))
    asked = queries(items).crossJoin(m).select("qid", "qv", retrieve.near_cells(F.col("cents"), CASCADE_PROBES).alias("cells"), vec.bits("qv").alias("qsign"), retrieve.adc_tables(F.col("qv"), F.col("books"), SUB).alias("tables"), i8("qv").alias("q8"))
    return show(retrieve.funnel(asked, coded, k=5, keep=tuple(share(items, *KEEP, k=5)))[0])
