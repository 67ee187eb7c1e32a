"""One search call over all methods, with a planner that picks one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from . import index, retrieve

#: The largest number of probes and of hits that a call may ask for.
MOST_PROBES, MOST_HITS = 64, 50
FEW_PAIRS = 1_000_000


def choose(n_queries: int, n_items: int, has_cells: bool) -> str:
    """Exact expressions for few pairs, cells where there are any, dense blocks otherwise."""
    return "exact" if n_queries * n_items <= FEW_PAIRS else "ivf" if has_cells else "blocks"


def search(queries: DataFrame, items: DataFrame, *, method: str = "exact", mode: str = "image", k: int = 10, probes: int = 8, centroids: Column | None = None, scales: Column | None = None, books=None, rotation=None, short: int = 400) -> DataFrame:
    """(qid, id, score, rank) by exact, blocks, ivf, int8 or opq; probes are held to 1..64 and k to 1..50.

    ``ivf`` expects items filed by ``cell`` and the centroids, ``int8`` the scales, ``opq`` trained books and a
    rotation (none: plain product codes), of whose best ``short`` rows the exact products decide; all rank by image.
    ``int8`` looks exactly at every row that its codes' error may hide among the best, so its hits are the exact ones;
    ``exact`` takes dense blocks beyond FEW_PAIRS.
    """
    k, probes = min(MOST_HITS, max(1, k)), min(MOST_PROBES, max(1, probes))
    if method == "exact" and queries.count() * items.count() > FEW_PAIRS:
        method = "blocks"
    if method == "exact":
        hits = retrieve.top_k(retrieve.score_all(queries, items, mode), k)
    elif method == "blocks":
        hits = retrieve.exact_blocks(queries, items, k, column=retrieve.MODES[mode])
    elif method == "ivf" and centroids is not None:
        hits = retrieve.ivf_search(queries, items, centroids, k, probes)
    elif method == "int8" and scales is not None:
        coded = items.withColumn("_i8", retrieve.int8_codes(F.col("img"), scales))
        asked = queries.withColumn("_sq", F.zip_with("qv", scales, lambda x, s: x * s))
        # a value is at most half its scale from its code
        asked = asked.withColumn("_off", F.aggregate("_sq", F.lit(0.0), lambda s, x: s + F.abs(x) / 2))
        hits = retrieve.exact_blocks(asked, coded, k, rough=("_i8", "_sq", "_off"))
    elif method == "opq" and books is not None:
        coded = items.select("id", "codes") if "codes" in items.columns else index.coded(items.select("id", "img"), books, rotation).select("id", "codes")
        asked = index.tabled(queries.select("qid", "qv"), books, rotation)
        rough = retrieve.top_k(retrieve.meet(coded, asked.drop("qv"), "tables", times=books.shape[1]).withColumn("score", retrieve.adc_score(F.col("codes"), F.col("tables"))), max(k, short))
        near = rough.select("qid", "id").join(items.select("id", "img"), "id").join(queries.select("qid", "qv"), "qid")
        hits = retrieve.top_k(near.withColumn("score", vec.dot("img", "qv")), k)
    else:
        raise ValueError(f"no method {method} with what was given")
    return hits.select("qid", "id", "score", "rank")


def arithmetic(items: DataFrame, expression: str, k: int) -> DataFrame:
    """(id, path, score, rank): the items nearest to "a + b - c", names being parts of paths; the first by id is meant.

    An unknown name raises, and so do terms that cancel out.  The terms' own items take part.
    """
    parts = vec.terms(expression)
    named = items.select("id", "img", F.explode(F.filter(F.array(*[F.lit(n) for n in dict.fromkeys(n for _, n in parts)]), lambda n: F.contains(F.col("path"), n))).alias("name"))
    found = named.groupBy("name").agg(F.min_by("img", "id").alias("v"))
    lookup = found.agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("m"))
    one = lambda n: F.coalesce(F.try_element_at("m", F.lit(n)), F.raise_error(F.lit(f"no item's path holds {n}")))
    q = lookup.select(F.lit(0).alias("qid"), vec.combine([(sign, one(n)) for sign, n in parts], strict=True).alias("qv"))
    hits = retrieve.top_k(retrieve.score_all(q, items), k)
    return hits.select("id", "path", "score", "rank")


def in_phases(queries: DataFrame, phases: dict[str, DataFrame], k: int) -> DataFrame:
    """(phase, qid, id, score, rank): each phase's items (id, img, txt) ranked on a scale of their own.

    Scores of live results and of a stored collection aren't comparable, so they never share a ranking.
    """
    out = None
    for name, items in phases.items():
        hits = retrieve.top_k(retrieve.score_all(queries, items), k).select(F.lit(name).alias("phase"), "qid", "id", "score", "rank")
        out = hits if out is None else out.unionByName(hits)
    return out


def recall(hits: DataFrame, true: DataFrame, queries: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(method, k, recall): the share of each query's k true hits (qid, id, place) among its first k by a method (method, qid, id, rank)."""
    level = F.explode(F.array(*[F.lit(k) for k in ks]))
    found = hits.join(true, ["qid", "id"], "left").withColumn("k", level).where("rank <= k")
    n = queries.agg(F.count_distinct("qid").alias("n"))
    right = found.groupBy("method", "k").agg(F.count_if(F.col("place") <= F.col("k")).alias("right"))
    return right.crossJoin(F.broadcast(n)).select("method", "k", (F.col("right") / (F.col("n") * F.col("k"))).alias("recall"))
