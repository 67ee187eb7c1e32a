"""Retrieval by codes and cells, retrieval metrics, ranking and recommendation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import blocks, dedupe, index, rank, retrieve, search
from ..session import saved, table
from ..sources.gallery import gallery, likes, queries
from .registry import GALLERY, LOO, ORACLES, PAIRS, QUERIES, query

SUB, KS, PROBES = 8, 16, 13
#: Share of the table that product codes leave for the exact look: with it, and with PROBES of KS cells, recall@10 is 0.9.
SHORT = 0.4
#: Fixed models of the oracle-checked queries: sixteen stored vectors as centroids and as code words.
MODEL_SQL = f"""{GALLERY}, cents AS (SELECT id AS c, img AS cv FROM gallery WHERE id < {KS}),
q AS (SELECT id AS qid, img AS qv FROM gallery WHERE id % 20 = 0), few AS (SELECT count(*) AS n FROM gallery),
near AS (SELECT qid, qv, c FROM (SELECT qid, qv, c, row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(qv, cv) DESC, c) AS r FROM q, cents) WHERE r <= {PROBES}),
filed AS (SELECT id, img, c AS cell FROM (SELECT id, img, c, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(img, cv) DESC, c) AS r FROM gallery, cents) WHERE r = 1),
dist AS (SELECT g.id, j, c, list_sum(list_transform(range(1, {SUB + 1}), lambda i: (g.img[j * {SUB} + i] - cv[j * {SUB} + i]) * (g.img[j * {SUB} + i] - cv[j * {SUB} + i]))) AS d FROM gallery g, cents, (SELECT unnest(range(0, 8)) AS j)),
codes AS (SELECT id, j, c FROM (SELECT *, row_number() OVER (PARTITION BY id, j ORDER BY d, c) AS r FROM dist) WHERE r = 1),
lut AS (SELECT qid, j, c, list_dot_product(qv[j * {SUB} + 1:j * {SUB} + {SUB}], cv[j * {SUB} + 1:j * {SUB} + {SUB}]) AS t FROM q, cents, (SELECT unnest(range(0, 8)) AS j)),
adc AS (SELECT qid, id, round(sum(t), 9) AS adc FROM codes JOIN lut USING (j, c) GROUP BY qid, id)"""


LEFT = f"greatest(10, ceil({SHORT}::DOUBLE * n))"


def shares(items: DataFrame, *of: float, least: int) -> list[int]:
    """Shares of the table as counts, no fewer than ``least``."""
    n = items.count()
    return [max(least, math.ceil(s * n)) for s in of]


def centroids(items: DataFrame) -> DataFrame:
    """One row: the first KS vectors as an array; a model of fixed size."""
    rows = items.where(F.col("id") < KS).agg(F.array_sort(F.collect_list(F.struct("id", "img"))).alias("m"))
    return rows.select(F.transform("m", lambda x: x["img"]).alias("cents"))


def books(items: DataFrame) -> DataFrame:
    """One row: cents and, per subspace, their subvectors."""
    part = lambda j: F.transform("cents", lambda v: F.slice(v, j * SUB + 1, SUB))
    return centroids(items).withColumn("books", F.array(*[part(j) for j in range(8)]))


@query(f"""WITH {MODEL_SQL}, s AS (SELECT qid, id, list_dot_product(img, qv) AS score, count(*) OVER (PARTITION BY qid) AS scanned FROM near JOIN filed ON near.c = filed.cell),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, scanned FROM r WHERE rank <= 10""")
def ivf_search(spark, sf):
    items = gallery(spark, sf)
    m = F.broadcast(centroids(items))
    filed = retrieve.assign_cells(items.crossJoin(m), F.col("cents")).drop("cents")
    asked = queries(items).crossJoin(m)
    hits = retrieve.ivf_search(asked, filed, F.col("cents"), 10, PROBES)
    return hits.select("qid", "id", "rank", F.round("score", 6).alias("score"), "scanned")


@query(f"""WITH {MODEL_SQL} SELECT cell, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY cell) - count(*) AS BIGINT) AS start FROM filed GROUP BY cell""")
def ivf_lists(spark, sf):
    """Sizes and offsets of the inverted lists."""
    items = gallery(spark, sf)
    n = retrieve.assign_cells(items.crossJoin(F.broadcast(centroids(items))), F.col("cents")).groupBy("cell").agg(F.count("*").alias("n"))
    return n.select(F.col("cell").cast("long").alias("cell"), "n", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("start"))


@query(f"""WITH {MODEL_SQL}, s AS (SELECT cell, p, avg(img[p]) AS x FROM filed, (SELECT unnest(range(1, 65)) AS p) GROUP BY cell, p), v AS (SELECT cell, list(x ORDER BY p) AS v FROM s GROUP BY cell)
SELECT cell, round(sqrt(list_dot_product(v, v)), 6) AS length, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM v""")
def kmeans_step(spark, sf):
    """One assignment and update of spherical k-means."""
    from .vector_queries import mean_vectors

    items = gallery(spark, sf)
    filed = retrieve.assign_cells(items.crossJoin(F.broadcast(centroids(items))), F.col("cents"))
    m = mean_vectors(filed, F.col("cell"))
    return m.select(F.col("key").cast("long").alias("cell"), F.round(vec.norm("mean"), 6).alias("length"), F.round(F.get(vec.unit("mean"), F.lit(0)), 6).alias("first"))


@query(f"""WITH {MODEL_SQL} SELECT id, list(c ORDER BY j) AS codes FROM codes GROUP BY id""")
def pq_encode(spark, sf):
    items = gallery(spark, sf)
    coded = items.crossJoin(F.broadcast(books(items))).select("id", retrieve.pq_encode(F.col("img"), F.col("books"), SUB).alias("codes"))
    return coded.select("id", F.transform("codes", lambda c: c.cast("long")).alias("codes"))


@query(f"""WITH {MODEL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY adc DESC, id) AS rank FROM adc),
e AS (SELECT r.qid, r.id, list_dot_product(img, qv) AS score FROM r JOIN gallery USING (id) JOIN q ON q.qid = r.qid, few WHERE rank <= {LEFT}),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM e)
SELECT 'codes' AS stage, qid, id, CAST(rank AS INTEGER) AS rank, round(adc, 6) AS score FROM r WHERE rank <= 10 UNION ALL SELECT 'exact', qid, id, CAST(rank AS INTEGER), round(score, 6) FROM f WHERE rank <= 10""")
def pq_search(spark, sf):
    """Search over product codes, and the same after an exact second look at SHORT of the table."""
    return _by_codes(gallery(spark, sf), F.col("img"))


def _by_codes(items: DataFrame, turn: Column) -> DataFrame:
    """``turn``: the vector that is coded, made of img after the shuffle."""
    model = saved(books(items.withColumn("img", turn)))
    coded = retrieve.pq_coded(blocks.in_order(items.select("id", "img"), "id", "img").withColumn("_v", turn), model.first()["books"], column="_v")
    asked = items.where("id % 20 = 0").crossJoin(F.broadcast(model)).select(F.col("id").alias("qid"), F.col("img").alias("qv"), retrieve.adc_tables(turn, F.col("books"), SUB).alias("tables"))
    (left,) = shares(items, SHORT, least=10)
    return retrieve.second_look(asked, coded, left=left, k=10).select("stage", "qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {MODEL_SQL} SELECT id, round(sqrt(sum(d)), 6) AS error FROM (SELECT d.id, d.d FROM dist d JOIN codes USING (id, j, c)) GROUP BY id""")
def pq_reconstruct(spark, sf):
    items = gallery(spark, sf)
    m = items.crossJoin(F.broadcast(books(items)))
    back = m.select("id", "img", retrieve.reconstruct(retrieve.pq_encode(F.col("img"), F.col("books"), SUB), F.col("books")).alias("r"))
    return back.select("id", F.round(vec.norm(vec.subtract("img", "r")), 6).alias("error"))


@query(f"""WITH {MODEL_SQL}, rot AS (SELECT id, list_concat(img[2:64], img[1:1]) AS v FROM gallery), rc AS (SELECT id AS c, v AS cv FROM rot WHERE id < {KS}),
rd AS (SELECT rot.id, j, c, list_sum(list_transform(range(1, {SUB + 1}), lambda i: (v[j * {SUB} + i] - cv[j * {SUB} + i]) * (v[j * {SUB} + i] - cv[j * {SUB} + i]))) AS d FROM rot, rc, (SELECT unnest(range(0, 8)) AS j)),
rcode AS (SELECT id, j, c FROM (SELECT *, row_number() OVER (PARTITION BY id, j ORDER BY d, c) AS r FROM rd) WHERE r = 1),
rl AS (SELECT rot.id AS qid, j, c, list_dot_product(v[j * {SUB} + 1:j * {SUB} + {SUB}], cv[j * {SUB} + 1:j * {SUB} + {SUB}]) AS t FROM rot, rc, (SELECT unnest(range(0, 8)) AS j) WHERE rot.id % 20 = 0),
s AS (SELECT qid, id, round(sum(t), 9) AS score FROM rcode JOIN rl USING (j, c) GROUP BY qid, id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s),
e AS (SELECT r.qid, r.id, list_dot_product(img, qv) AS score FROM r JOIN gallery USING (id) JOIN q ON q.qid = r.qid, few WHERE rank <= {LEFT}),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM e)
SELECT 'codes' AS stage, qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10 UNION ALL SELECT 'exact', qid, id, CAST(rank AS INTEGER), round(score, 6) FROM f WHERE rank <= 10""")
def opq_search(spark, sf):
    """Product codes after a given rotation (here a shift of the axes; ``opq_trained`` learns one), then the exact second look."""
    return _by_codes(gallery(spark, sf), F.concat(F.slice("img", 2, 63), F.slice("img", 1, 1)))


@query(f"""WITH {PAIRS}, sc AS (SELECT list(CASE WHEN m = 0 THEN 1 ELSE m / 127 END ORDER BY p) AS s FROM (SELECT p, max(abs(img[p])) AS m FROM gallery, (SELECT unnest(range(1, 65)) AS p) GROUP BY p)),
i8 AS (SELECT id, list_transform(range(1, 65), lambda i: round_even(img[i] / s[i], 0)) AS c, s FROM gallery, sc),
x AS (SELECT qid, i8.id, list_dot_product(c, list_transform(range(1, 65), lambda i: s[i] * qv[i])) AS score, cos_image FROM pairs JOIN i8 USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, row_number() OVER (PARTITION BY qid ORDER BY cos_image DESC, id) AS true_rank FROM x)
SELECT qid, count(*) FILTER (rank <= 10 AND true_rank <= 10) / 10.0::DOUBLE AS recall, round(max(score), 6) AS best FROM r GROUP BY qid""")
def int8_search(spark, sf):
    """Per-dimension int8 codes, the scales folded into the query; recall of the top ten against exact."""
    items = gallery(spark, sf)
    peak = items.select(F.posexplode("img").alias("pos", "x")).groupBy("pos").agg(F.max(F.abs("x")).alias("m"))
    scales = peak.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("m") == 0, 1.0).otherwise(F.col("m") / 127).alias("s")))), lambda s: s["s"]).alias("scales"))
    coded = items.crossJoin(F.broadcast(scales)).select("id", "img", retrieve.int8_codes(F.col("img"), F.col("scales")).alias("i8"))
    asked = queries(items).crossJoin(F.broadcast(scales)).select("qid", "qv", F.zip_with("scales", "qv", lambda s, x: s * x).alias("sq"))
    by_codes = retrieve.exact_blocks(asked.select("qid", F.col("sq").alias("qv")), coded, 10, column="i8")
    exact = retrieve.exact_blocks(asked, coded, 10).select("qid", "id", F.lit(1).alias("right"))
    return by_codes.join(exact, ["qid", "id"], "left").groupBy("qid").agg((F.count("right") / 10).alias("recall"), F.round(F.max("score"), 6).alias("best"))


@query(f"""WITH {GALLERY}, s AS (SELECT max(list_max(list_transform(img, lambda x: abs(x)))) / 127 AS s FROM gallery), d AS (SELECT id, img, list_transform(img, lambda x: round_even(x / s, 0)) AS c FROM gallery, s),
p AS (SELECT a.id AS qid, b.id, list_dot_product(a.img, b.img) AS x, list_dot_product(a.c, b.c) AS y FROM d a JOIN d b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x DESC, id) AS rx, row_number() OVER (PARTITION BY qid ORDER BY y DESC, id) AS ry FROM p),
l AS (SELECT qid, list(id ORDER BY rx) FILTER (rx <= 3) AS a, list(id ORDER BY ry) FILTER (ry <= 3) AS b FROM r GROUP BY qid)
SELECT count(*) AS n, count(*) FILTER (a = b) AS same FROM l""")
def int8_agreement(spark, sf):
    """How many items keep their three nearest neighbours under one shared int8 scale."""
    items = gallery(spark, sf)
    scale = items.agg((F.max(F.array_max(F.transform("img", lambda x: F.abs(x)))) / 127).alias("s"))
    coded = saved(items.crossJoin(F.broadcast(scale)).select("id", "img", retrieve.int8_codes(F.col("img"), F.array_repeat("s", 64)).alias("c")))

    def best(column, name):
        asked = coded.select(F.col("id").alias("qid"), F.col(column).alias("qv"))
        hits = retrieve.exact_blocks(asked, coded, 3, column=column, exclude_self=True)
        return hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias(name))

    return best("img", "a").join(best("c", "b"), "qid").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))


@query(f"""WITH {PAIRS}, h AS (SELECT qid, id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (img[i] > 0) <> (qv[i] > 0) THEN 1 ELSE 0 END)) AS d FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM h)
SELECT qid, id, CAST(rank AS INTEGER) AS rank, CAST(d AS INTEGER) AS bits FROM r WHERE rank <= 10""")
def binary_search(spark, sf):
    """Sign bits packed in longs, nearest by differing bits."""
    items = gallery(spark, sf)
    asked = queries(items).select("qid", vec.bits("qv").alias("qsign"))
    return retrieve.nearest_bits(asked, items.select("id", vec.bits("img").alias("sign")), 10).select("qid", "id", "rank", "bits")


#: Shares of the table that the levels leave.
KEEP = (0.5, 0.3, 0.1)
KEPT = [f"greatest(5, ceil({s}::DOUBLE * (SELECT n FROM few)))" for s in KEEP]
CASCADE_SQL = f"""WITH {MODEL_SQL}, sc AS (SELECT max(list_max(list_transform(img, lambda x: abs(x)))) / 127 AS s FROM gallery),
l0 AS (SELECT qid, qv, id, img FROM near JOIN filed ON near.c = filed.cell),
l1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (img[i] > 0) <> (qv[i] > 0) THEN 1 ELSE 0 END)), id) AS r FROM l0) WHERE r <= {KEPT[0]}),
l2 AS (SELECT * FROM (SELECT l1.*, row_number() OVER (PARTITION BY qid ORDER BY adc DESC, id) AS r2 FROM l1 JOIN adc USING (qid, id)) WHERE r2 <= {KEPT[1]}),
l3 AS (SELECT * FROM (SELECT l2.*, row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(list_transform(img, lambda x: round_even(x / s, 0)), list_transform(qv, lambda x: round_even(x / s, 0))) DESC, id) AS r3 FROM l2, sc) WHERE r3 <= {KEPT[2]}),
l4 AS (SELECT * FROM (SELECT qid, id, list_dot_product(img, qv) AS score, row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(img, qv) DESC, id) AS rank FROM l3) WHERE rank <= 5)
"""


def _run_cascade(spark, sf):
    items = gallery(spark, sf)
    scale = items.agg((F.max(F.array_max(F.transform("img", lambda x: F.abs(x)))) / 127).alias("scale"))
    model = F.broadcast(saved(books(items).crossJoin(scale)))
    coded = retrieve.assign_cells(blocks.in_order(items.select("id", "img"), "id", "img").crossJoin(model), F.col("cents"))
    i8 = lambda c: retrieve.int8_codes(F.col(c), F.array_repeat("scale", 64))
    coded = coded.select("id", "img", "cell", vec.bits("img").alias("sign"), retrieve.pq_encode(F.col("img"), F.col("books"), SUB).alias("codes"), i8("img").alias("i8"))
    asked = queries(items).crossJoin(model).select("qid", "qv", retrieve.near_cells(F.col("cents"), PROBES).alias("cells"), vec.bits("qv").alias("qsign"), retrieve.adc_tables(F.col("qv"), F.col("books"), SUB).alias("tables"), i8("qv").alias("q8"))
    return retrieve.funnel(asked, coded, k=5, keep=tuple(shares(items, *KEEP, least=5)))


@query(CASCADE_SQL + "SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM l4")
def cascade_search(spark, sf):
    return _run_cascade(spark, sf)[0].select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(CASCADE_SQL + "SELECT qid, 0 AS level, count(*) AS alive FROM l0 GROUP BY qid UNION ALL SELECT qid, 1, count(*) FROM l1 GROUP BY qid UNION ALL SELECT qid, 2, count(*) FROM l2 GROUP BY qid UNION ALL SELECT qid, 3, count(*) FROM l3 GROUP BY qid UNION ALL SELECT qid, 4, count(*) FROM l4 GROUP BY qid")
def cascade_survivors(spark, sf):
    return _run_cascade(spark, sf)[1]


@query(f"""WITH {LOO}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM loo)
SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(cos, 6) AS score FROM r WHERE rank <= 3""")
def neighbours(spark, sf):
    """Three nearest other items of every item, by dense blocks."""
    items = gallery(spark, sf)
    everyone = items.select(F.col("id").alias("qid"), F.col("img").alias("qv"))
    return retrieve.exact_blocks(everyone, items, 3, exclude_self=True).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {LOO}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM loo),
m AS (SELECT qid, count(*) FILTER (rel AND rank <= 1) / 1.0 AS p1, count(*) FILTER (rel AND rank <= 3) / 3.0 AS p3, count(*) FILTER (rel AND rank <= 5) / 5.0 AS p5, coalesce(1.0 / min(rank) FILTER (rel), 0) AS rr FROM r GROUP BY qid)
SELECT round(avg(CAST(p1 AS DOUBLE)), 6) AS p_at_1, round(avg(CAST(p3 AS DOUBLE)), 6) AS p_at_3, round(avg(CAST(p5 AS DOUBLE)), 6) AS p_at_5, round(avg(CAST(rr AS DOUBLE)), 6) AS mrr FROM m""")
def retrieval_metrics(spark, sf):
    """Leave-one-out precision at 1, 3, 5 (over k even where fewer rows) and mean reciprocal rank.

    Precision needs five hits a query and the reciprocal rank only the best relevant item and how many
    items stand before it, so no ranking of all pairs is made.
    """
    from .monitoring_queries import best_of_tags

    items = gallery(spark, sf)
    everyone = items.select(F.col("id").alias("qid"), F.col("img").alias("qv"))
    top = retrieve.exact_blocks(everyone, items, 5, exclude_self=True)
    tags = items.select(F.col("id").alias("qid"), F.col("tags").alias("qtags"))
    top = top.join(tags, "qid").join(items.select("id", "tags"), "id").withColumn("rel", F.arrays_overlap("tags", "qtags"))
    p = lambda k: F.count_if(F.col("rel") & (F.col("rank") <= k)) / k
    hits = top.groupBy("qid").agg(p(1).alias("p1"), p(3).alias("p3"), p(5).alias("p5"))
    best = best_of_tags(items).select("qid", F.col("best").alias("hit_score"), F.col("best_id").alias("hit_id"))
    above = retrieve.count_above(everyone.join(best, "qid"), items)
    m = hits.join(above, "qid", "left").withColumn("rr", F.coalesce(1 / (F.col("above") + 1), F.lit(0.0)))
    return m.agg(*[F.round(F.avg(a), 6).alias(b) for a, b in (("p1", "p_at_1"), ("p3", "p_at_3"), ("p5", "p_at_5"), ("rr", "mrr"))])


@query(f"""WITH {LOO}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM loo)
SELECT qid, round(max(cos) FILTER (rank = 1) - avg(cos) FILTER (rank BETWEEN 2 AND 5), 6) AS margin, round(max(cos) FILTER (rank = 1) - avg(cos) FILTER (rank > 1), 6) AS margin_all FROM r GROUP BY qid""")
def margins(spark, sf):
    """How far the best hit stands from the next four, and from all others.

    The mean of all others follows from the sum of all vectors, so only five hits a query are ranked.  An item
    without another has neither, one with a single other no mean to stand from: null.
    """
    items = gallery(spark, sf)
    everyone = items.select(F.col("id").alias("qid"), F.col("img").alias("qv"))
    hits = retrieve.exact_blocks(everyone, items, 5, exclude_self=True)
    top = F.max(F.when(F.col("rank") == 1, F.col("score")))
    few = hits.groupBy("qid").agg(top.alias("top"), F.avg(F.when(F.col("rank") > 1, F.col("score"))).alias("next"))
    rows = everyone.join(few, "qid").crossJoin(F.broadcast(blocks.vector_sum(items)))
    others = (vec.dot("qv", "total") - vec.dot("qv", "qv") - F.col("top")) / F.when(F.col("n") > 2, F.col("n") - 2)
    return rows.select("qid", F.round(F.col("top") - F.col("next"), 6).alias("margin"), F.round(F.col("top") - others, 6).alias("margin_all"))


TAGS_SQL = f"""WITH {GALLERY}, vc AS (SELECT label, p, avg(img[p]) AS x FROM gallery, (SELECT unnest(range(1, 65)) AS p) GROUP BY label, p),
vv AS (SELECT 'c' || CAST(label AS VARCHAR) AS tag, list(x ORDER BY p) AS v FROM vc GROUP BY label), vocab AS (SELECT tag, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS tv FROM vv),
s AS (SELECT id, label, tag, list_dot_product(img, tv) AS score FROM gallery, vocab), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, tag) AS rank FROM s)
"""


def _tagged(spark, sf):
    from .vector_queries import mean_vectors

    items = gallery(spark, sf)
    vocab = mean_vectors(items, F.concat(F.lit("c"), F.col("label").cast("string"))).select(F.col("key").alias("tag"), vec.unit("mean").alias("tv"))
    s = items.crossJoin(F.broadcast(vocab)).select("id", "label", "tag", vec.dot("img", "tv").alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "tag")))


@query(TAGS_SQL + "SELECT id, tag, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 3")
def top_tags(spark, sf):
    """The three nearest words of a vocabulary (here the labels' mean vectors)."""
    return _tagged(spark, sf).where("rank <= 3").select("id", "tag", "rank", F.round("score", 6).alias("score"))


@query(TAGS_SQL + "SELECT count(DISTINCT id) AS n, count(*) FILTER (rank = 1 AND tag = 'c' || CAST(label AS VARCHAR)) AS top1, count(*) FILTER (rank <= 5 AND tag = 'c' || CAST(label AS VARCHAR)) AS top5, (SELECT count(*) FROM embeddings WHERE label IS NULL) AS skipped FROM r WHERE label IS NOT NULL")
def hit_rates(spark, sf):
    """How often the right word is first or among five, over items with a label; the others are counted as skipped."""
    hit = F.col("tag") == F.concat(F.lit("c"), F.col("label").cast("string"))
    known = F.col("label").isNotNull()
    return _tagged(spark, sf).agg(F.countDistinct(F.when(known, F.col("id"))).alias("n"), F.count_if(hit & (F.col("rank") == 1)).alias("top1"), F.count_if(hit & (F.col("rank") <= 5)).alias("top5"), F.countDistinct(F.when(~known, F.col("id"))).alias("skipped"))


@query(TAGS_SQL + ", p AS (SELECT id, tag, round_even(1 / (1 + exp(-5 * (score - 0.05))), 4) AS p FROM r) SELECT id, list(tag ORDER BY p DESC, tag) AS labels, max(p) AS best FROM p WHERE p >= 0.55 GROUP BY id")
def multi_label(spark, sf):
    """Every word whose probability clears the bar, best first; a set of any size."""
    p = _tagged(spark, sf).select("id", "tag", F.bround(1 / (1 + F.exp(-5 * (F.col("score") - 0.05))), 4).alias("p")).where("p >= 0.55")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("n"), "tag")))
    return p.groupBy("id").agg(F.transform(ordered, lambda x: x["tag"]).alias("labels"), F.max("p").alias("best"))


@query(f"""WITH {GALLERY}, n AS (SELECT count(*) AS n FROM embeddings), l AS (SELECT DISTINCT user_id, event_id % n AS id FROM events, n WHERE event_type IN ('click', 'purchase')),
c AS (SELECT user_id, p, avg(img[p]) AS x FROM l JOIN gallery USING (id), (SELECT unnest(range(1, 65)) AS p) GROUP BY user_id, p), u AS (SELECT user_id, list(x ORDER BY p) AS v FROM c GROUP BY user_id),
s AS (SELECT user_id, id, list_dot_product(img, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS score FROM u, gallery WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = u.user_id AND l.id = gallery.id)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT user_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def recommend(spark, sf):
    """Five items nearest to the mean of a user's likes, for all users."""
    out = rank.recommend(likes(spark, sf), gallery(spark, sf), 5)
    return out.select("user_id", "id", "rank", F.round("score", 6).alias("score"))



CAND_SQL = f"""WITH {GALLERY}, c AS (SELECT a.id AS qid, b.id, list_dot_product(a.img, b.img) AS cos_image, list_dot_product(a.txt, b.txt) AS cos_text, len(list_intersect(a.tags, b.tags)) AS tag_overlap FROM gallery a JOIN gallery b ON a.id <> b.id WHERE a.id % 20 = 0),
f AS (SELECT *, 1.0::DOUBLE / row_number() OVER (PARTITION BY qid ORDER BY cos_image DESC, id) AS rank_prior FROM c)
"""


def _asked(items: DataFrame) -> DataFrame:
    return items.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("img").alias("qv"), F.col("txt").alias("qt"), F.col("tags").alias("qtags"))


@query(CAND_SQL + """, s AS (SELECT *, 0.5 * (cos_image + cos_image * 6 * tag_overlap) + 0.5 * cos_text AS dcn FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dcn, 9) DESC, id) AS rank FROM s)
SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(dcn, 6) AS dcn_score FROM r WHERE rank <= 10""")
def cross_rerank(spark, sf):
    """Feature-cross re-ranking with one hand-set cross: image cosine by tag overlap."""
    items = gallery(spark, sf)
    hits = rank.reranked(_asked(items), items, rank.crossing(rank.hand_set(4, 2, 0, 0, 2, 6.0)), 10)
    return hits.select("qid", "id", "rank", F.round("score", 6).alias("dcn_score"))



@query(CAND_SQL + """, u AS (SELECT qid, avg(cos_image / 2 - 0.5) AS x1, avg(cos_text / 2 - 0.5) AS x2, avg(tag_overlap / 5.0::DOUBLE) AS x3, avg(rank_prior) AS x4 FROM f WHERE rank_prior >= 0.2 GROUP BY qid),
l AS (SELECT f.*, (1 + 0.75 * x1) * (cos_image / 2 - 0.5) + 0.75 * x2 * (cos_text / 2 - 0.5) + 0.75 * x3 * (tag_overlap / 5.0::DOUBLE) + 0.75 * x4 * rank_prior AS learned, (cos_image + cos_text) / 2 AS base FROM f JOIN u USING (qid)),
m AS (SELECT *, (base - min(base) OVER (PARTITION BY qid)) / (max(base) OVER (PARTITION BY qid) - min(base) OVER (PARTITION BY qid)) AS b, (learned - min(learned) OVER (PARTITION BY qid)) / (max(learned) OVER (PARTITION BY qid) - min(learned) OVER (PARTITION BY qid)) AS lr FROM l),
s AS (SELECT qid, id, (1 - 0.3125) * b + 0.3125 * lr AS score FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def learned_rerank(spark, sf):
    """Blend of base and learned scores after five likes a query (weights by Rocchio, n = 5)."""
    items = gallery(spark, sf)
    asked = _asked(items)
    liked = rank.best_candidates(asked, items, 5).select("qid", rank.features().alias("features"), F.lit(1).alias("label"))
    w = saved(rank.rocchio(liked, "qid"))
    hits = rank.reranked(asked.join(w, "qid"), items, rank.blending(5.0), 10, extra=("w",))
    return hits.select("qid", "id", "rank", F.round("score", 6).alias("score"))



@query()
def ranknet_fit(spark, sf):
    """Weights and importances per query from ordered feedback on its best candidates."""
    items = gallery(spark, sf)
    c = rank.best_candidates(_asked(items), items, 12).select(F.col("qid").alias("user_id"), F.col("rank").alias("seq"), rank.features().alias("features"), (F.col("id") % 2).cast("int").alias("label"))
    fit = rank.ranknet(c)
    return fit.select("user_id", "n", "n_pairs", F.transform("w", lambda x: F.round(x, 6)).alias("w"), F.transform(rank.importance(F.col("w")), lambda x: F.round(x, 3)).alias("importance"))


PHRASINGS = 4
MIN_MARGIN = 0.03  # fixed value: a phrasing is decisive from here
PHRASE_SQL = f"""WITH {GALLERY}, ph AS (SELECT a.id AS qid, k AS phrasing, list_transform(range(1, 65), lambda i: a.img[i] + k * 0.3 * b.img[i]) AS v FROM gallery a JOIN gallery b ON b.id = a.id + 100, (SELECT unnest(range(0, {PHRASINGS})) AS k) WHERE a.id % 20 = 0),
pu AS (SELECT qid, phrasing, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM ph),
s AS (SELECT qid, phrasing, id, (list_dot_product(img, v) + list_dot_product(txt, v)) / 2 AS score FROM pu, gallery), r AS (SELECT *, row_number() OVER (PARTITION BY qid, phrasing ORDER BY score DESC, id) AS rank FROM s),
m AS (SELECT qid, phrasing, round(max(score) FILTER (rank = 1) - avg(score) FILTER (rank > 1), 9) AS margin FROM r WHERE rank <= 5 GROUP BY qid, phrasing),
b AS (SELECT qid, CASE WHEN margin >= {MIN_MARGIN} THEN CAST(phrasing AS INTEGER) ELSE -1 END AS chose, margin FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY margin DESC, phrasing) AS n FROM m) WHERE n = 1),
en AS (SELECT qid, list(x ORDER BY p) AS v FROM (SELECT qid, p, avg(v[p]) AS x FROM pu, (SELECT unnest(range(1, 65)) AS p) GROUP BY qid, p) GROUP BY qid),
asked AS (SELECT b.*, coalesce(pu.v, list_transform(en.v, lambda x: x / sqrt(list_dot_product(en.v, en.v)))) AS v FROM b JOIN en USING (qid) LEFT JOIN pu ON pu.qid = b.qid AND pu.phrasing = b.chose),
h AS (SELECT qid, chose, margin, id, (list_dot_product(img, v) + list_dot_product(txt, v)) / 2 AS score FROM asked, gallery), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM h)
SELECT qid, chose, round(margin, 6) AS margin, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM k WHERE rank <= 5"""


def phrased(drafts, items, k=5, least=MIN_MARGIN):
    """(qid, chose, margin, rank, id, score): hits of each query's most decisive phrasing, or of all together.

    ``drafts`` holds (qid, phrasing, qv), unit vectors.  A phrasing's margin is its best hit's score over the
    mean of the other k - 1; where none reaches ``least``, the unit mean of all phrasings asks (``chose`` -1).
    """
    numbered = saved(drafts.withColumn("n", F.monotonically_increasing_id()))
    s = retrieve.exact_blocks(numbered.select(F.col("n").alias("qid"), "qv"), items, k, column=retrieve.MODES["fused"])
    s = s.withColumnRenamed("qid", "n").join(numbered.select("n", "qid", "phrasing"), "n")
    m = s.groupBy("qid", "phrasing").agg(F.round(F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.avg(F.when(F.col("rank") > 1, F.col("score"))), 9).alias("margin"))
    best = m.groupBy("qid").agg(F.max_by(F.struct("phrasing", "margin"), F.struct("margin", -F.col("phrasing"))).alias("b"))
    best = best.select("qid", F.when(F.col("b.margin") >= least, F.col("b.phrasing")).otherwise(-1).alias("chose"), F.col("b.margin").alias("margin"))
    mean = drafts.select("qid", F.posexplode("qv").alias("pos", "x")).groupBy("qid", "pos").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda x: x["x"]).alias("mv"))
    own = drafts.select("qid", F.col("phrasing").alias("chose"), "qv")
    asked = best.join(mean, "qid").join(own, ["qid", "chose"], "left").select("qid", "chose", "margin", F.coalesce("qv", vec.unit("mv")).alias("qv"))
    asked = saved(asked)
    hits = retrieve.exact_blocks(asked, items, k, column=retrieve.MODES["fused"], digits=9)
    return hits.join(asked.drop("qv"), "qid").select("qid", "chose", "margin", "rank", "id", "score")


@query(PHRASE_SQL)
def phrasing_search(spark, sf):
    """Four phrasings of each query: hits of the most decisive one, or of their ensemble if none is decisive."""
    items = gallery(spark, sf)
    other = items.select((F.col("id") - 100).alias("qid"), F.col("img").alias("b"))
    ph = queries(items).join(other, "qid").withColumn("phrasing", F.explode(F.sequence(F.lit(0), F.lit(PHRASINGS - 1))))
    ph = saved(ph.select("qid", "phrasing", vec.unit(vec.add("qv", vec.scaled("b", F.col("phrasing") * 0.3))).alias("qv")))
    return phrased(ph, items).withColumn("margin", F.round("margin", 6)).withColumn("score", F.round("score", 6))


@query()
def guarded_feedback(spark, sf):
    """Ledger of evaluator-guarded relevance feedback for every item with id % 20 = 0."""
    items = gallery(spark, sf)
    return retrieve.refine(queries(items), items)[1].select("qid", "pass", F.round("ev", 6).alias("ev"), F.round("margin", 6).alias("margin"), "verdict")


@query(f"""WITH {GALLERY} SELECT a.id AS i, b.id AS j FROM gallery a JOIN gallery b ON a.id < b.id WHERE list_dot_product(a.img, b.img) >= 0.35""")
def near_pairs(spark, sf):
    return dedupe.close_pairs(gallery(spark, sf), 0.35)


@query()
def greedy_dedup(spark, sf):
    return dedupe.greedy_keep(gallery(spark, sf), 0.35)


@query()
def ivf_train(spark, sf):
    """Trained cells: size and mean cosine to the centroid."""
    items = gallery(spark, sf).select("id", "img")
    c = index.kmeans(items, 16)
    f = index.filed(items, c)
    return f.groupBy("cell").agg(F.count("*").alias("n"))


@query()
def pq_train(spark, sf):
    """Mean squared reconstruction error of trained product codes and of rotated ones."""
    items = gallery(spark, sf).select("id", "img")
    out = []
    for name, (r, b) in (("pq", (None, index.pq_train(items, 8, 16))), ("opq", index.opq_train(items, 8, 16))):

        def err(batches, r=r, b=b):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                x = index.block(batch, 0)
                back = index.encode(x, b, r)[1]
                e = (((x if r is None else x @ r.T) - back) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(e))], names=["e"])

        out.append(items.select("img").mapInArrow(err, "e double").agg(F.round(F.avg("e"), 6).alias("mse")).select(F.lit(name).alias("model"), "mse"))
    return out[0].unionByName(out[1])


@query("SELECT 'i8' AS name, CAST(500 AS BIGINT) AS rows, count(*) AS now, count(*) IS DISTINCT FROM 500 AS stale FROM embeddings UNION ALL SELECT 'opq', 7, count(*), count(*) IS DISTINCT FROM 7 FROM embeddings UNION ALL SELECT 'ivf', NULL, count(*), true FROM embeddings")
def index_freshness(spark, sf):
    meta = spark.createDataFrame([("i8", 500), ("opq", 7), ("ivf", None)], "name string, rows long")
    return index.stale(meta, table(spark, sf, "embeddings"))


@query(f"""WITH {PAIRS}, r AS (SELECT qid, id, cos_image AS score, row_number() OVER (PARTITION BY qid ORDER BY cos_image DESC, id) AS rank FROM pairs),
m AS (SELECT unnest(['exact', 'blocks', 'int8']) AS method) SELECT method, qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r, m WHERE rank <= 5""")
def search_methods(spark, sf):
    """The same five hits by each method that ends in exact scores."""
    items, out = gallery(spark, sf), None
    scales = F.array_repeat(F.lit(1 / 127), 64)
    for method in ("exact", "blocks", "int8"):
        hits = search.search(queries(items), items, method=method, k=5, scales=scales).select(F.lit(method).alias("method"), "qid", "id", "rank", F.round("score", 6).alias("score"))
        out = hits if out is None else out.unionByName(hits)
    return out


#: Searches whose hits the recall query compares with exact ones: (name, stage of its rows, or none).
MEASURED = (("ivf_search", None), ("pq_search", "codes"), ("pq_search", "exact"), ("opq_search", "codes"), ("opq_search", "exact"), ("binary_search", None))
_HITS_SQL = " UNION ALL ".join(f"SELECT '{n}{'' if s is None else ' ' + s}' AS method, qid, id, rank FROM ({ORACLES[n]})" + ("" if s is None else f" WHERE stage = '{s}'") for n, s in MEASURED)


@query(f"""WITH {PAIRS}, t AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY cos_image DESC, id) AS place FROM pairs), h AS ({_HITS_SQL}), k AS (SELECT unnest([1, 10]) AS k),
n AS (SELECT count(DISTINCT qid) AS n FROM t) SELECT method, k.k, round(count(t.id) / (max(n.n) * k.k), 6) AS recall FROM k JOIN h ON h.rank <= k.k LEFT JOIN t ON t.qid = h.qid AND t.id = h.id AND t.place <= k.k, n GROUP BY method, k.k""")
def recall_bench(spark, sf):
    """Recall@1 and @10 of the searches by codes and cells against exact search, for every stated query."""
    items = gallery(spark, sf)
    asked = queries(items)
    hits = None
    ran = {name: saved(QUERIES[name](spark, sf)) for name in dict.fromkeys(n for n, _ in MEASURED)}
    for name, stage in MEASURED:
        found = ran[name]
        found = (found if stage is None else found.where(F.col("stage") == stage)).select(F.lit(name if stage is None else f"{name} {stage}").alias("method"), "qid", "id", "rank")
        hits = found if hits is None else hits.unionByName(found)
    true = saved(retrieve.exact_blocks(asked, items, 10).select("qid", "id", F.col("rank").alias("place")))
    return search.recall(hits, true, asked, (1, 10)).select("method", "k", F.round("recall", 6).alias("recall"))
