"""Conformal calibration and drift monitoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibrate as cal
from ..operators import retrieve
from ..session import new_path, saved, table
from ..sources.gallery import gallery, queries
from ..sources.store import numbered
from ..streaming import jobs
from .registry import GALLERY, LOO, query

ALPHAS = [0.4, 0.3, 0.2, 0.1, 0.05]
SCORES_SQL = LOO + ", sc AS (SELECT qid, 1 - max(cos) AS score FROM loo WHERE rel GROUP BY qid)"
ALPHA_SQL = "al AS (SELECT unnest([0.4, 0.3, 0.2, 0.1, 0.05])::DOUBLE AS alpha)"
WINDOWS_SQL = """ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-11'), live AS (SELECT strftime(ts, '%Y-%m-%d') AS window_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-11')"""


def best_of_tags(items, by="img"):
    """(qid, best, best_id): each item's nearest other item that shares a tag, asked for by either tower."""
    return retrieve.best_sharing(items.select(F.col("id").alias("qid"), F.col(by).alias("qv"), F.col("tags").alias("qtags")), items)


def loo_scores(spark, sf, by="img"):
    """(qid, score): one minus the best cosine among other items that share a tag; others drop out."""
    return best_of_tags(gallery(spark, sf), by).select("qid", (1 - F.col("best")).alias("score"))


@query(f"WITH {SCORES_SQL} SELECT qid, round(score, 6) AS score FROM sc")
def conformal_scores(spark, sf):
    return loo_scores(spark, sf).select("qid", F.round("score", 6).alias("score"))


CROSS_SQL = f"WITH {GALLERY}, sc AS (SELECT a.id AS qid, 1 - max(list_dot_product(a.txt, b.img)) AS score FROM gallery a JOIN gallery b ON a.id <> b.id AND list_has_any(a.tags, b.tags) GROUP BY a.id)"


@query(CROSS_SQL + " SELECT qid, round(score, 6) AS score FROM sc")
def conformal_cross(spark, sf):
    """Calibration scores of text queries against images: one tower asks, the other answers."""
    return loo_scores(spark, sf, "txt").select("qid", F.round("score", 6).alias("score"))


@query(f"""WITH {SCORES_SQL}, {ALPHA_SQL}, r AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM sc),
k AS (SELECT alpha, max(n) AS n, ceil((max(n) + 1)::DOUBLE * (1.0::DOUBLE - alpha)) AS k FROM al, r GROUP BY alpha)
SELECT alpha, k.n, round(coalesce(r.score, 'infinity'::DOUBLE), 6) AS qhat FROM k LEFT JOIN r ON r.r = k.k""")
def calibrate(spark, sf):
    return cal.calibrate(loo_scores(spark, sf), ALPHAS).select("alpha", "n", F.round("qhat", 6).alias("qhat"))


@query(f"""WITH {SCORES_SQL}, {ALPHA_SQL}, r AS (SELECT round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9)) AS r, count(*) OVER () AS n FROM sc),
k AS (SELECT alpha, score, r, n, ceil(n::DOUBLE * (1.0::DOUBLE - alpha)) AS k FROM r, al),
j AS (SELECT k.alpha, CASE WHEN k.k > k.n - 1 THEN 1 WHEN k.r > k.k THEN (k.score <= a.score)::INT ELSE (k.score <= b.score)::INT END AS hit FROM k LEFT JOIN r a ON a.r = k.k LEFT JOIN r b ON b.r = k.k + 1)
SELECT alpha, round(avg(hit), 6) AS coverage FROM j GROUP BY alpha""")
def jackknife_coverage(spark, sf):
    s = loo_scores(spark, sf).select(F.round("score", 9).alias("score"))
    return cal.jackknife(s, ALPHAS).select("alpha", F.round("coverage", 6).alias("coverage"))


@query(f"""WITH {SCORES_SQL}, {ALPHA_SQL}, r AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM sc),
k AS (SELECT alpha, max(n) AS n, ceil((max(n) + 1)::DOUBLE * (1.0::DOUBLE - alpha)) AS k FROM al, r GROUP BY alpha),
q AS (SELECT alpha, 1 - coalesce(r.score, 'infinity'::DOUBLE) AS tau FROM k LEFT JOIN r ON r.r = k.k),
p AS (SELECT a.id AS qid, list_dot_product(a.img, b.img) AS cos FROM gallery a, gallery b), n AS (SELECT count(*) AS n FROM gallery),
cv AS (SELECT alpha, avg((1 - score >= tau)::INT) AS coverage FROM q, sc GROUP BY alpha)
SELECT alpha, round(CASE WHEN tau > -1e300 THEN tau END, 6) AS tau, round((sum(CASE WHEN cos >= tau THEN 1 ELSE 0 END) / max(n))::DOUBLE - 1, 6) AS avg_set, round(max(coverage), 6) AS coverage FROM q JOIN cv USING (alpha), p, n GROUP BY alpha, tau""")
def conformal_sets(spark, sf):
    """Mean size of the conformal sets, the query itself not counted, with the share of items whose best match is inside."""
    items = gallery(spark, sf)
    scores = saved(loo_scores(spark, sf))
    bars = saved(cal.calibrate(scores, ALPHAS).select("alpha", (1 - F.col("qhat")).alias("tau")))
    everyone = items.select(F.col("id").alias("qid"), F.col("img").alias("qv"))
    over = retrieve.counts_over(everyone, items, [r["tau"] for r in bars.collect()]).distinct()
    n = items.agg(F.count("*").alias("n"))
    inside = scores.crossJoin(F.broadcast(bars)).groupBy("alpha").agg(F.avg((1 - F.col("score") >= F.col("tau")).cast("int")).alias("coverage"))
    rows = bars.join(over, F.col("tau") == F.col("bar")).join(inside, "alpha").crossJoin(F.broadcast(n))
    return rows.select("alpha", F.round(F.when(F.col("tau") > -1e300, F.col("tau")), 6).alias("tau"), F.round(F.col("hits") / F.col("n") - 1, 6).alias("avg_set"), F.round("coverage", 6).alias("coverage"))


@query(f"""WITH {GALLERY}, q AS (SELECT id AS qid, img AS qv FROM gallery WHERE id % 20 = 0), s AS (SELECT qid, id, list_dot_product(img, qv) AS cos FROM q, gallery)
SELECT qid, id, round(cos, 6) AS cos, CAST(row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS INTEGER) AS rank FROM s WHERE cos >= 0.25""")
def threshold_filter(spark, sf):
    """The conformal set at a given bar, best first."""
    items = gallery(spark, sf)
    s = retrieve.score_all(queries(items), items).where("score >= 0.25")
    return s.select("qid", "id", F.round("score", 6).alias("cos"), F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")).alias("rank"))


@query(f"WITH {LOO} SELECT count(*) AS n, round(avg(cos), 6) AS mean, round(min(cos), 6) AS low, round(max(cos), 6) AS high FROM loo WHERE rel")
def quality_signal(spark, sf):
    """The population of same-tag pairs' cosines, both directions."""
    return retrieve.sharing_stats(gallery(spark, sf)).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(f"WITH {LOO}, i AS (SELECT qid AS id, coalesce(max(cos) FILTER (rel), 0) AS q FROM loo GROUP BY qid) SELECT id, round(q, 6) AS quality, q >= 0.3 AS positive FROM i")
def item_quality(spark, sf):
    """Each item's best same-tag cosine (0 if it has none), split at a bar."""
    items = gallery(spark, sf)
    best = best_of_tags(items).select("qid", F.col("best").alias("q"))
    q = F.coalesce("q", F.lit(0.0))
    return items.select("id").join(best, F.col("id") == F.col("qid"), "left").select("id", F.round(q, 6).alias("quality"), (q >= 0.3).alias("positive"))


def windows(spark, sf):
    e = table(spark, sf, "events")
    return e.where("ts < timestamp'2024-01-11'").select("value"), e.where("ts >= timestamp'2024-01-11'").select(F.date_format("ts", "yyyy-MM-dd").alias("window_id"), "value")


PSI_SQL = f"""WITH {WINDOWS_SQL}, e AS (SELECT list_sort(list_distinct(quantile_cont(value, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]))) AS edges FROM ref),
rb AS (SELECT len(list_filter(edges[2:len(edges) - 1], lambda x: x <= value)) AS bin, count(*) AS n FROM ref, e GROUP BY 1), lb AS (SELECT window_id, len(list_filter(edges[2:len(edges) - 1], lambda x: x <= value)) AS bin, count(*) AS n FROM live, e GROUP BY 1, 2),
g AS (SELECT window_id, bin, t FROM (SELECT window_id, count(*) AS t FROM live GROUP BY 1), (SELECT unnest(range(0, len(edges) - 1)) AS bin FROM e)),
j AS (SELECT g.window_id, greatest(coalesce(rb.n, 0) / (SELECT count(*) FROM ref)::DOUBLE, 1e-6) AS a, greatest(coalesce(lb.n, 0) / t::DOUBLE, 1e-6) AS b FROM g LEFT JOIN rb USING (bin) LEFT JOIN lb ON lb.window_id = g.window_id AND lb.bin = g.bin),
psi AS (SELECT window_id, sum((b - a) * ln(b / a)) AS psi FROM j GROUP BY window_id)"""
KS_SQL = """v AS (SELECT DISTINCT value FROM ref UNION SELECT DISTINCT value FROM live), w AS (SELECT window_id, count(*) AS m FROM live GROUP BY 1), nr AS (SELECT count(*) AS n FROM ref),
rc AS (SELECT value, count(*) AS c FROM ref GROUP BY 1), lc AS (SELECT window_id, value, count(*) AS c FROM live GROUP BY 1, 2),
cum AS (SELECT w.window_id, m, n, sum(coalesce(rc.c, 0)) OVER o AS ca, sum(coalesce(lc.c, 0)) OVER o AS cb FROM w CROSS JOIN nr CROSS JOIN v LEFT JOIN rc ON rc.value = v.value LEFT JOIN lc ON lc.window_id = w.window_id AND lc.value = v.value WINDOW o AS (PARTITION BY w.window_id ORDER BY v.value)),
ks AS (SELECT window_id, max(abs(ca / n::DOUBLE - cb / m::DOUBLE)) AS ks, max(n) AS n_ref, max(m) AS n_live FROM cum GROUP BY 1)"""


@query(PSI_SQL + " SELECT window_id, round(psi, 6) AS psi FROM psi")
def psi_windows(spark, sf):
    return cal.psi(*windows(spark, sf)).select("window_id", F.round("psi", 6).alias("psi"))


@query(f"WITH {WINDOWS_SQL}, {KS_SQL} SELECT window_id, round(ks, 6) AS ks, n_ref, n_live, round(1.36 * sqrt((n_ref + n_live) / (n_ref * n_live)::DOUBLE), 6) AS critical FROM ks")
def ks_windows(spark, sf):
    k = cal.ks(*windows(spark, sf))
    return k.select("window_id", F.round("ks", 6).alias("ks"), "n_ref", "n_live", F.round(cal.ks_critical(F.col("n_ref"), F.col("n_live")), 6).alias("critical"))


DRIFT_SQL = PSI_SQL + f""", {KS_SQL}, rs AS (SELECT 1 - value AS s, row_number() OVER (ORDER BY 1 - value) AS r, count(*) OVER () AS n FROM ref), qh AS (SELECT s AS qhat FROM rs WHERE r = ceil((n + 1)::DOUBLE * (1.0::DOUBLE - 0.2::DOUBLE))),
cov AS (SELECT window_id, avg((value >= 1 - qhat)::INT) AS coverage, max(1 - qhat) AS bar FROM live, qh GROUP BY 1),
d AS (SELECT window_id, psi, ks, 1.36 * sqrt((n_ref + n_live) / (n_ref * n_live)::DOUBLE) AS crit, coverage, bar FROM psi JOIN ks USING (window_id) JOIN cov USING (window_id))
"""


@query(DRIFT_SQL + """SELECT window_id, round(psi, 6) AS psi, round(ks, 6) AS ks, round(coverage, 6) AS coverage, round(bar, 6) AS bar,
CASE WHEN psi > 0.25 OR ks > crit OR coverage < 0.8 - 0.1 THEN 'drift' WHEN psi > 0.1 OR ks > crit * 0.75 THEN 'shift' ELSE 'stable' END AS level,
concat_ws(',', CASE WHEN psi > 0.25 THEN 'psi' END, CASE WHEN ks > crit THEN 'ks' END, CASE WHEN coverage < 0.8 - 0.1 THEN 'coverage' END) AS reasons FROM d""")
def drift_monitor(spark, sf):
    """Verdicts of daily windows against the first ten days."""
    m = cal.monitor(*windows(spark, sf))
    return m.select("window_id", *[F.round(c, 6).alias(c) for c in ("psi", "ks", "coverage", "bar")], "level", F.array_join("reasons", ",").alias("reasons"))


@query(DRIFT_SQL + "SELECT true AS frozen, count(*) FILTER (psi > 0.25 OR ks > crit OR coverage < 0.8 - 0.1) AS drifted, count(*) FILTER (psi > 0.25 OR ks > crit OR coverage < 0.8 - 0.1) = 0 AS passed FROM d")
def drift_gate(spark, sf):
    """The verdict row of a scheduled gate."""
    return cal.gate(*windows(spark, sf))


#: Shares of contaminated rows of the four simulated windows.
STREAM = (("t0", 0.0), ("t1", 0.15), ("t2", 0.35), ("t3", 0.6))


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, value FROM events), c AS (SELECT count(*) AS n FROM s), f AS (SELECT * FROM (VALUES ('t0', 0.0::DOUBLE), ('t1', 0.15::DOUBLE), ('t2', 0.35::DOUBLE), ('t3', 0.6::DOUBLE)) t(window_id, frac)),
k AS (SELECT window_id, n, CAST(floor(frac * n + 0.5) AS BIGINT) AS k FROM f, c), h AS (SELECT window_id, (i * n) // k AS seq FROM (SELECT window_id, n, k, unnest(range(0, k)) AS i FROM k))
SELECT k.window_id, count(*) AS n, count(h.seq) AS hit, round(sum(CASE WHEN h.seq IS NOT NULL THEN greatest(0, value - 0.2) ELSE value END), 4) AS total FROM k CROSS JOIN s LEFT JOIN h ON h.window_id = k.window_id AND h.seq = s.seq GROUP BY 1""")
def contaminated_windows(spark, sf):
    """The simulated stream: growing shares of the values lowered by 0.2."""
    s = numbered(table(spark, sf, "events").select("event_id", "value"), ["event_id"], name="seq")
    out = None
    for name, f in STREAM:
        part = cal.contaminate(s, f, mark="hit").agg(F.count("*").alias("n"), F.count_if("hit").alias("hit"), F.round(F.sum("value"), 4).alias("total")).select(F.lit(name).alias("window_id"), "n", "hit", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), h AS (SELECT least(11, CAST(floor((value - lo) / (hi - lo) * 12) AS INTEGER)) AS bin FROM events, b) SELECT bin, count(*) AS n FROM h GROUP BY bin""")
def histogram(spark, sf):
    """Twelve equal bins, the last closed: the dashboard's bars."""
    e = table(spark, sf, "events").select("value")
    ends = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.least(F.lit(11), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 12).cast("int"))
    return e.crossJoin(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def quantiles(spark, sf):
    """Exact quantiles with linear interpolation."""
    q = cal.quantiles(table(spark, sf, "events"), [0.5, 0.9], key="event_type")
    at = lambda p: F.round(F.max(F.when(F.col("p") == p, F.col("q"))), 6)
    return q.groupBy("event_type").agg(at(0.5).alias("median"), at(0.9).alias("p90"))


@query("SELECT 'first' AS run, false AS frozen, CAST(NULL AS VARCHAR) AS level, true AS passed UNION ALL SELECT 'same', true, 'stable', true")
def drift_reference(spark, sf):
    """A gate over a written reference: the first run freezes it and passes, the next compares with it."""
    path, signal = new_path(spark, "reference"), windows(spark, sf)[0]
    first = cal.gate_at(spark, path, signal).withColumn("run", F.lit("first"))
    return first.unionByName(cal.gate_at(spark, path, signal).withColumn("run", F.lit("same"))).select("run", "frozen", "level", "passed")


@query(DRIFT_SQL + """SELECT window_id, CASE WHEN psi > 0.25 OR ks > crit OR coverage < 0.8 - 0.1 THEN 'drift' WHEN psi > 0.1 OR ks > crit * 0.75 THEN 'shift' ELSE 'stable' END AS level FROM d""")
def stream_monitor(spark, sf):
    """The events after the first ten days as a stream, judged against those."""
    reference, folder = windows(spark, sf)[0], new_path(spark, "monitor")
    live = jobs.events(spark, sf).where("ts >= timestamp'2024-01-11'")
    jobs.monitor(live, reference, f"{folder}/rows", checkpoint=f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("window_id", "level")
