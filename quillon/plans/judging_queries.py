"""Councils, trust, deliberation and decisions for each query's best result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import calibrate as cal
from ..operators import blocks, judge, retrieve
from ..sources.gallery import gallery
from .registry import GALLERY, LOO, query

#: Best other result of each item, fused, with the margin over the others.
BEST_SQL = f"""{GALLERY}, s AS (SELECT a.id AS qid, b.id, (list_dot_product(a.img, b.img) + list_dot_product(a.txt, b.txt)) / 2 AS cos, list_dot_product(a.img, b.img) AS icos, a.tags AS qtags, b.tags AS rtags FROM gallery a JOIN gallery b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM s),
m AS (SELECT qid, max(cos) FILTER (rank = 1) - avg(cos) FILTER (rank > 1) AS margin FROM r GROUP BY qid),
best AS (SELECT r.*, margin FROM r JOIN m USING (qid) WHERE rank = 1)"""
VOTES_SQL = BEST_SQL + """, v AS (SELECT *, least(1, greatest(0, (cos * 3 - 0.65) / (0.90 - 0.65))) AS relevance, len(list_filter(qtags, lambda t: list_contains(rtags, t))) / greatest(len(qtags), 1)::DOUBLE AS specificity,
CASE WHEN list_contains(rtags, qtags[1]) THEN 1.0 WHEN list_has_any(qtags, rtags) THEN 0.5 ELSE 0.0 END::DOUBLE AS faithful FROM best),
c0 AS (SELECT *, (relevance + specificity * 0.7 + faithful * 0.6) / (1 + 0.7 + 0.6) AS mean, greatest(relevance, specificity, faithful) - least(relevance, specificity, faithful) AS spread FROM v),
c AS (SELECT *, CASE WHEN spread > 0.5 THEN 'abstain' WHEN mean >= 0.5 THEN 'relevant' ELSE 'not relevant' END AS decision FROM c0)"""


def best_results(spark, sf):
    """(qid, id, cos, icos, margin, qtags, tags): the top other item, scored on a wider scale below.

    Cosines here are small, so rubrics read three times the cosine.
    """
    items = gallery(spark, sf).withColumn("both", vec.scaled(F.concat("img", "txt"), F.lit(0.5**0.5)))
    q = items.select(F.col("id").alias("qid"), F.col("both").alias("qv"), F.col("img").alias("qi"), F.col("tags").alias("qtags"))
    top = retrieve.exact_blocks(q, items, 1, column="both", exclude_self=True).select("qid", "id", F.col("score").alias("cos"))
    r = top.join(q, "qid").join(items.select("id", "img", "tags"), "id").crossJoin(F.broadcast(blocks.vector_sum(items, "both")))
    # the mean of all others follows from the sum of all vectors
    others = (vec.dot("qv", "total") - vec.dot("qv", "qv") - F.col("cos")) / (F.col("n") - 2)
    return r.select("qid", "id", "qtags", "tags", "cos", vec.dot("qi", "img").alias("icos"), (F.col("cos") - others).alias("margin"))


def ruled(spark, sf):
    b = best_results(spark, sf).withColumn("votes", judge.heuristic_votes(F.col("cos") * 3, F.col("qtags"), F.col("tags")))
    return b.withColumn("council", judge.council(F.col("votes")))


@query(f"WITH {VOTES_SQL} SELECT qid, id, decision, CASE WHEN spread > 0.5 THEN 'hung jury' ELSE 'ruled' END AS reason, round(mean, 6) AS mean, round(greatest(0, 1 - spread), 6) AS consensus FROM c")
def council(spark, sf):
    return ruled(spark, sf).select("qid", "id", "council.decision", "council.reason", F.round("council.mean", 6).alias("mean"), F.round("council.consensus", 6).alias("consensus"))


@query(f"WITH {VOTES_SQL}, y AS (SELECT qid, (relevance >= 0.5)::INT + (specificity >= 0.5)::INT + (faithful >= 0.5)::INT AS yes FROM v) SELECT qid, yes, 3 - yes AS no, CASE WHEN yes > 1 THEN 'relevant' ELSE 'not relevant' END AS decision FROM y")
def majority_vote(spark, sf):
    return ruled(spark, sf).select("qid", judge.majority(F.col("votes")).alias("m")).select("qid", "m.yes", "m.no", "m.decision")


DEBATE_CTE = f"""WITH RECURSIVE {VOTES_SQL}, d(qid, x0, w, x, rounds, done) AS (
SELECT qid, [relevance, specificity, faithful], [1.0::DOUBLE, 0.7::DOUBLE, 0.6::DOUBLE], [relevance, specificity, faithful], 0, false FROM v
UNION ALL SELECT qid, x0, w, nx, rounds + 1, list_max(list_transform([1, 2, 3], lambda i: abs(nx[i] - x[i]))) < 1e-4 FROM (
  SELECT *, list_transform(x, lambda a: list_sum(list_transform([1, 2, 3], lambda i: CASE WHEN abs(x[i] - a) <= 0.3 + 1e-12 THEN x[i] * w[i] ELSE 0 END)) / list_sum(list_transform([1, 2, 3], lambda i: CASE WHEN abs(x[i] - a) <= 0.3 + 1e-12 THEN w[i] ELSE 0 END))) AS nx FROM d WHERE NOT done AND rounds < 12)),
f AS (SELECT qid, x0, w, x, rounds, list_sort(x) AS s FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rounds DESC) = 1),
g AS (SELECT *, 1 + (s[2] - s[1] > 0.3 + 1e-12)::INT + (s[3] - s[2] > 0.3 + 1e-12)::INT AS factions, list_sum(list_transform([1, 2, 3], lambda i: ((x0[i] >= 0.5) <> (x[i] >= 0.5))::INT)) AS flips, (x[1] * w[1] + x[2] * w[2] + x[3] * w[3]) / (w[1] + w[2] + w[3]) AS score FROM f)"""


def debate_verdict():
    """The panel's ruling after deliberation: contested panels abstain."""
    return F.when(F.col("factions") > 1, "abstain").when(F.col("debate_score") >= 0.5, "relevant").otherwise("not relevant")


def debated(spark, sf):
    x, w = F.transform("votes", lambda v: v["score"]), F.transform("votes", lambda v: v["confidence"])
    d = ruled(spark, sf).withColumn("x0", x).withColumn("w", w).withColumn("d", judge.debate(F.col("x0"), F.col("w")))
    d = d.withColumn("factions", judge.n_factions(F.col("d.x"))).withColumn("flips", F.size(F.filter(F.zip_with("x0", F.col("d.x"), lambda a, b: (a >= 0.5) != (b >= 0.5)), lambda z: z)))
    return d.withColumn("debate_score", F.when(F.col("factions") == 1, judge.weighted(F.col("d.x"), F.col("w"))))


@query(DEBATE_CTE + " SELECT qid, rounds, factions, CAST(flips AS INTEGER) AS flips, round(CASE WHEN factions = 1 THEN score END, 6) AS score, CASE WHEN factions > 1 THEN 'abstain' WHEN score >= 0.5 THEN 'relevant' ELSE 'not relevant' END AS verdict FROM g")
def debate(spark, sf):
    d = debated(spark, sf)
    return d.select("qid", "d.rounds", "factions", "flips", F.round("debate_score", 6).alias("score"), debate_verdict().alias("verdict"))


@query(DEBATE_CTE + " SELECT count(*) AS n, count(*) FILTER (factions = 1) AS consensus, count(*) FILTER (factions > 1) AS contested, count(*) FILTER (flips > 0) AS flipped, count(*) FILTER (CASE WHEN factions > 1 THEN 'abstain' WHEN score >= 0.5 THEN 'relevant' ELSE 'not relevant' END <> decision) AS changed FROM g JOIN c USING (qid)")
def debate_counts(spark, sf):
    d = debated(spark, sf)
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("factions") == 1).alias("consensus"), F.count_if(F.col("factions") > 1).alias("contested"), F.count_if(F.col("flips") > 0).alias("flipped"), F.count_if(debate_verdict() != F.col("council.decision")).alias("changed"))


LENS_SQL = DEBATE_CTE + f""", {LOO.replace(GALLERY + ", ", "")}, sc AS (SELECT 1 - max(cos) AS score FROM loo WHERE rel GROUP BY qid), sr AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM sc),
tau AS (SELECT 1 - score AS tau FROM sr WHERE r = ceil((n + 1)::DOUBLE * (1.0::DOUBLE - 0.2::DOUBLE))),
l AS (SELECT c.qid, c.id, c.decision, g.factions, CASE WHEN cos >= 0.30 THEN 1.0 WHEN cos >= 0.25 THEN 0.7 WHEN cos >= 0.20 THEN 0.4 ELSE 0.1 END::DOUBLE AS gate,
CASE WHEN icos >= tau - 1e-9 THEN least(1, 0.5 + 0.5 * (icos - tau) / greatest(1 - tau, 1e-6)) END AS conformal, CASE WHEN decision <> 'abstain' THEN mean END AS council, least(1, greatest(0, margin / 0.15)) AS margin_t, cos, icos, margin, tau FROM c JOIN g USING (qid), tau),
t0 AS (SELECT *, 2 + (conformal IS NOT NULL)::INT + (council IS NOT NULL)::INT AS nv, (gate * 1.0 + coalesce(conformal * 1.0, 0) + coalesce(council * 1.2, 0) + margin_t * 0.7) / (1.0 + (conformal IS NOT NULL)::INT * 1.0 + (council IS NOT NULL)::INT * 1.2 + 0.7) AS score, greatest(gate, conformal, council, margin_t) - least(gate, conformal, council, margin_t) AS sp FROM l),
t AS (SELECT *, CASE WHEN sp > 0.5 THEN 'abstain' WHEN score >= 0.66 AND nv >= 3 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level, CASE WHEN sp > 0.5 THEN 'split decision' WHEN score >= 0.66 AND nv < 3 THEN 'capped' ELSE 'composed' END AS reason FROM t0)"""

#: Weights of the four lenses.
WEIGHTS = {"gate": 1.0, "conformal": 1.0, "council": 1.2, "margin": 0.7}


def trusted(spark, sf):
    from .monitoring_queries import loo_scores

    tau = cal.calibrate(loo_scores(spark, sf), [0.2]).select((1 - F.col("qhat")).alias("tau"))
    d = debated(spark, sf).crossJoin(F.broadcast(tau))
    lens = {"gate": judge.gate_trust(F.col("cos"), 0.30, 0.25, 0.20), "conformal": judge.conformal_trust(F.col("icos"), F.col("tau")), "council": F.when(F.col("council.decision") != "abstain", F.col("council.mean")), "margin": judge.margin_trust(F.col("margin"))}
    signals = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("trust"), F.lit(WEIGHTS[k]).alias("weight")) for k, v in lens.items()])
    return d.withColumn("signals", signals).withColumn("trust", judge.compose(F.col("signals")))


@query(LENS_SQL + " SELECT qid, id, level, reason, round(score, 6) AS score, nv AS n_valid, round(gate, 6) AS gate, round(conformal, 6) AS conformal, round(council, 6) AS council, round(margin_t, 6) AS margin FROM t")
def trust(spark, sf):
    t = trusted(spark, sf)
    lens = [F.round(F.get("signals", F.lit(i))["trust"], 6).alias(k) for i, k in enumerate(WEIGHTS)]
    return t.select("qid", "id", "trust.level", "trust.reason", F.round("trust.score", 6).alias("score"), "trust.n_valid", *lens)


#: The cases of ``judge.OUTCOMES``, in order, as SQL conditions.
CASES = {
    "high": "level = 'high'",
    "factions": "level = 'abstain' AND factions > 1",
    "split": "level = 'abstain' AND reason = 'split decision'",
    "thin": "level = 'abstain'",
    "unconfirmed": "level = 'medium' AND decision = 'abstain'",
    "missed": "level = 'medium' AND decision = 'relevant'",
    "against": "level = 'medium'",
    "poor": "true",
}


def _outcome_sql(n: int) -> str:
    said = {case: values[n].replace("'", "''") for case, values in judge.OUTCOMES.items()}
    return "CASE " + " ".join(f"WHEN {fits} THEN '{said[case]}'" for case, fits in CASES.items()) + f" END AS {judge.FIELDS[n]}"


@query(LENS_SQL + " SELECT qid, " + ", ".join(map(_outcome_sql, range(4))) + " FROM t")
def decision(spark, sf):
    t = trusted(spark, sf)
    a = judge.action(F.col("trust.level"), F.col("trust.reason"), F.col("factions") > 1, F.col("council.decision"))
    return t.select("qid", a.alias("a")).select("qid", *[f"a.{f}" for f in judge.FIELDS])


def half_up(x):
    """Two digits, halves away from zero on the absolute value."""
    return F.floor(F.abs(x) * 100 + 0.5) / 100 * F.signum(x)


@query(LENS_SQL + """, st AS (SELECT qid, 1 AS step, 'retrieve' AS stage, cos AS signal, CASE WHEN cos >= 0.25 THEN 'ok' ELSE 'caution' END AS status FROM t UNION ALL SELECT qid, 2, 'rank', margin, CASE WHEN margin >= 0.03 THEN 'ok' ELSE 'caution' END FROM t
UNION ALL SELECT qid, 3, 'conformal', icos, CASE WHEN icos < tau - 1e-9 THEN 'stop' ELSE 'ok' END FROM t UNION ALL SELECT c.qid, 4, 'council', mean, CASE WHEN decision = 'abstain' THEN 'stop' WHEN decision = 'relevant' THEN 'ok' ELSE 'caution' END FROM c
UNION ALL SELECT qid, 5, 'debate', CASE WHEN factions = 1 THEN score END, CASE WHEN factions = 1 THEN 'ok' ELSE 'stop' END FROM g UNION ALL SELECT qid, 6, 'trust', score, CASE WHEN level = 'abstain' THEN 'stop' WHEN level = 'high' THEN 'ok' ELSE 'caution' END FROM t)
SELECT qid, step, stage, round(signal, 6) AS signal, status FROM st""")
def reasoning_trace(spark, sf):
    """The ordered steps behind each decision."""
    t = trusted(spark, sf)
    ok = lambda good, stop=F.lit(False): F.when(stop, "stop").when(good, "ok").otherwise("caution")
    low = F.col("icos") < F.col("tau") - 1e-9
    steps = [
        ("retrieve", F.col("cos"), ok(F.col("cos") >= 0.25)),
        ("rank", F.col("margin"), ok(F.col("margin") >= 0.03)),
        ("conformal", F.col("icos"), ok(~low, low)),
        ("council", F.col("council.mean"), ok(F.col("council.decision") == "relevant", F.col("council.decision") == "abstain")),
        ("debate", F.col("debate_score"), ok(F.col("factions") == 1, F.col("factions") > 1)),
        ("trust", F.col("trust.score"), ok(F.col("trust.level") == "high", F.col("trust.level") == "abstain")),
    ]
    rows = t.select("qid", F.posexplode(F.array(*[F.struct(F.lit(a).alias("stage"), b.alias("signal"), c.alias("status")) for a, b, c in steps])).alias("p", "s"))
    return rows.select("qid", (F.col("p") + 1).alias("step"), "s.stage", F.round("s.signal", 6).alias("signal"), "s.status")


#: Judges' replies of every accepted and rejected form.
REPLIES = ("0.7", ".7", "7/10", "8 out of 10", "70%", "score: 0.9", "relevant", "2.5", "150%", "1.5", "12/10", "-0.5", "0 / 0", "I'd say 3 out of 4!", "", "1.0", "0")


@query("WITH r(reply) AS (VALUES " + ", ".join("('" + r.replace("'", "''") + "')" for r in REPLIES) + r"""), p AS (SELECT reply, lower(reply) AS t, TRY_CAST(regexp_extract(lower(reply), '([0-9]+(?:\.[0-9]+)?)\s*(?:/|\s+out\s+of\s+)\s*([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(lower(reply), '([0-9]+(?:\.[0-9]+)?)\s*(?:/|\s+out\s+of\s+)\s*([0-9]+(?:\.[0-9]+)?)', 2) AS DOUBLE) AS b,
TRY_CAST(regexp_extract(lower(reply), '([0-9]+(?:\.[0-9]+)?)\s*%', 1) AS DOUBLE) AS pct, TRY_CAST(regexp_extract(' ' || lower(reply) || ' ', '[^0-9.](0?\.[0-9]+|[01]\.0+|[01])[^0-9]', 1) AS DOUBLE) AS bare FROM r)
SELECT reply, round(coalesce(CASE WHEN b > 0 AND a <= b THEN a / b END, CASE WHEN pct BETWEEN 0 AND 100 THEN pct / 100 END, CASE WHEN bare BETWEEN 0 AND 1 THEN bare END), 6) AS score FROM p""")
def parse_scores(spark, sf):
    return spark.createDataFrame([(r,) for r in REPLIES], "reply string").select("reply", F.round(judge.parse_score(F.col("reply")), 6).alias("score"))
