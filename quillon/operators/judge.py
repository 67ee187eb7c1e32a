"""Panels: score parsing, weighted councils, majorities, deliberation, composed trust, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quorum, thresholds and weights of the panels.
QUORUM, HUNG, ACCEPT = 2, 0.5, 0.5
HIGH, MEDIUM, SPLIT, MIN_FOR_HIGH = 0.66, 0.40, 0.5, 3
EPS_OPINION, ROUNDS, TOL = 0.30, 12, 1e-4
REL_LO, REL_HI = 0.65, 0.90


def parse_score(text: Column) -> Column:
    """A score in 0..1 from a judge's words: a/b, a out of b, n%, or a bare 0..1; else null."""
    t = F.lower(text)
    num = r"([0-9]+(?:\.[0-9]+)?)"
    ratio = num + r"\s*(?:/|\s+out\s+of\s+)\s*" + num
    value = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit("")).try_cast("double")
    a, b = value(ratio, 1), value(ratio, 2)
    pct = value(num + r"\s*%", 1)
    bare = value(r"(?<![0-9.])(?:0?\.[0-9]+|[01](?:\.0+)?)(?![0-9])", 0)
    return F.coalesce(F.when((b > 0) & (a <= b), a / b), F.when((pct >= 0) & (pct <= 100), pct / 100), F.when((bare >= 0) & (bare <= 1), bare))


def weighted(scores: Column, weights: Column) -> Column:
    """Weighted mean of an array; negative weights count 0, and if all do, the plain mean."""
    w = F.transform(weights, lambda x: F.greatest(F.coalesce(x, F.lit(1.0)), F.lit(0.0)))
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    even = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)
    return F.when(total > 0, F.aggregate(F.zip_with(scores, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / F.when(total > 0, total)).otherwise(even)


def council(votes: Column) -> Column:
    """Ruling on array<struct<name, score, confidence>>; null scores abstain."""
    valid = F.filter(votes, lambda v: v["score"].isNotNull())
    s, w = F.transform(valid, lambda v: v["score"]), F.transform(valid, lambda v: v["confidence"])
    n = F.size(valid)
    mean, spread = F.when(n >= QUORUM, weighted(s, w)), F.when(n >= QUORUM, F.array_max(s) - F.array_min(s))
    decision = F.when((n < QUORUM) | (spread > HUNG), "abstain").when(mean >= ACCEPT, "relevant").otherwise("not relevant")
    reason = F.when(n < QUORUM, "no quorum").when(spread > HUNG, "hung jury").otherwise("ruled")
    return F.struct(decision.alias("decision"), reason.alias("reason"), mean.alias("mean"), F.when(n >= QUORUM, F.greatest(F.lit(0.0), 1 - spread)).alias("consensus"), n.alias("n_valid"), F.size(votes).alias("n_total"))


def majority(votes: Column) -> Column:
    """Yes/no votes at ACCEPT; a tie or a missing quorum abstains."""
    valid = F.filter(votes, lambda v: v["score"].isNotNull())
    n, yes = F.size(valid), F.size(F.filter(valid, lambda v: v["score"] >= ACCEPT))
    decision = F.when((n < QUORUM) | (2 * yes == n), "abstain").when(2 * yes > n, "relevant").otherwise("not relevant")
    return F.struct(decision.alias("decision"), F.when(n < QUORUM, 0).otherwise(yes).alias("yes"), F.when(n < QUORUM, 0).otherwise(n - yes).alias("no"))


def compose(signals: Column) -> Column:
    """Trust from array<struct<name, trust, weight>>; null trusts abstain."""
    valid = F.filter(signals, lambda s: s["trust"].isNotNull())
    t, w, n = F.transform(valid, lambda s: s["trust"]), F.transform(valid, lambda s: s["weight"]), F.size(valid)
    score, spread = F.when(n >= QUORUM, weighted(t, w)), F.when(n >= QUORUM, F.array_max(t) - F.array_min(t))
    few = (score >= HIGH) & (n < MIN_FOR_HIGH)
    level = F.when((n < QUORUM) | (spread > SPLIT), "abstain").when((score >= HIGH) & (n >= MIN_FOR_HIGH), "high").when(score >= MEDIUM, "medium").otherwise("low")
    reason = F.when(n < QUORUM, "not enough signals").when(spread > SPLIT, "split decision").when(few, "capped").otherwise("composed")
    return F.struct(level.alias("level"), reason.alias("reason"), score.alias("score"), F.when(n >= QUORUM, F.greatest(F.lit(0.0), 1 - spread)).alias("consensus"), n.alias("n_valid"))


def gate_trust(cos: Column, strong: float, moderate: float, weak: float) -> Column:
    return F.when(cos >= strong, 1.0).when(cos >= moderate, 0.7).when(cos >= weak, 0.4).otherwise(0.1)


def conformal_trust(cos: Column, tau: Column) -> Column:
    """Null below the bar (with 1e-9 of tolerance), then 0.5 rising to 1."""
    inside = tau.isNotNull() & (F.abs(tau) < F.lit(float("inf"))) & (cos >= tau - 1e-9)
    return F.when(inside, F.least(F.lit(1.0), 0.5 + 0.5 * (cos - tau) / F.greatest(1 - tau, F.lit(1e-6))))


def margin_trust(margin: Column, scale: float = 0.15) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin / scale))


def heuristic_votes(cos: Column, qtags: Column, rtags: Column) -> Column:
    """Three rubric judges from stored signals; shared tags keep the query's repeats."""
    shared = F.size(F.filter(qtags, lambda t: F.array_contains(rtags, t)))
    relevance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cos - REL_LO) / (REL_HI - REL_LO)))
    specificity = shared / F.greatest(F.size(qtags), F.lit(1))
    faithful = F.when(F.array_contains(rtags, F.get(qtags, F.lit(0))), 1.0).when(shared > 0, 0.5).otherwise(0.0)
    return votes_of({"relevance": (relevance, 1.0), "specificity": (specificity, 0.7), "faithfulness": (faithful, 0.6)})


def step(x: Column, w: Column, eps: float = EPS_OPINION) -> Column:
    """One round: each opinion becomes the weighted mean of those within ``eps`` of it."""
    pairs = F.arrays_zip(x.alias("x"), w.alias("w"))

    def move(a: Column) -> Column:
        near = F.filter(pairs, lambda p: F.abs(p["x"] - a) <= eps + 1e-12)
        return weighted(F.transform(near, lambda p: p["x"]), F.transform(near, lambda p: p["w"]))

    return F.transform(x, move)


def debate(x: Column, w: Column, *, eps: float = EPS_OPINION, rounds: int = ROUNDS, tol: float = TOL) -> Column:
    """struct(x, rounds, done): opinions after rounds of deliberation, frozen once no one moves by ``tol``."""
    start = F.struct(x.alias("x"), F.lit(0).alias("rounds"), F.lit(False).alias("done"))

    def go(s: Column, _: Column) -> Column:
        nxt = step(s["x"], w, eps)
        moved = F.array_max(F.zip_with(nxt, s["x"], lambda a, b: F.abs(a - b)))
        return F.when(s["done"], s).otherwise(F.struct(nxt.alias("x"), (s["rounds"] + 1).alias("rounds"), (moved < tol).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, go)


def n_factions(x: Column, eps: float = EPS_OPINION) -> Column:
    """Single-linkage clusters on the line: one more than the gaps over ``eps`` between sorted neighbours."""
    s = F.array_sort(x)
    gaps = F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda b, a: b - a)
    return F.when(F.size(x) == 0, 0).otherwise(1 + F.size(F.filter(gaps, lambda g: g > eps + 1e-12)))


#: What to do with a result, by case: (action, status, because, effect).
OUTCOMES = {
    "high": ("show it as the answer", "ok", "every lens agrees and the panel reached consensus", "the user sees a confident, defensible match"),
    "factions": ("withhold — genuinely contested", "stop", "the panel deliberated and still split into factions", "ask the user or broaden the query rather than guess"),
    "split": ("withhold — genuinely contested", "stop", "the honesty lenses split — no majority to trust", "ask the user or broaden the query rather than guess"),
    "thin": ("withhold — not enough signal", "stop", "too few lenses cleared their own bar to compose a verdict", "say 'no confident match' instead of showing a coin flip"),
    "unconfirmed": ("show it with a caveat", "caution", "the council couldn't confirm it", "label it a loose match so the user calibrates trust"),
    "missed": ("show it with a caveat", "caution", "it missed the calibrated confidence bar", "label it a loose match so the user calibrates trust"),
    "against": ("show it with a caveat", "caution", "the judges leaned against it", "label it a loose match so the user calibrates trust"),
    "poor": ("show it, flagged as weak", "caution", "the lenses agree it's a poor match", "keep it, but make the low confidence explicit"),
}
FIELDS = ("action", "status", "because", "effect")


def action(level: Column, reason: Column, contested: Column, council_decision: Column) -> Column:
    """What to do with a result: struct(action, status, because, effect)."""
    stop, medium = level == "abstain", level == "medium"
    cases = {
        "high": level == "high",
        "factions": stop & contested,
        "split": stop & (reason == "split decision"),
        "thin": stop,
        "unconfirmed": medium & (council_decision == "abstain"),
        "missed": medium & (council_decision == "relevant"),
        "against": medium,
        "poor": F.lit(True),
    }
    out = F
    for case, fits in cases.items():
        out = out.when(fits, F.struct(*[F.lit(v).alias(f) for f, v in zip(FIELDS, OUTCOMES[case], strict=True)]))
    return out


def votes_of(judges: dict[str, tuple[Column, float]]) -> Column:
    """Votes as ``council`` takes them, of any judges given as {name: (score, confidence)}; null scores abstain.

    A judge is a column: a rubric over stored signals, ``parse_score`` of a model's replies, or a UDF.
    """
    return F.array(*[F.struct(F.lit(n).alias("name"), s.cast("double").alias("score"), F.lit(float(c)).alias("confidence")) for n, (s, c) in judges.items()])
