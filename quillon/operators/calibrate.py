"""Distribution-free calibration and drift detectors."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import saved
from ..sources.store import numbered, running

INF = float("inf")
#: Rulings of the drift monitor.
PSI_SHIFT, PSI_DRIFT, COVERAGE_SLACK, EPS, BINS = 0.10, 0.25, 0.10, 1e-6, 8
CRITICAL = {0.10: 1.22, 0.05: 1.36, 0.01: 1.63}


def kth(n: Column, alpha: Column | float) -> Column:
    """Rank of the calibration quantile, ceil((n + 1)(1 - alpha)) in doubles."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.ceil((n + 1).cast("double") * (F.lit(1.0) - a))


def calibrate(scores: DataFrame, alphas: list[float], value: str = "score") -> DataFrame:
    """(alpha, n, qhat): the k-th smallest score per alpha; infinity where k > n.

    Ranks come from sorted ranges and the counts before them, so no task sorts everything.
    """
    ranked = numbered(scores.select(F.col(value).alias("q")), ["q"], name="_r")
    total = scores.agg(F.count("*").alias("n"))
    levels = total.select("n", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")).withColumn("k", kth(F.col("n"), F.col("alpha")))
    found = ranked.join(F.broadcast(levels), F.col("_r") + 1 == F.col("k")).select("alpha", "q")
    return levels.join(found, "alpha", "left").select("alpha", "n", F.coalesce("q", F.lit(INF)).alias("qhat"))


def jackknife(scores: DataFrame, alphas: list[float], value: str = "score") -> DataFrame:
    """(alpha, coverage): the share of scores covered when calibrated on all others.

    Without row i, the k-th of the others is the k-th or the next of all, by i's rank.
    """
    ranked = saved(numbered(scores.select(value), [value], name="_r").withColumn("r", F.col("_r") + 1).drop("_r"))
    levels = ranked.agg(F.count("*").alias("n")).select("n", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")).withColumn("k", kth(F.col("n") - 1, F.col("alpha")))
    near = ranked.join(F.broadcast(levels), F.col("r").between(F.col("k"), F.col("k") + 1))
    cuts = near.groupBy("alpha").agg(F.max(F.when(F.col("r") == F.col("k"), F.col(value))).alias("at"), F.max(F.when(F.col("r") == F.col("k") + 1, F.col(value))).alias("next"))
    rows = ranked.crossJoin(F.broadcast(levels.join(cuts, "alpha", "left")))
    covered = F.when(F.col("k") > F.col("n") - 1, True).when(F.col("r") > F.col("k"), F.col(value) <= F.col("at")).otherwise(F.col(value) <= F.col("next"))
    return rows.groupBy("alpha").agg(F.avg(covered.cast("int")).alias("coverage"))


def quantiles(rows: DataFrame, probs: list[float], *, value: str = "value", key: str | None = None) -> DataFrame:
    """(key, p, q): exact quantiles of each group with linear interpolation; nulls don't count.

    Values are counted first, so a frequent one is one row; running counts over sorted ranges then find the two
    values that a quantile lies between.  No task holds a group's values.
    """
    group = F.col(key) if key else F.lit(0)
    counts = rows.where(F.col(value).isNotNull()).groupBy(group.alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = saved(running(counts, ["_k", "_v"], "_n", "_upto"))
    sizes = upto.groupBy("_k").agg(F.sum("_n").alias("_size"), F.min(F.col("_upto") - F.col("_n")).alias("_start"))
    at = sizes.select("_k", "_start", F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("_size") - 1)).alias("pos")) for p in probs])).alias("t"))
    at = at.select("_k", F.col("t.p").alias("p"), (F.col("t.pos") - F.floor("t.pos")).alias("_part"), F.explode(F.array(F.struct(F.lit(0).alias("hi"), F.floor("t.pos").alias("r")), F.struct(F.lit(1).alias("hi"), F.ceil("t.pos").alias("r")))).alias("e"), "_start")
    at = saved(at.select(F.col("_k").alias("_g"), "p", "_part", "e.hi", (F.col("_start") + F.col("e.r")).alias("_r")))
    hit = upto.join(at, F.col("_k").eqNullSafe(F.col("_g")) & (F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_n")))
    ends = hit.groupBy("_g", "p").agg(F.max(F.when(F.col("hi") == 0, F.col("_v"))).alias("lo"), F.max(F.when(F.col("hi") == 1, F.col("_v"))).alias("hi"), F.max("_part").alias("part"))
    q = F.when(F.col("part") == 0, F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    return ends.select(*([F.col("_g").alias(key)] if key else []), "p", q.alias("q"))


def edges(ref: DataFrame, value: str = "value", bins: int = BINS) -> DataFrame:
    """One row: the distinct quantiles of the reference (linear interpolation)."""
    found = quantiles(ref, [i / bins for i in range(bins + 1)], value=value)
    return found.agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda x: x["q"])).alias("edges"))


def bin_of(value: Column, edges_: Column) -> Column:
    """Inner edges at or below the value; the outer bins are open."""
    return F.size(F.filter(F.slice(edges_, 2, F.greatest(F.size(edges_) - 2, F.lit(0))), lambda e: e <= value))


def psi(ref: DataFrame, live: DataFrame, *, value: str = "value", key: str = "window_id", bins: int = BINS) -> DataFrame:
    """(key, psi) of each live window against the reference's bins; 0 for a constant reference."""
    e = F.broadcast(edges(ref, value, bins))
    r = ref.crossJoin(e).groupBy(bin_of(F.col(value), F.col("edges")).alias("bin")).agg(F.count("*").alias("nr"))
    counts = live.crossJoin(e).groupBy(key, bin_of(F.col(value), F.col("edges")).alias("bin")).agg(F.count("*").alias("nl"))
    keys = counts.groupBy(key).agg(F.sum("nl").alias("total"))
    whole = ref.agg(F.count("*").alias("ref_total")).crossJoin(e)
    grid = keys.crossJoin(F.broadcast(whole)).withColumn("bin", F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))))
    full = grid.join(F.broadcast(r), "bin", "left").join(counts, [key, "bin"], "left")
    share = lambda n, t: F.greatest(F.coalesce(F.col(n), F.lit(0)) / F.col(t), F.lit(EPS))
    a, b = share("nr", "ref_total"), share("nl", "total")
    return full.groupBy(key).agg(F.when(F.max(F.size("edges")) < 2, 0.0).otherwise(F.sum((b - a) * F.log(b / a))).alias("psi"))


def ks(ref: DataFrame, live: DataFrame, *, value: str = "value", key: str = "window_id") -> DataFrame:
    """(key, ks, n_ref, n_live): largest distance of the two right-continuous distribution functions.

    It is met at a value of the window or just before one, so the reference's running counts are looked up at the
    windows' own values; the reference isn't copied to each window and no task sorts a window.
    """
    a = ref.groupBy(value).agg(F.count("*").alias("a")).unionByName(live.select(value).distinct().withColumn("a", F.lit(0).cast("long")))
    a = running(a.groupBy(value).agg(F.sum("a").alias("a")), [value], "a", "ca").select(F.col(value).alias("_v"), "a", "ca")
    b = saved(running(live.groupBy(key, value).agg(F.count("*").alias("b")), [key, value], "b", "cb"))
    sizes = b.groupBy(F.col(key).alias("_k")).agg(F.sum("b").alias("n_live"), F.min(F.col("cb") - F.col("b")).alias("before"))
    both = b.join(a, F.col(value).eqNullSafe(F.col("_v"))).join(sizes, F.col(key).eqNullSafe(F.col("_k"))).crossJoin(F.broadcast(ref.agg(F.count("*").alias("n_ref"))))
    here = F.abs(F.col("ca") / F.col("n_ref") - (F.col("cb") - F.col("before")) / F.col("n_live"))
    ahead = F.abs((F.col("ca") - F.col("a")) / F.col("n_ref") - (F.col("cb") - F.col("b") - F.col("before")) / F.col("n_live"))
    return both.groupBy(key).agg(F.max(F.greatest(here, ahead)).alias("ks"), F.first("n_ref").alias("n_ref"), F.first("n_live").alias("n_live"))


def ks_critical(n: Column, m: Column, alpha: float = 0.05) -> Column:
    return F.lit(CRITICAL.get(alpha, 1.36)) * F.sqrt((n + m) / (n * m))


def coverage(ref: DataFrame, live: DataFrame, alpha: float, *, value: str = "value", key: str = "window_id") -> DataFrame:
    """(key, coverage, bar): share of a window that clears the bar calibrated on the reference."""
    q = calibrate(ref.select((1 - F.col(value)).alias("score")), [alpha]).select("qhat")
    rows = live.crossJoin(F.broadcast(q))
    hit = F.when(F.col("qhat") == INF, True).otherwise(F.col(value) >= 1 - F.col("qhat"))
    return rows.groupBy(key).agg(F.avg(hit.cast("int")).alias("coverage"), F.first(1 - F.col("qhat")).alias("bar"))


def monitor(ref: DataFrame, live: DataFrame, alpha: float = 0.2, *, value: str = "value", key: str = "window_id") -> DataFrame:
    """One verdict a window: stable, shift or drift, with the detectors' values and the reasons that fired."""
    rows = psi(ref, live, value=value, key=key).join(ks(ref, live, value=value, key=key), key).join(coverage(ref, live, alpha, value=value, key=key), key)
    rows = rows.withColumn("ks_critical", ks_critical(F.col("n_ref"), F.col("n_live")))
    target = 1.0 - alpha
    fired = F.array_compact(F.array(F.when(F.col("psi") > PSI_DRIFT, "psi"), F.when(F.col("ks") > F.col("ks_critical"), "ks"), F.when(F.col("coverage") < target - COVERAGE_SLACK, "coverage")))
    level = F.when(F.size("reasons") > 0, "drift").when((F.col("psi") > PSI_SHIFT) | (F.col("ks") > 0.75 * F.col("ks_critical")), "shift").otherwise("stable")
    return rows.withColumn("reasons", fired).withColumn("level", level).withColumn("failure_rate", 1 - F.col("coverage"))


def gate(reference: DataFrame, live: DataFrame, alpha: float = 0.2) -> DataFrame:
    """One row: whether no window drifted, for a job that fails on drift; without a reference it passes."""
    frozen = reference.agg(F.count("*").alias("frozen"))
    bad = monitor(reference, live, alpha).agg(F.count_if(F.col("level") == "drift").alias("drifted"))
    return frozen.crossJoin(bad).select((F.col("frozen") > 0).alias("frozen"), "drifted", ((F.col("frozen") == 0) | (F.col("drifted") == 0)).alias("passed"))


def freeze(reference: DataFrame, path: str, alpha: float = 0.2, *, value: str = "value") -> None:
    """Write a reference signal with its level, for later gates."""
    reference.select(F.col(value).alias("value"), F.lit(float(alpha)).alias("alpha")).write.mode("overwrite").parquet(path)


def frozen(spark: SparkSession, path: str) -> DataFrame | None:
    """The reference written there, or None."""
    try:
        return spark.read.schema("value double, alpha double").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def gate_at(spark: SparkSession, path: str, signal: DataFrame, *, alpha: float = 0.2, value: str = "value") -> DataFrame:
    """One row (frozen, level, passed, reasons): the signal as one window against the reference at ``path``.

    The first run finds none: it writes the signal there and passes, with ``frozen`` false.  A job that is to fail
    on drift looks at ``passed``.
    """
    reference = frozen(spark, path)
    if reference is None:
        freeze(signal, path, alpha, value=value)
        return spark.createDataFrame([(False, None, True, [])], "frozen boolean, level string, passed boolean, reasons array<string>")
    live = signal.select(F.lit("now").alias("window_id"), F.col(value).alias("value"))
    ruled = monitor(reference.select("value"), live, alpha)
    return ruled.select(F.lit(True).alias("frozen"), "level", (F.col("level") != "drift").alias("passed"), "reasons")


def contaminate(sample: DataFrame, fraction: float, drop: float = 0.2, *, value: str = "value", order: str = "seq", mark: str | None = None) -> DataFrame:
    """An evenly spaced share of rows (half-up count) lowered by ``drop``, not below 0.

    Row p is hit if some i < k has floor(i n / k) = p.  ``order`` numbers the rows from 0; ``mark`` names a column that
    says whether a row is hit, which its value doesn't tell where it was 0 or null before.
    """
    n = sample.agg(F.count("*").alias("n")).withColumn("k", F.floor(F.lit(float(fraction)) * F.col("n") + 0.5))
    p, k, n_ = F.col(order), F.col("k"), F.col("n")
    hit = (k > 0) & (F.floor((F.ceil(p * k / n_) * n_) / k) == p) & (F.ceil(p * k / n_) < k)
    out = sample.crossJoin(F.broadcast(n))
    return (out if mark is None else out.withColumn(mark, hit)).withColumn(value, F.when(hit, F.greatest(F.lit(0.0), F.col(value) - drop)).otherwise(F.col(value))).drop("n", "k")
