"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

A sketch is a histogram over fixed log-spaced bins: values up to 63 exactly, larger ones by their leading
six bits (an error under 1/32).  Sketches merge by adding counts, so they are made by one grouped count,
the same whatever the partitions.  A group's fence for a measure is its upper quartile plus FENCE times the
quartile distance (or a least distance, so that groups without spread keep clean documents); groups with
too few rows use their language's sketch, then everyone's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import local_schema, only, put_back, set_aside, store
from .words import BLANKS, encode

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
#: measure -> (per-mille expression over the base columns, least quartile distance, side)
RULES = {
    "symbols": ("1000 * n_symbols div n_words", 20, "upper"),
    "dup_lines": ("1000 * n_dup_lines div n_words", 20, "upper"),
    "repeats": ("1000 * n_repeat_words div n_words", 80, "upper"),
    "word_length": ("100 * word_chars div n_words", 150, "both"),
}
FENCE, LEAST_ROWS = 3, 100
EXACT_BITS = 6


def measure_text(text: str | None) -> tuple[int, int, int, int, int]:
    """MEASURES of a whole text; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0
    data = encode(text)
    words = data.split()
    blanks = len(data) - len(data.translate(None, BLANKS))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen, repeated_lines = set(), 0
    if b"\n" in data:
        for line in data.split(b"\n"):
            if line.strip(BLANKS):
                if line in seen:
                    repeated_lines += 1
                else:
                    seen.add(line)
    return len(words), len(text) - blanks, symbols, repeated_lines, repeated_words(words)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more in the text, the first included.

    Windows are compared exactly: numbers of words, then of pairs, then of longer runs by doubling.
    """
    import numpy as np

    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        ids = np.unique(ids[: len(ids) - step] * (ids.max() + 1) + ids[step:], return_inverse=True)[1]
        width += step
        if int(ids.max()) + 1 == len(ids):  # all runs of this width differ, so all windows do
            return 0
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: Column) -> Column:
    """Struct of MEASURES."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure_text(t) for t in texts], columns=list(MEASURES), dtype="int64")

    return of(text)


def bin_of(value: Column) -> Column:
    """Bin of a value >= 0: itself up to 63, else by its bit length and leading bits; monotone."""
    bits = F.length(F.bin(value))
    shift = F.greatest(bits - EXACT_BITS, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", value, shift)).cast("int")


def edge_of(number: Column) -> Column:
    """Least value of a bin."""
    shift = F.greatest(F.floor(number / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (number - shift * 32).cast("long"), shift)


def sketch(measured: DataFrame, *, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, measure, bin, n) over the rows that pass the base rules."""
    rows = measured.where("not base_failed").select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(F.expr(e)).alias("bin")) for m, (e, _, _) in RULES.items()])).alias("x"))
    return rows.groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))


def fences(sketched: DataFrame) -> DataFrame:
    """(level, lang, source, measure, rows, lower, upper): level 2 by language and source, 1 by language, 0 all."""
    levels = sketched.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    merged = levels.groupBy("level", F.when(F.col("level") >= 1, F.col("lang")).alias("lang"), F.when(F.col("level") == 2, F.col("source")).alias("source"), "measure", "bin").agg(F.sum("n").alias("n"))
    group = ["level", "lang", "source", "measure"]
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*group))
    run = merged.withColumn("upto", upto).withColumn("rows", total)
    q = lambda k: edge_of(F.min(F.when(4 * F.col("upto") >= k * F.col("rows"), F.col("bin"))))
    out = run.groupBy(*group).agg(F.first("rows").alias("rows"), q(1).alias("q1"), q(3).alias("q3"))
    least = F.create_map(*[x for m, (_, d, _) in RULES.items() for x in (F.lit(m), F.lit(d))])[F.col("measure")]
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), least)
    return out.withColumn("upper", F.col("q3") + reach).withColumn("lower", F.when(F.col("measure").isin([m for m, (_, _, s) in RULES.items() if s == "both"]), F.col("q1") - reach).otherwise(0))


def thresholds(measured: DataFrame, *, lang_col: str = "lang", source_col: str = "source", least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row a language and source: (lang, source, <measure>_lower, <measure>_upper).

    Written to shared storage, so Spark knows its size and broadcasts it only if that is small.
    """
    f = store(fences(sketch(measured, lang_col=lang_col, source_col=source_col)), "fences")
    own = f.where("level = 2").select("lang", "source", "measure", "rows", "lower", "upper")
    by_lang = f.where("level = 1").select(F.col("lang").alias("_lang"), F.col("measure").alias("_m"), F.col("rows").alias("_rows"), F.col("lower").alias("_lo"), F.col("upper").alias("_up"))
    of_all = f.where("level = 0").select(F.col("measure").alias("__m"), F.col("lower").alias("__lo"), F.col("upper").alias("__up"))
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_m"))).join(of_all, F.col("measure") == F.col("__m"))
    pick = lambda a, b, c: F.when(F.col("rows") >= least_rows, F.col(a)).when(F.col("_rows") >= least_rows, F.col(b)).otherwise(F.col(c))
    chosen = joined.select("lang", "source", "measure", pick("lower", "_lo", "__lo").alias("lower"), pick("upper", "_up", "__up").alias("upper"))
    wide = chosen.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in RULES for side in ("lower", "upper")])
    return store(wide, "thresholds")


def measure(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Docs with MEASURES and base_failed; input columns of those names are replaced."""
    docs, moved = set_aside(docs, "_measures")
    rows = docs.select(*local_schema(docs, *MEASURES, "base_failed", "kept"), measures(F.col(text_col)).alias("_measures"))
    rows = rows.select(*[c for c in rows.columns if c != "_measures"], "_measures.*")
    return put_back(rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))), moved)


def judge(measured: DataFrame, limits: DataFrame, *, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Adds ``kept``: false for base failures, else whether every measure lies within its group's fences."""
    t = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    own, moved = set_aside(measured, *t.columns)
    joined = own.join(t, F.col(lang_col).eqNullSafe(F.col("_lang")) & F.col(source_col).eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for m, (e, _, _) in RULES.items():
        within = within & F.expr(f"if(base_failed, true, {e.replace(' n_words', ' greatest(n_words, 1)')} between {m}_lower and {m}_upper)")
    return put_back(joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).select(*own.columns, "kept"), moved)


def assess(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Docs with MEASURES, base_failed and kept.

    Texts are measured once and the rows with their measures written to shared storage; sketches, and the
    join with the thresholds, read those.  Null and empty texts have no words and fail.  Null languages and
    sources are groups of their own.  Every row is judged by itself, so repeated rows agree; an empty table
    stays empty.
    """
    measured = store(measure(docs, text_col=text_col), "measured")
    return judge(measured, thresholds(measured, lang_col=lang_col, source_col=source_col), lang_col=lang_col, source_col=source_col)


def keep(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The docs that ``assess`` keeps, with their own columns alone, whatever those are called."""
    own, moved = set_aside(docs, *MEASURES, "base_failed", "kept")
    return only(assess(own, text_col=text_col, lang_col=lang_col, source_col=source_col).where("kept"), docs.columns, moved)
