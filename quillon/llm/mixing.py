"""Temperature mixing of sources, in DataFrame functions alone.

Weights are token shares raised to an exponent and normalised.  The exponent comes from bisection: the
flattest mix that stays under a repetition limit, or the mix that meets a target entropy.  A source's
weight of the token budget becomes whole passes over its rows plus the start of one more permuted pass.
Which rows that start holds is the order of a seeded hash, cut through sums over ranges of the hash, so a
source with a third of all rows never meets in one task.

Each pass is a permutation of its own.  Blocks of a token budget hold every source's weight of it, taken
in the passes' order, and within a block the rows of all sources are permuted together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import only, put_back, set_aside, store

STEPS, CANDIDATES, DIGITS = 6, 16, 6
BITS, LEVELS, PARTS = 10, 2, 6


def word_count(text: Column) -> Column:
    """Words between white space (blank, tab to carriage return); the default measure of tokens. Null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _spread(sources: DataFrame, exponents: list[float], budget_share: float) -> list:
    """Entropy and largest repetition of the mix at each exponent; one row each."""
    rows = sources.where("tokens > 0").withColumn("a", F.explode(F.array(*map(F.lit, exponents)))).withColumn("v", F.pow("share", "a"))
    # H = ln Z - sum(v ln v)/Z; the repetition of a source is budget_share * (v/Z) / share
    out = rows.groupBy("a").agg(F.sum("v").alias("z"), F.sum(F.col("v") * F.log("v")).alias("e"), F.max(F.col("v") / F.col("share")).alias("r"))
    return out.select("a", (F.log("z") - F.col("e") / F.col("z")).alias("entropy"), (budget_share * F.col("r") / F.col("z")).alias("repeats")).collect()


def bisect(sources: DataFrame, *, entropy: float | None = None, repeats: float | None = None, budget_share: float = 1.0) -> float:
    """The exponent in 0..1, to DIGITS digits, that meets the target.

    Both entropy and repetition fall as the exponent grows.  ``repeats``: the smallest exponent at which no
    source is used more often.  ``entropy`` (share of the largest possible, ln of the number of sources):
    the largest exponent with at least that.  Each step tries CANDIDATES exponents in one small job.
    A limit that even proportional sampling breaks gives 1; without sources: 1.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give either a target entropy or a repetition limit")
    lo, hi = 0.0, 1.0
    most = math.log(max(1, sources.where("tokens > 0").count()))
    for _ in range(STEPS):
        grid = [lo + (hi - lo) * i / CANDIDATES for i in range(CANDIDATES + 1)]
        found = {r["a"]: r for r in _spread(sources, grid, budget_share)}
        if not found:
            return 1.0
        flat = [found[a]["repeats"] > repeats + 1e-9 if repeats is not None else found[a]["entropy"] >= entropy * most - 1e-12 for a in grid]
        n = sum(flat)  # flat ones come first
        if n == 0:
            return round(grid[0], DIGITS)
        if n == len(grid):
            return round(grid[-1], DIGITS)
        lo, hi = grid[n - 1], grid[n]
    return round(hi if repeats is not None else lo, DIGITS)


#: Working names, and those of the columns that ``realise`` adds.
WORKING = ("_source", "_tokens", "_key", "_s", "passes", "cut", "rest")
ADDED = ("epoch", "key", "n_tokens")
PLACED = ("block", "position")
PLACING = ("_range", "_source", "_s", "_e", "_r", "_base", "_before", "_w", "_weight", "_tie", "_all", "_slot", "_part", "_b", "_p", "_first")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, tokens: Column | None) -> tuple[DataFrame, dict[str, str]]:
    """(docs' columns, _source, _tokens, _key) and the docs' columns set aside; the key orders a source's permuted pass."""
    measure = word_count(F.col(text_col)) if tokens is None else tokens
    moved = set_aside(docs, *WORKING, *ADDED)[1]
    return docs.select(*[F.col(c).alias(moved.get(c, c)) for c in docs.columns], F.col(source_col).alias("_source"), measure.alias("_tokens"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col)).alias("_key")), moved


def _cut(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_source, cut): the largest key up to which a source's tokens stay within ``residual``.

    Each level sums tokens over 2**BITS ranges of the key and keeps, of each source, the range in which the
    residual ends; the last level sums single keys.  Rows that share a key stand or fall together.
    """
    low = None
    for level in range(LEVELS):
        shift = 64 - BITS * (level + 1)
        place = F.shiftrightunsigned(F.col("_key").bitwiseXOR(F.lit(-(2**63))), shift)  # unsigned order of the key
        rows = slim if low is None else slim.join(low.select(F.col("_source").alias("_s"), F.col("range").alias("_r")), (F.col("_source").eqNullSafe(F.col("_s"))) & (F.shiftrightunsigned(F.col("_key").bitwiseXOR(F.lit(-(2**63))), shift + BITS) == F.col("_r")), "left_semi")
        sums = rows.groupBy("_source", place.alias("range")).agg(F.sum("_tokens").alias("t"))
        goal = wanted if low is None else low.select("_source", "residual")
        g = goal.select(F.col("_source").alias("_s"), "residual")
        w = Window.partitionBy("_source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("upto", F.sum("t").over(w)).join(g, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
        low = run.where((F.col("upto") > F.col("residual")) & (F.col("upto") - F.col("t") <= F.col("residual")) & (F.col("t") > 0)).select("_source", "range", (F.col("residual") - F.col("upto") + F.col("t")).alias("residual"))
        low = store(low, "mix-cut")
    shift = 64 - BITS * LEVELS
    rows = slim.join(low.select(F.col("_source").alias("_s"), F.col("range").alias("_r"), "residual"), (F.col("_source").eqNullSafe(F.col("_s"))) & (F.shiftrightunsigned(F.col("_key").bitwiseXOR(F.lit(-(2**63))), shift) == F.col("_r")))
    keys = rows.groupBy("_source", "_r", "_key").agg(F.sum("_tokens").alias("t"), F.first("residual").alias("residual"))
    w = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    last = keys.withColumn("fits", F.sum("t").over(w) <= F.col("residual")).groupBy("_source", "_r").agg(F.max(F.when(F.col("fits"), F.col("_key"))).alias("last"))
    before = F.when(F.col("_r") > 0, F.expr(f"shiftleft(_r, {shift})").bitwiseXOR(F.lit(-(2**63))) - 1)
    # if no key of the range fits, everything before the range does
    return last.select("_source", F.coalesce(F.col("last"), before).alias("cut"), (F.col("last").isNull() & (F.col("_r") == 0)).alias("none"))


def plan(docs: DataFrame, *, budget: int | None = None, entropy: float | None = None, repeats: float | None = None, exponent: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, tokens: Column | None = None) -> DataFrame:
    """One row a source: tokens, share, weight, quota, passes, cut (and ``rest``: whether a cut pass follows).

    ``budget``: tokens of the mix, by default those of the input.  A null source is a source of its own.
    A source without tokens has weight 0 and one pass, as nothing says how often to use it.  Null texts
    hold no tokens; repeated rows count once each; rows that share an id and a source (null ids too) share
    a place in the permutation, so the cut takes or leaves them together.  An empty table gives an empty
    plan.  Other columns, whatever their names, play no part.
    """
    # the table of keys and tokens is slim: texts are read once and never shuffled
    slim = store(_keyed(docs, id_col, text_col, source_col, seed, tokens)[0].select("_source", "_tokens", "_key"), "mix-keys")
    sums = slim.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("rows"))
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    sources = store(sums.withColumn("share", F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(max(1, total)))), "mix-sources")
    budget = total if budget is None else budget
    a = bisect(sources, entropy=entropy, repeats=repeats, budget_share=budget / max(1, total)) if exponent is None else exponent
    z = sources.where("tokens > 0").agg(F.coalesce(F.sum(F.pow("share", F.lit(a))), F.lit(1.0))).first()[0]
    quota = F.floor(F.round(F.pow("share", F.lit(a)) / F.lit(z), 9) * F.lit(budget)).cast("long")
    planned = sources.select("_source", "rows", "tokens", "share", F.lit(float(a)).alias("exponent"), F.coalesce(F.round(F.pow("share", F.lit(a)) / F.lit(z), 9), F.lit(0.0)).alias("weight"), F.coalesce(quota, F.lit(0)).alias("quota"))
    planned = planned.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("int")).withColumn("residual", F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0))
    planned = store(planned, "mix-plan")
    cuts = _cut(slim, planned.where("residual > 0").select("_source", "residual"))
    joined = planned.join(cuts.select(F.col("_source").alias("_s"), "cut", "none"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return store(joined.withColumn("rest", F.col("cut").isNotNull() & ~F.col("none")).drop("none"), "mix-plan")


def _repeated(docs: DataFrame, planned: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, tokens: Column | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Each row once for every pass of its source, with ADDED, and the docs' columns set aside."""
    rows, moved = _keyed(docs, id_col, text_col, source_col, seed, tokens)
    p = planned.select(F.col("_source").alias("_s"), "passes", "cut", "rest")
    joined = rows.join(p, F.col("_source").eqNullSafe(F.col("_s")))
    copies = F.col("passes") + (F.col("rest") & (F.col("_key") <= F.col("cut"))).cast("int")
    mixed = joined.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    ordered = mixed.withColumn("key", F.xxhash64("_key", "epoch")).withColumnRenamed("_tokens", "n_tokens")
    return ordered.drop("_source", "_key", "_s", "passes", "cut", "rest"), moved


def realise(docs: DataFrame, planned: DataFrame, **options) -> DataFrame:
    """The mix: each row once for every pass of its source, with ``epoch``, ``key`` and ``n_tokens``.

    ``key`` orders a pass: it hashes the row's id and source with the pass, so passes differ.  Decided row
    by row from the plan's one row a source; the plan's options (columns, seed, tokens) must be repeated.
    Input columns named epoch, key or n_tokens are replaced.  Null ids and sources are values like any
    other, null texts hold 0 tokens, long texts are counted whole, rows that share an id and a source
    stand or fall together, and an empty table stays empty.
    """
    mixed, moved = _repeated(docs, planned, **options)
    return put_back(mixed.drop(*[new for c, new in moved.items() if c.lower() in ADDED]), {c: new for c, new in moved.items() if c.lower() not in ADDED})


def mix(docs: DataFrame, planned: DataFrame, **options) -> DataFrame:
    """The mix with the docs' own columns alone, whatever those are called; options and odd rows as for ``realise``."""
    mixed, moved = _repeated(docs, planned, **options)
    return only(mixed, docs.columns, moved)


def blocks(mixed: DataFrame, planned: DataFrame, *, block_tokens: int, source_col: str = "source", seed: int = 7) -> DataFrame:
    """Adds ``block`` and ``position``: the mix as a sequence of blocks, each a permutation of its rows.

    Block b of a source holds its tokens from b to b + 1 times its weight of ``block_tokens``, pass after
    pass in ``key`` order; a row stands in the block where it starts.  Rows of a source without tokens are
    spread over all blocks.  Within a block rows of all sources are ordered by a seeded hash of block, key
    and source; ``position`` counts from 0.  Input columns of those names are replaced; null sources are a
    source; an empty table stays empty.  ``mixed`` should be slim, as it is written once.

    Rows with equal keys (equal ids) get keys of their own first, by their place in the written table, so
    ``key`` is replaced by a finer one.  Sums over ranges of that key give each range's start, so a running
    sum covers one range of one source; likewise a position is counted in one of a block's parts.
    """
    own, moved = set_aside(mixed.drop(*PLACED), *PLACING)
    # written, so that a lost task reads the same rows in the same places again
    rows = store(own.withColumn("_tie", F.monotonically_increasing_id()), "mix-rows")
    rows = rows.withColumn("key", F.xxhash64("key", "_tie")).withColumn("_source", F.col(source_col))
    rows = rows.withColumn("_range", F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), 64 - BITS))
    sums = rows.groupBy("_source", "epoch", "_range").agg(F.sum("n_tokens").alias("t"))
    start = sums.withColumn("_base", F.coalesce(F.sum("t").over(Window.partitionBy("_source").orderBy("epoch", "_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = start.select(F.col("_source").alias("_s"), F.col("epoch").alias("_e"), F.col("_range").alias("_r"), "_base")
    placed = rows.join(start, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("_range") == F.col("_r")))
    within = F.sum("n_tokens").over(Window.partitionBy("_source", "epoch", "_range").orderBy("key", "_tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = placed.withColumn("_before", F.col("_base") + within)
    last = F.greatest(F.lit(1), F.ceil(F.sum("quota").over(Window.partitionBy()) / F.lit(block_tokens)))  # one row a source
    w = planned.select(F.col("_source").alias("_w"), F.col("weight").alias("_weight"), last.alias("_all"))
    out = placed.join(w, F.col("_source").eqNullSafe(F.col("_w")))
    block = F.when(F.col("_weight") > 0, F.floor(F.col("_before") / (F.col("_weight") * F.lit(block_tokens)))).otherwise(F.pmod("key", "_all"))
    out = out.withColumn("block", block.cast("long")).withColumn("_slot", F.xxhash64(F.lit(seed), "block", "key", "_source"))
    out = out.withColumn("_part", F.shiftrightunsigned(F.col("_slot").bitwiseXOR(F.lit(-(2**63))), 64 - PARTS))
    before = F.sum("n").over(Window.partitionBy("block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = out.groupBy("block", "_part").agg(F.count("*").alias("n")).select(F.col("block").alias("_b"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_first"))
    ranked = out.withColumn("position", F.row_number().over(Window.partitionBy("block", "_part").orderBy("_slot", "key", "_tie")) - 1)
    ranked = ranked.join(parts, (F.col("block") == F.col("_b")) & (F.col("_part") == F.col("_p")))
    return put_back(ranked.withColumn("position", (F.col("position") + F.col("_first")).cast("long")).drop(*PLACING), moved)
