"""Grounded explanations and the gate that checks them against the evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Strength bands, and the words that an explanation may use.
STRONG, MODERATE, WEAK, TOLERANCE = 0.30, 0.25, 0.20, 0.02
STRENGTHS = ("strong", "moderate", "weak", "very weak", "perfect", "exact")
SAFE = (
    "the a an these this they all both most and or of to with in on no not dont single image images result results match matches matched "
    "similar similarity score scores query search top share shares shared common tag tags show shows way ways different strongest confident "
    "loose treat them as isnt is are that it model very explain"
).split()


def _plain(w: str) -> str:
    return w[:-1] if len(w) > 3 and w.endswith("s") else w


def bucket(s: Column) -> Column:
    return F.when(s >= STRONG, "strong").when(s >= MODERATE, "moderate").when(s >= WEAK, "weak").otherwise("very weak")


def evidence(query: Column, hits: Column) -> Column:
    """What array<struct<tags, score>> supports: tags, tags shared by all, rounded scores, top score, strength."""
    sets = F.transform(hits, lambda h: F.transform(h["tags"], text.norm))
    none = F.array().cast("array<string>")
    allowed = F.array_distinct(F.flatten(sets))
    first = F.coalesce(F.get(hits, F.lit(0))["tags"], none)
    shared = F.filter(first, lambda t: F.forall(sets, lambda s: F.array_contains(s, text.norm(t))))
    scores = F.transform(hits, lambda h: F.bround(h["score"], 2))
    top = F.coalesce(F.array_max(scores), F.lit(0.0))
    toks = F.filter(F.transform(F.split(F.coalesce(query, F.lit("")), r"\s+"), text.norm), lambda w: w != "")
    return F.struct(allowed.alias("tags"), shared.alias("shared"), scores.alias("scores"), top.alias("top"), bucket(top).alias("strength"), toks.alias("toks"))


def describe(ev: Column) -> Column:
    """An explanation made of the evidence alone."""
    n = F.size(ev["scores"]).cast("string")
    shared = F.concat(F.lit("The top "), n, F.lit(" results all show "), text.and_join(F.slice(ev["shared"], 1, 3)), F.lit("."))
    apart = F.concat(F.lit("The top "), n, F.lit(" results share no single tag — they match the query in different ways."))
    tail = F.concat(F.lit(" The strongest match scores "), F.format_string("%.2f", ev["top"]), F.lit(" ("), ev["strength"], F.lit(")."))
    loose = F.when(ev["strength"].isin("weak", "very weak"), " Treat them as loose matches — the model isnt confident.").otherwise("")
    return F.when(F.size(ev["scores"]) == 0, "No results to explain.").otherwise(F.concat(F.when(F.size(ev["shared"]) > 0, shared).otherwise(apart), tail, loose))


def verify(draft: Column, ev: Column) -> Column:
    """Sentences of a draft with the reasons against each: array<struct<text, reasons>>.

    Reasons, in this order: a wrong strength word, a number no score supports, known tags that no result
    has, and up to four words that nothing supports.
    """
    known = F.array(*[F.lit(_plain(w)) for w in text.VOCABULARY])
    fine = F.array(*[F.lit(w) for w in dict.fromkeys([*map(_plain, SAFE), *STRENGTHS])])

    def judged(s: Column) -> Column:
        low = F.lower(s)
        wrong = [F.when((F.lit(p) != ev["strength"]) & low.rlike(rf"\b{p}\b") & ~((F.lit(p) == "weak") & (ev["strength"] == "very weak")), F.lit(f"says '{p}'")) for p in STRENGTHS]
        odd = F.transform(F.filter(text.numbers(s), lambda n: ~F.exists(ev["scores"], lambda x: F.abs(n - x) <= TOLERANCE)), lambda n: F.concat(F.lit("cites "), F.format_string("%.2f", n)))
        ws = F.transform(F.regexp_extract_all(s, F.lit(r"([A-Za-z][\w-]*)"), F.lit(1)), lambda w: F.struct(w.alias("raw"), text.norm(w).alias("w")))
        bad = F.filter(ws, lambda x: ~((x["w"] == "") | F.array_contains(fine, x["w"]) | F.array_contains(ev["tags"], x["w"]) | F.array_contains(ev["toks"], x["w"])))
        absent = F.transform(F.filter(bad, lambda x: F.array_contains(known, x["w"])), lambda x: F.concat(F.lit("claims '"), x["raw"], F.lit("'")))
        vague = F.transform(F.filter(bad, lambda x: ~F.array_contains(known, x["w"])), lambda x: x["raw"])
        note = F.when(F.size(vague) > 0, F.array(F.concat(F.lit("unverifiable: "), F.array_join(F.slice(vague, 1, 4), ", ")))).otherwise(F.array().cast("array<string>"))
        return F.struct(s.alias("text"), F.concat(F.array_compact(F.array(*wrong)), odd, absent, note).alias("reasons"))

    return F.transform(F.filter(F.split(F.trim(draft), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != ""), judged)


def kept_text(sentences: Column) -> Column:
    return F.array_join(F.transform(F.filter(sentences, lambda s: F.size(s["reasons"]) == 0), lambda s: s["text"]), " ")


def explain(draft: Column, ev: Column) -> Column:
    """The verified part of a draft, or the description where nothing of it stands."""
    return F.coalesce(F.nullif(kept_text(verify(draft, ev)), F.lit("")), describe(ev))


def drafted(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[str | None]]], *, query: str = "query", ev: str = "ev") -> DataFrame:
    """Adds ``said`` and ``source``: a model's drafts about the evidence, through the gate.

    ``make`` gives a worker its model, which answers texts that state the facts; a batch at which it fails, and
    null answers, fall back to the description.  ``source`` is model, gate (nothing of the draft stood) or none.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for b in batches:
            try:
                model = model or make()
                yield pd.Series(model(b.tolist()), dtype=object)
            except Exception:  # whatever a model does, the description stands in
                yield pd.Series([None] * len(b), dtype=object)

    e = F.col(ev)
    shared = F.coalesce(F.nullif(F.array_join(e["shared"], ", "), F.lit("")), F.lit("none"))
    facts = F.concat(F.lit('query: "'), F.coalesce(query, F.lit("")), F.lit('"\nshared tags: '), shared, F.lit("\ntop similarity: "), F.format_string("%.2f", e["top"]), F.lit(" ("), e["strength"], F.lit(")\nresult count: "), F.size(e["scores"]).cast("string"))
    out = rows.withColumn("_draft", ask(facts))
    stood = F.nullif(kept_text(verify(F.col("_draft"), e)), F.lit(""))
    source = F.when(F.col("_draft").isNull(), "none").when(stood.isNull(), "gate").otherwise("model")
    return out.withColumn("said", F.coalesce(stood, describe(e))).withColumn("source", source).drop("_draft")
