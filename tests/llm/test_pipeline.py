"""The corpus pipeline against a brute-force version over whole tables."""

import zlib

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import decontamination, oracles
from quillon.llm.queries import REPEATS
from quillon.llm.words import plain

from .test_operators import brute_components, brute_mix, brute_simhash, library


def brute_exponent(sizes, repeats):
    total = sum(sizes)
    lo, hi = 0.0, 1.0
    most = lambda a: max((s / total) ** a / sum((x / total) ** a for x in sizes) * total / s for s in sizes)
    if most(0.0) <= repeats:
        return 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if most(mid) > repeats + 1e-9 else (lo, mid)
    return hi


def test_pipeline(spark, data):
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, data).collect()))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    kept = {r[0] for r in con.sql(oracles.quality_rules()).select("doc_id, kept").fetchall() if r[1]}
    docs = [r for r in con.sql("select doc_id, text, lang, source from documents").fetchall() if r[0] in kept]
    assert 0 < len(docs) < con.sql("select count(*) from documents").fetchall()[0][0]
    groups = brute_components([(r[0], brute_simhash(r[1])) for r in docs])
    docs = [r for k, r in enumerate(docs) if groups[k] == r[0]]
    items = [p for _, t in con.sql("select * from benchmark").fetchall() if len(p := plain(t)) >= decontamination.LEAST_CHARS]
    docs = [r for r in docs if not any(decontamination.myers(p, plain(r[1]), decontamination.budget(len(p))) for p in items)]
    import re

    sizes = {}
    for r in docs:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    copies = brute_mix(docs, round(brute_exponent(list(sizes.values()), REPEATS), 6), 7, spark)
    want, at = [], 0
    for r in sorted(docs):
        for _ in range(copies[r[3]].get(r[0], 0)):
            ids = [*library(r[1]), 2]
            want.append((at, r[0], len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
            at += len(ids)
    assert got == want


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    odd = docs.limit(5).unionByName(docs.limit(2)).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    for d in (odd.withColumn("kept", F.lit("own")), docs.limit(0)):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, data)
            out.collect()
            if n < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == d.columns


def test_stages_on_odd_rows(spark, data):
    """A very long text, nulls, repeats, ties and columns called like the stages' own, through every stage."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    long = " ".join(f"word{i % 977} and more{i % 1013}." for i in range(60_000))
    odd = [(10**6, long, "en", "a", len(long)), (10**6 + 1, long + " end", "en", "a", 0), (None, None, None, None, None), (10**6 + 2, "", None, "a", 0), (10**6 + 2, "", None, "a", 0)]
    names = ("_fp", "_row", "_dropped", "n_tokens", "epoch", "key", "kept", "start", "_source", "h", "fp", "n_words", "position", "block")
    own = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit(f"own {c}") for c in names})
    at = own
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, at = at, stage(spark, at, data)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == own.columns
            assert [tuple(r) for r in at.select(*names).distinct().collect()] == [tuple(f"own {c}" for c in names)]
            assert at.select("doc_id").exceptAll(before.select("doc_id")).count() == 0 or n == 3  # only the mix repeats rows
    # the long text is kept whole, and of the two near copies one
    assert at.where(f"doc_id in ({10**6}, {10**6 + 1})").select("doc_id").distinct().count() <= 1
    assert at.count() > 50
