"""Queries over their whole query sets; their rows are held against SQL with the other queries."""

import duckdb

from quillon.plans import catalogue
from quillon.sources.gallery import gallery, likes


def test_every_twentieth(spark, data):
    asked = {r["id"] for r in gallery(spark, data).where("id % 20 = 0").select("id").collect()}
    assert max(asked) > 100
    for name in ("int8_search", "cross_rerank", "learned_rerank", "search_methods", "guarded_feedback", "exact_topk", "binary_search", "ivf_search", "pq_search", "opq_search", "cascade_search"):
        assert {r["qid"] for r in catalogue.QUERIES[name](spark, data).select("qid").collect()} == asked
    every = {r["id"] for r in gallery(spark, data).select("id").collect()}
    for name in ("council", "debate", "trust", "neighbours", "margins"):
        assert {r["qid"] for r in catalogue.QUERIES[name](spark, data).select("qid").collect()} == every
    assert {r["user_id"] for r in catalogue.QUERIES["ranknet_fit"](spark, data).select("user_id").collect()} == asked


def test_every_user(spark):
    """At sf0.01, where there are users from 25 on."""
    data = "/root/testdata/sf0.01"
    users = {r["user_id"] for r in likes(spark, data).collect()}
    got = sorted((r["user_id"], r["rank"], r["id"], r["score"]) for r in catalogue.QUERIES["recommend"](spark, data).collect())
    assert max(users) >= 25 and {r[0] for r in got} == users
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = sorted(con.sql(f"SELECT user_id, rank, id, score FROM ({catalogue.ORACLES['recommend']})").fetchall())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))
