"""Every query with a SQL equivalent gives the same rows in DuckDB; plans look as they should."""

import math

import duckdb
import pytest

from quillon.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    mine = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_run(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_plans(spark, data):
    plan = lambda n: catalogue.QUERIES[n](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan("exact_topk") and "CartesianProduct" not in plan("exact_topk")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan("content_dedup")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan("token_normalise")


def test_entry(spark):
    import __spark_entry__ as entry

    asked = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert entry.entry(spark).count() == 10 * asked
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
