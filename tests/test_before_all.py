"""Ranks over all items by stretches of queries, against brute force, with files, stretches and tiles of a few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks, retrieve
from quillon.plans import catalogue

N, CELLS = 130, 5


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(N, 8))
    x[40:70] = x[3]  # copies
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("FILE_VALUES", 160), ("HELD_VALUES", 90), ("TILE", 7), ("SCORES", 400), ("KEPT_BYTES", 3000)):
        monkeypatch.setattr(blocks, name, value)


def coded(spark, x):
    codes = lambda v: [int(v[2 * j] > 0) + 2 * int(v[2 * j + 1] > 0) for j in range(4)]
    rows = [(i, v.tolist(), i % CELLS, [int(sum(2**p for p in range(8) if v[p] > 0))], codes(v), [float(round(127 * a)) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, img array<double>, cell int, sign array<long>, codes array<int>, i8 array<double>").repartition(5)


def tables(v):
    return [[float(v[2 * j] * (1 if c & 1 else -1) + v[2 * j + 1] * (1 if c & 2 else -1)) for c in range(4)] for j in range(4)]


def asked(spark, x):
    rows = [(i, x[i].tolist(), [i % CELLS, (i + 1) % CELLS, (i + 3) % CELLS], [int(sum(2**p for p in range(8) if x[i][p] > 0))], tables(x[i]), [float(round(127 * a)) for a in x[i]]) for i in range(0, N, 3)]
    return spark.createDataFrame(rows, "qid long, qv array<double>, cells array<int>, qsign array<long>, tables array<array<double>>, q8 array<double>")


def best(scores, ids, k):
    return sorted(ids, key=lambda i: (-scores[i], i))[:k]


def by_codes(items, q):
    return {r["id"]: round(sum(q["tables"][j][c] for j, c in enumerate(r["codes"])), 9) for r in items}


def test_funnel(spark, x, small):
    """Every level ranks over all items, and the counts are of the rows alive."""
    d, a = coded(spark, x), asked(spark, x)
    items = d.collect()
    model = F.broadcast(spark.range(1).select(F.col("id").alias("one")))
    hits, counts = retrieve.funnel(a, blocks.in_order(d, "id", "img").crossJoin(model), k=4, keep=(50, 20, 9))
    assert len(blocks._write(blocks.in_order(d, "id", "img"), "id", "img")) > 5
    got, alive = {}, {(r["qid"], r["level"]): r["alive"] for r in counts.collect()}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    for q in a.collect():
        ids = [r["id"] for r in items if r["cell"] in q["cells"]]
        levels = [len(ids)]
        near = {r["id"]: -bin(r["sign"][0] ^ q["qsign"][0]).count("1") for r in items}
        int8 = {r["id"]: sum(u * v for u, v in zip(r["i8"], q["q8"], strict=True)) for r in items}
        exact = {r["id"]: sum(u * v for u, v in zip(r["img"], q["qv"], strict=True)) for r in items}
        for scores, k in ((near, 50), (by_codes(items, q), 20), (int8, 9), (exact, 4)):
            ids = best(scores, ids, k)
            levels.append(len(ids))
        assert got[q["qid"]] == ids and [alive[q["qid"], n] for n in range(5)] == levels


@pytest.mark.parametrize("name", ["cascade_survivors", "cascade_search", "cascade_trained"])
def test_no_pair_is_a_row(spark, data, name):
    """Rows that reach a shuffle or a window are hits and counts, not queries by items."""
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "cell" not in plan.split("MapInArrow")[0] and "Join Inner, (cell" not in plan


def test_second_look(spark, x, small):
    """the best by codes among all items, ties by id, and the exact best of a share of them."""
    d, a = coded(spark, x), asked(spark, x)
    items, got = d.collect(), {}
    model = F.broadcast(spark.range(1).select(F.col("id").alias("one")))
    for r in retrieve.second_look(a, blocks.in_order(d, "id", "img").crossJoin(model), left=30, k=6).orderBy("rank").collect():
        got.setdefault((r["stage"], r["qid"]), []).append(r["id"])
    for q in a.collect():
        adc, exact = by_codes(items, q), {r["id"]: sum(u * v for u, v in zip(r["img"], q["qv"], strict=True)) for r in items}
        assert got["codes", q["qid"]] == best(adc, range(N), 6) and got["exact", q["qid"]] == best(exact, best(adc, range(N), 30), 6)
