"""What the second round's review found, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import vec
from quillon.operators import blocks, calibrate, rank, retrieve, search
from quillon.plans import catalogue
from quillon.sources import store


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """A few embeddings with ids on both sides of 100,000."""
    folder = tmp_path_factory.mktemp("big")
    rng = np.random.default_rng(8)
    rows = [(i, [float(a) for a in rng.normal(size=64) / 8], i % 10) for i in [*range(30), *range(9_990, 10_030), *range(99_980, 100_040)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_paths_that_repeat(spark, big):
    """items whose cut paths are equal are not versions of one."""
    assert catalogue.QUERIES["item_tower"](spark, big).count() == 130


def test_publish_by_key(spark):
    rows = spark.createDataFrame([(1, "p", 1), (2, "p", 1), (2, "p", 2)], "id long, path string, seq int").withColumns({"caption": F.lit("c"), "labels": F.lit("l"), "item_emb": F.array(F.lit(1.0))})
    assert store.publish(rows, "m").count() == 1 and store.publish(rows, "m", key="id").count() == 2


def test_hits_of_values_that_stay(spark):
    """a row is hit though its value was 0 or null before."""
    rows = spark.createDataFrame([(i, 0.0 if i % 2 else None if i == 4 else 1.0) for i in range(10)], "seq long, value double")
    got = calibrate.contaminate(rows, 0.6, mark="hit")
    assert got.where("hit").count() == 6 and got.columns == ["seq", "value", "hit"]
    assert calibrate.contaminate(rows, 0.6).columns == ["seq", "value"]


def test_int8_hits_are_exact(spark):
    """hundreds of near copies, closer than a code's error."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=16) + 1e-3 * rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, v.tolist(), v.tolist()) for i, v in enumerate(x)], "id long, img array<double>, txt array<double>")
    q = items.where("id < 20").select(F.col("id").alias("qid"), F.col("img").alias("qv"))
    hits = {m: sorted(tuple(r) for r in search.search(q, items, method=m, k=5, scales=F.array_repeat(F.lit(1 / 127), 16)).collect()) for m in ("exact", "blocks", "int8")}
    assert hits["exact"] == hits["int8"] == hits["blocks"] and len(hits["exact"]) == 100


#: Queries that made a row of every pair.
PAIRS = ("exact_topk", "evidence", "int8_search", "phrasing_search", "opq_search", "pq_search", "recall_bench", "softmax_shares", "cross_rerank", "learned_rerank", "ranknet_fit", "label_probabilities", "topk_by_mode", "describe", "guarded_feedback", "similarity_matrix")


@pytest.mark.parametrize("name", PAIRS)
def test_no_pair_is_joined(spark, data, name, monkeypatch):
    """No query meets the items in a join, in any step."""

    def meet(*args, **options):
        raise AssertionError("queries and items meet row by row")

    monkeypatch.setattr(retrieve, "meet", meet)
    assert catalogue.QUERIES[name](spark, data).columns


def test_unit_is_linear(spark):
    """The length is computed once, not once an element."""
    d = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("v"), F.array(F.lit(0.0)).alias("z"))
    r = d.select(vec.unit("v").alias("u"), vec.unit("z").alias("z"), vec.unit(F.lit(None).cast("array<double>")).alias("n")).first()
    assert r["u"] == [0.6, 0.8] and r["z"] == [0.0] and r["n"] is None


def test_every_pair(spark):
    """the values of all pairs, rounded as the products from left to right are."""
    x = np.random.default_rng(3).normal(size=(70, 5))
    items = spark.createDataFrame([(i, v.tolist(), v[::-1].tolist()) for i, v in enumerate(x)], "id long, img array<double>, txt array<double>")
    q = items.where("id < 66").select(F.col("id").alias("qid"), F.col("img").alias("qv"), (F.col("id") / 2).alias("c"))
    got = {(r["qid"], r["id"]): (r["a"], r["b"]) for r in retrieve.every_pair(q, items, lambda s, c: [s[0] + c, s[1]], ["a", "b"], columns=("img", "txt"), extra=("c",), digits=3).collect()}
    assert len(got) == 66 * 70
    assert all(v == pytest.approx((round(float(x[i] @ x[j]) + i / 2, 3), round(float(x[i] @ x[j][::-1]), 3)), abs=1e-9) for (i, j), v in got.items())


def test_softmax_totals(spark, data):
    """sums over all items."""
    x = np.random.default_rng(5).normal(size=(40, 4)) / 4
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, img array<double>").repartition(3)
    got = {r["qid"]: r for r in retrieve.exp_totals(items.select(F.col("id").alias("qid"), F.col("img").alias("qv")), items, 20.0).collect()}
    want = np.exp(20 * (x @ x.T - 1)).sum(axis=1)
    assert all(got[i]["total"] == pytest.approx(want[i]) and got[i]["n"] == 40 for i in range(40))


def test_reranking_equals_expressions(spark):
    """arrays give what the column expressions give."""
    rng = np.random.default_rng(7)
    unit = lambda n: [v.tolist() for v in (lambda a: a / np.linalg.norm(a, axis=1, keepdims=True))(rng.normal(size=(n, 6)))]
    tags = [["a", "a", f"t{i % 4}"] if i % 3 else ["a", f"t{i % 4}", "b"] for i in range(60)]
    items = spark.createDataFrame(list(zip(range(60), unit(60), unit(60), tags, strict=True)), "id long, img array<double>, txt array<double>, tags array<string>").repartition(4)
    q = items.where("id % 5 = 0").select(F.col("id").alias("qid"), F.col("img").alias("qv"), F.col("txt").alias("qt"), F.col("tags").alias("qtags"))
    c = rank.candidates(retrieve.meet(items, q).where("qid <> id")).withColumn("features", rank.features())
    layers = [([[0.1 * (i - j) for j in range(4)] for i in range(4)], [0.2, 0.0, 0.0, 0.1])] * 2
    rows = lambda d: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in d.collect())
    assert rows(rank.reranked(q, items, rank.crossing(layers, (0.4, 0.3, 0.2, 0.1)), 7)) == rows(retrieve.top_k(c.withColumn("score", rank.dcn_score(rank.features(), layers, (0.4, 0.3, 0.2, 0.1))), 7))
    w = q.select("qid", F.array(*map(F.lit, (0.5, 0.1, 0.3, 0.2))).alias("w"))
    blended = rank.blend(c.join(w, "qid").withColumn("base_score", (F.col("cos_image") + F.col("cos_text")) / 2), F.col("w"), F.lit(5.0))
    assert rows(rank.reranked(q.join(w, "qid"), items, rank.blending(5.0), 7, extra=("w",))) == rows(retrieve.top_k(blended, 7))
    few = {(r["qid"], r["id"]): (r["tag_overlap"], round(r["rank_prior"], 9), round(r["cos_text"], 9)) for r in rank.best_candidates(q, items, 6).collect()}
    assert few == {(r["qid"], r["id"]): (r["tag_overlap"], round(r["rank_prior"], 9), round(r["cos_text"], 9)) for r in retrieve.top_k(c, 6, by="cos_image").collect()}


def test_margins_by_rounded_scores(spark):
    """rows rank by scores held to some digits, ties by id."""
    items = spark.createDataFrame([(i, [1.0 - 1e-6 * ((i * 7) % 10), 0.0]) for i in range(10)], "id long, img array<double>")
    hits = retrieve.exact_blocks(spark.createDataFrame([(0, [1.0, 0.0])], "qid long, qv array<double>"), items, 4, digits=4)
    assert [r["id"] for r in hits.orderBy("rank").collect()] == [0, 1, 2, 3]


def test_codes_by_batches(spark):
    """codes of whole batches are those of the column expression, ties to the lower word; no row without a word."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(70, 6))
    books = [rng.normal(size=(5, 2)).tolist() for _ in range(3)]
    for b in books:
        b[3] = b[1]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, img array<double>").repartition(3)
    lit = F.array(*[F.array(*[F.array(*map(F.lit, w)) for w in b]) for b in books])
    want = {r["id"]: r["c"] for r in items.select("id", retrieve.pq_encode(F.col("img"), lit, 2).alias("c")).collect()}
    assert {r["id"]: r["codes"] for r in retrieve.pq_coded(items, books).collect()} == want
    assert retrieve.pq_coded(items, [[], [], []]).count() == 0


def test_largest_of_rows():
    """the k-th largest is found among few, also below infinities and among copies."""
    rng = np.random.default_rng(10)
    s = np.round(rng.normal(size=(6, 200)), 1)
    s[0], s[1, 20:], s[2, 9:] = 0.5, -np.inf, -np.inf
    for k in (1, 3, 10, 50, 150):
        want = np.zeros(s.shape, bool)
        for r, row in enumerate(s):
            want[r, [c for c in sorted(range(200), key=lambda c: (-row[c], c))[:k] if row[c] > -np.inf]] = True
        assert (blocks.best_of(s, k) == want).all()


def test_codes_without_words(spark, tmp_path):
    """without the vectors that the code words are taken from there are no codes, and so no rows."""
    rows = [(i, [float(i % 7)] * 64, 0) for i in range(40, 80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalogue.QUERIES["pq_search"](spark, str(tmp_path)).count() == 0


def feedback(x, y, qid, k, passes, alpha=0.5):
    """(best ids, ledger) of one query by plain loops."""
    v = np.hstack([x, y]) / np.sqrt(2)
    q = q0 = np.hstack([x[qid], x[qid]]) / np.sqrt(2)

    def ranked(q):
        hits = sorted((i for i in range(len(v)) if i != qid), key=lambda i: (-round(float(v[i] @ q), 12), i))[:k]
        s = [float(v[i] @ q) for i in hits]
        return hits, float(np.mean(v[hits] @ q0)), s[0] - float(np.mean(s[1:]))

    hits, ev, margin = ranked(q)
    ledger = [(1, ev, margin, "initial")]
    for n in range(2, passes + 1):
        q = (1 - alpha) * q + alpha * v[hits[:3]].mean(axis=0)
        q /= np.linalg.norm(q)
        new, e, m = ranked(q)
        verdict = "converged" if new == hits else "accepted" if e > ev else "rejected"
        ledger.append((n, e, m, verdict))
        if verdict != "accepted":
            break
        hits, ev = new, e
    return hits, ledger


def test_feedback_without_joins(spark, monkeypatch):
    """F16: all passes of a stretch of queries run in one task, from items filed once; nothing is joined."""
    for name, value in (("FILE_VALUES", 160), ("TILE", 7), ("KEPT_BYTES", 3000)):
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(11)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x = unit(rng.normal(size=(12, 4))[rng.integers(12, size=90)] + 0.4 * rng.normal(size=(90, 4)))
    y = unit(x + 0.3 * rng.normal(size=(90, 4)))
    items = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(90, None, None)], "id long, img array<double>, txt array<double>").repartition(4)
    asked = items.where("id % 2 = 0").select(F.col("id").alias("qid"), F.col("img").alias("qv"))

    def join(*args, **options):
        raise AssertionError("hits meet the items in a join")

    monkeypatch.setattr(type(items), "join", join)
    best, ledger = retrieve.refine(asked, items, k=5, passes=5)
    hits, steps = {}, {}
    for r in best.orderBy("qid", "rank").collect():
        hits.setdefault(r["qid"], []).append(r["id"])
    for r in ledger.orderBy("qid", "pass").collect():
        steps.setdefault(r["qid"], []).append(r)
    assert hits.keys() == steps.keys() == set(range(0, 90, 2))
    seen = set()
    for i in hits:
        want, path = feedback(x, y, i, 5, 5)
        assert hits[i] == want and [(r["pass"], r["verdict"]) for r in steps[i]] == [(n, v) for n, _, _, v in path]
        assert [(r["ev"], r["margin"]) for r in steps[i]] == [pytest.approx((e, m)) for _, e, m, _ in path]
        seen |= {v for *_, v in path}
    assert seen == {"initial", "accepted", "rejected", "converged"}


def test_feedback_on_few_items(spark):
    """F16: fewer items than hits, and none but the query itself."""
    items = spark.createDataFrame([(0, [1.0, 0.0], [1.0, 0.0]), (1, [0.6, 0.8], [0.6, 0.8])], "id long, img array<double>, txt array<double>")
    ask = lambda d: d.select(F.col("id").alias("qid"), F.col("img").alias("qv"))
    best, ledger = retrieve.refine(ask(items), items)
    assert [(r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in best.orderBy("qid").collect()] == [(0, 1, 1, 0.6), (1, 1, 0, 0.6)]
    assert [(r["qid"], r["pass"], r["verdict"], round(r["margin"], 6)) for r in ledger.orderBy("qid", "pass").collect() if r["pass"] == 1] == [(0, 1, "initial", 0.6), (1, 1, "initial", 0.6)]
    alone = items.where("id = 0")
    assert [d.count() for d in retrieve.refine(ask(alone), alone)] == [0, 0]
