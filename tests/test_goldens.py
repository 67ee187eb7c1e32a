"""Known answers of small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import encode, text, vec
from quillon.operators import calibrate, dedupe, explain, index, judge, rank, retrieve
from quillon.sources import store


def one(df):
    return df.first()[0]


def votes(spark, rows):
    return spark.createDataFrame([(rows,)], "v array<struct<name:string,score:double,confidence:double>>")


def test_calibrate(spark):
    s = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4)], "score double")
    got = {r["alpha"]: r["qhat"] for r in calibrate.calibrate(s, [0.2, 0.05]).collect()}
    assert got == {0.2: 0.4, 0.05: math.inf}


def test_jackknife_is_leave_one_out(spark):
    import random

    rng = random.Random(3)
    xs = [rng.choice([0.1, 0.2, 0.5, rng.random()]) for _ in range(37)]

    def brute(alpha):
        hits = 0
        for i, x in enumerate(xs):
            rest = sorted(xs[:i] + xs[i + 1 :])
            k = math.ceil((len(rest) + 1) * (1 - alpha))
            hits += k > len(rest) or x <= rest[k - 1]
        return hits / len(xs)

    got = {r["alpha"]: r["coverage"] for r in calibrate.jackknife(spark.createDataFrame([(x,) for x in xs], "score double"), [0.4, 0.2, 0.05]).collect()}
    assert got == pytest.approx({a: brute(a) for a in (0.4, 0.2, 0.05)})


def test_parse_score(spark):
    cases = {"0.7": 0.7, ".7": 0.7, "7/10": 0.7, "8 out of 10": 0.8, "70%": 0.7, "score: 0.9": 0.9, "relevant": None, "2.5": None, "150%": None, "1.5": 1.0, "-0.5": 0.5, "": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", judge.parse_score(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == pytest.approx(cases)
    assert one(spark.createDataFrame([(None,)], "t string").select(judge.parse_score(F.col("t")))) is None


def test_council(spark):
    c = votes(spark, [("a", 0.8, 0.9), ("b", None, 1.0), ("c", 0.7, 0.6)]).select(judge.council(F.col("v")).alias("c")).first()["c"]
    assert (c["decision"], c["n_valid"]) == ("relevant", 2) and c["mean"] == pytest.approx((0.8 * 0.9 + 0.7 * 0.6) / 1.5)
    h = votes(spark, [("a", 0.1, 1.0), ("b", 0.9, 1.0)]).select(judge.council(F.col("v")).alias("c")).first()["c"]
    assert (h["decision"], h["reason"]) == ("abstain", "hung jury") and h["consensus"] == pytest.approx(0.2)
    assert one(votes(spark, [("a", 0.9, 1.0)]).select(judge.council(F.col("v"))["reason"])) == "no quorum"
    even = votes(spark, [("a", 0.4, 0.0), ("b", 0.6, -1.0)]).select(judge.council(F.col("v"))["mean"])
    assert one(even) == pytest.approx(0.5)
    assert one(votes(spark, [("a", 0.4, 1.0), ("b", 0.6, 1.0)]).select(judge.majority(F.col("v"))["decision"])) == "abstain"


def test_compose(spark):
    def trust(rows):
        d = spark.createDataFrame([([(str(i), t, w) for i, (t, w) in enumerate(rows)],)], "v array<struct<name:string,trust:double,weight:double>>")
        return d.select(judge.compose(F.col("v")).alias("t")).first()["t"]

    t = trust([(1.0, 1.0), (0.71, 1.0), (0.73, 1.2), (1.0, 0.7)])
    assert t["level"] == "high" and t["score"] == pytest.approx(0.8426, abs=1e-4)
    t = trust([(0.7, 1.0), (None, 1.0), (None, 1.2), (0.9, 0.7)])
    assert (t["level"], t["reason"]) == ("medium", "capped") and t["score"] == pytest.approx(0.7824, abs=1e-4)
    assert trust([(0.2, 1.0), (0.9, 1.0)])["level"] == "abstain" and trust([(0.4, 1.0), (0.9, 1.0)])["reason"] == "composed"


def test_lenses(spark):
    d = spark.range(1)
    v = lambda c: one(d.select(c))
    assert [v(judge.gate_trust(F.lit(x), 0.85, 0.75, 0.65)) for x in (0.85, 0.68)] == [1.0, 0.4]
    assert v(judge.conformal_trust(F.lit(0.5), F.lit(0.6))) is None
    assert v(judge.conformal_trust(F.lit(0.63), F.lit(0.63))) == pytest.approx(0.5) and v(judge.conformal_trust(F.lit(0.8), F.lit(0.6))) == pytest.approx(0.75)
    assert v(judge.conformal_trust(F.lit(0.8), F.lit(float("-inf")))) is None


def test_debate(spark):
    def run(xs, rounds=12, ws=None):
        d = spark.createDataFrame([(xs, ws or [1.0] * len(xs))], "x array<double>, w array<double>")
        return d.select(judge.debate(F.col("x"), F.col("w"), rounds=rounds).alias("d"), judge.n_factions(F.col("x")).alias("f")).first()

    assert run([0.1, 0.2, 0.9])["f"] == 2
    assert run([0.2, 0.8], 1)["d"]["x"] == [0.2, 0.8] and run([0.4, 0.6], 1)["d"]["x"] == pytest.approx([0.5, 0.5])
    assert run([0.4, 0.5], 1, [0.0, 0.0])["d"]["x"] == pytest.approx([0.45, 0.45])
    assert run([0.2, 0.5, 0.8])["d"]["x"] == pytest.approx([0.5] * 3, abs=1e-3)
    assert run([0.0, 0.28, 0.56, 0.84], 3)["d"]["rounds"] == 3


def test_detectors(spark):
    frame = lambda xs, w=None: spark.createDataFrame([(w, float(x)) for x in xs] if w else [(float(x),) for x in xs], "window_id string, value double" if w else "value double")
    xs = [i / 60 for i in range(60)]
    assert calibrate.psi(frame(xs), frame(xs, "w")).first()["psi"] == pytest.approx(0)
    assert calibrate.psi(frame([1] * 9), frame(xs, "w")).first()["psi"] == 0
    assert calibrate.ks(frame([0] * 5), frame([1] * 5, "w")).first()["ks"] == 1
    assert one(spark.range(1).select(calibrate.ks_critical(F.lit(60), F.lit(60)))) == pytest.approx(1.36 * math.sqrt(120 / 3600))
    levels, last = [], -1
    for f in (0.0, 0.15, 0.35, 0.6):
        live = calibrate.contaminate(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "seq long, value double"), f, 0.35).select(F.lit("w").alias("window_id"), "value")
        m = calibrate.monitor(frame(xs), live).first()
        levels.append(m["level"])
        assert m["psi"] >= last
        last = m["psi"]
    assert levels[0] == "stable" and levels[-1] == "drift"


def test_contaminate(spark):
    run = lambda xs, f: [r["value"] for r in calibrate.contaminate(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "seq long, value double"), f).orderBy("seq").collect()]
    assert sum(x < 1 for x in run([1.0] * 5, 0.5)) == 3 and run([0.5], 0.5) == pytest.approx([0.3])
    for n in (1, 7, 20, 61):
        for f in (0.0, 0.15, 0.35, 0.6, 1.0):
            k = math.floor(f * n + 0.5)
            hit = {i * n // k for i in range(k)}
            assert [x < 1 for x in run([1.0] * n, f)] == [i in hit for i in range(n)]


#: Feedback of the learned ranker: features and labels.
FEEDBACK = [([0.30, 0.28, 3, 1.00], 1), ([0.25, 0.20, 0, 0.50], 0), ([0.22, 0.24, 2, 0.33], 1), ([0.20, 0.10, 0, 0.25], 0)]


def test_learned_ranker(spark):
    rows = [(1, i, [float(v) for v in x], y) for i, (x, y) in enumerate(FEEDBACK)]
    fit = rank.ranknet(spark.createDataFrame(rows, "user_id long, seq int, features array<double>, label int")).first()
    assert fit["w"] == pytest.approx([0.333747, 0.131501, 1.213983, 0.576071], abs=1e-6) and fit["n_pairs"] == 4
    cands = [(1, 0.60, [0.30, 0.28, 3.0, 1.00]), (1, 0.55, [0.20, 0.10, 0.0, 0.50]), (1, 0.50, [0.24, 0.26, 2.0, 0.33])]
    c = spark.createDataFrame(cands, "qid long, base_score double, features array<double>")
    out = rank.blend(c, F.array(*map(F.lit, fit["w"])), F.lit(4.0)).orderBy(F.desc("base_score")).collect()
    assert out[0]["beta"] == pytest.approx(2 / 7) and sorted((r["score"] for r in out), reverse=True) == pytest.approx([1, 0.357143, 0.110698], abs=1e-6)
    good = spark.createDataFrame([(1, [0.30, 0.30, 2.0, 1.0], 1)], "user_id long, features array<double>, label int")
    assert rank.rocchio(good).first()["w"] == pytest.approx([1 + 0.75 * (0.15 - 0.5), 0.75 * (0.15 - 0.5), 0.75 * 0.4, 0.75])
    assert list(rank.fit_weights([[0.30, 0.30, 2, 1.0]], [1])) == pytest.approx(rank.rocchio(good).first()["w"])
    assert list(rank.fit_weights([], [])) == [1.0, 0.0, 0.0, 0.0]


def test_cross_network(spark):
    rows = [("A", 0.80, 0.0, 0.0, 1.0), ("B", 0.70, 0.0, 3.0, 0.5), ("C", 0.60, 0.0, 0.0, 0.33)]
    d = spark.createDataFrame(rows, "item string, a double, b double, c double, d double")
    x = F.array("a", "b", "c", "d")
    order = lambda w: [r["item"] for r in d.orderBy(F.desc(rank.dcn_score(x, rank.hand_set(4, 2, 0, 0, 2, w)))).collect()]
    assert order(0.0) == ["A", "B", "C"] and order(6.0)[0] == "B"


def test_explain(spark):
    hits = [(["cat", "pet", "animal"], 0.31), (["cat", "pet", "portrait"], 0.27), (["cat", "dog", "pet"], 0.22)]
    d = spark.createDataFrame([("a fluffy cat", hits), ("q", [(["cat", "pet"], 0.21), (["cat", "dog"], 0.20)]), ("q", [(["cat"], 0.12)]), ("q", [])], "q string, hits array<struct<tags:array<string>,score:double>>")
    rows = d.withColumn("ev", explain.evidence(F.col("q"), F.col("hits"))).withColumn("own", explain.describe(F.col("ev")))
    draft = F.lit("These all show a car. The match is weak at 0.99.")
    got = rows.select("ev", "own", explain.verify(F.col("own"), F.col("ev")).alias("gate"), explain.explain(draft, F.col("ev")).alias("said"), explain.verify(draft, F.col("ev")).alias("draft")).collect()
    assert got[0]["ev"]["shared"] == ["cat", "pet"] and [r["ev"]["strength"] for r in got] == ["strong", "weak", "very weak", "very weak"]
    assert all(not s["reasons"] for r in got for s in r["gate"] if "No results" not in s["text"])
    assert all(s["reasons"] for s in got[0]["draft"]) and got[0]["said"] == got[0]["own"]
    assert got[3]["own"] == "No results to explain."


def test_text(spark):
    d = spark.range(1)
    v = lambda c: one(d.select(c))
    assert v(text.norm(F.lit("Stars!"))) == "star" and v(text.norm(F.lit("as"))) == "as"
    assert v(text.numbers(F.lit("at 31% and .27 or 0.5, not 12"))) == pytest.approx([0.31, 0.27, 0.5])
    assert v(text.and_join(F.array(*map(F.lit, "abc")))) == "a, b and c" and v(text.and_join(F.array(F.lit("a")))) == "a"
    base = F.lit("https://h.org/a/b?x")
    assert [v(text.url_join(base, F.lit(h))) for h in ("/c", "d#e", "http://z/", "//y/q")] == ["https://h.org/c", "https://h.org/a/d", "http://z/", "https://y/q"]
    assert v(vec.combine([(1.0, F.array(F.lit(1.0))), (-1.0, F.array(F.lit(1.0)))])) is None


def clustered(n, dim, centres, noise, seed, queries=0):
    import numpy as np

    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    c = unit(rng.standard_normal((centres, dim)))
    return unit(c[rng.integers(0, centres, n + queries)] + noise / math.sqrt(dim) * rng.standard_normal((n + queries, dim)) * 4)


@pytest.fixture(scope="module")
def blobs(spark):
    x = clustered(3000, 32, 32, 0.2, 0)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, img array<double>").cache(), x


def test_trained_cells(spark, blobs):
    import numpy as np

    items, x = blobs
    c = index.kmeans(items, 32)
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
    f = index.filed(items, c)
    assert f.count() == 3000 and f.where("cell < 0 or cell > 31").count() == 0
    q = items.where("id < 40").select(F.col("id").alias("qid"), F.col("img").alias("qv"))
    true = {(r["qid"], r["id"]) for r in retrieve.exact_blocks(q, items, 10).collect()}
    got = retrieve.ivf_search(q, f, F.array(*[F.array(*map(F.lit, map(float, v))) for v in c]), 10, 4).collect()
    assert len({(r["qid"], r["id"]) for r in got} & true) / len(true) > 0.7 and max(r["scanned"] for r in got) < 1500


def test_codes(blobs):
    import numpy as np

    items, x = blobs
    mse = lambda b, r=None: float((((x if r is None else x @ r.T) - index.encode(x, b, r)[1]) ** 2).sum(axis=1).mean())
    few, more = index.pq_train(items, 4, 16, iters=1), index.pq_train(items, 4, 16, iters=6)
    r, b = index.opq_train(items, 4, 16, outer=3, inner=2)
    assert np.allclose(r @ r.T, np.eye(32), atol=1e-8)
    assert mse(more) <= mse(few) + 1e-9 and mse(b, r) < mse(few)


def test_exact_blocks_equal_scores(spark, blobs):
    items, x = blobs
    got = retrieve.exact_blocks(items.where("id < 5").select(F.col("id").alias("qid"), F.col("img").alias("qv")), items, 7).orderBy("qid", "rank").collect()
    for q in range(5):
        want = sorted(range(3000), key=lambda i: (-round(float(x[i] @ x[q]), 12), i))[:7]
        assert [r["id"] for r in got if r["qid"] == q] == want


def test_greedy_dedup(spark):
    import numpy as np

    x = clustered(150, 16, 40, 0.1, 3)
    t, kept = 0.95, []
    for i in range(len(x)):
        if not kept or max(x[kept] @ x[i]) < t:
            kept.append(i)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, img array<double>")
    assert sorted(r["id"] for r in dedupe.greedy_keep(d, t).where("kept").collect()) == kept and 1 < len(kept) < 150
    pairs = {(i, j) for i in range(150) for j in range(i + 1, 150) if x[i] @ x[j] >= t}
    assert {(r["i"], r["j"]) for r in dedupe.close_pairs(d, t).collect()} == pairs and np.isfinite(x).all()


def test_feedback_never_loses(spark):
    x, n = clustered(200, 16, 8, 0.4, 5), 200
    items = spark.createDataFrame([(i, v.tolist(), v[::-1].tolist()) for i, v in enumerate(x)], "id long, img array<double>, txt array<double>")
    best, ledger = retrieve.refine(items.where("id < 6").select(F.col("id").alias("qid"), F.col("img").alias("qv")), items)
    steps = {}
    for r in ledger.orderBy("qid", "pass").collect():
        steps.setdefault(r["qid"], []).append(r)
    assert len(steps) == 6 and best.count() == 30 and n == items.count()
    for s in steps.values():
        assert s[0]["verdict"] == "initial" and all(b["ev"] > a["ev"] for a, b in zip(s, s[1:], strict=False) if b["verdict"] == "accepted")
        assert all(r["verdict"] == "accepted" for r in s[1:-1])


def test_crawl_levels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src long, dst long")
    got = dedupe.crawl(spark.createDataFrame([(1,)], "node long"), edges, 5)
    assert {r["node"]: r["level"] for r in got.collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_pack(spark, blobs, tmp_path):
    items, _ = blobs
    books = index.pq_train(items, 4, 8, iters=1)
    store.export_pack(items, str(tmp_path / "pack"), books)
    rows, model = store.load_pack(spark, str(tmp_path / "pack"))
    assert rows.count() == 3000 and model.first()["ks"] == 8
    rows.withColumn("codes", F.slice("codes", 1, 2)).limit(5).write.mode("overwrite").parquet(str(tmp_path / "bad/rows"))
    model.write.parquet(str(tmp_path / "bad/model"))
    with pytest.raises(Exception, match="pack sizes"):
        store.load_pack(spark, str(tmp_path / "bad"))[0].collect()


def test_store(spark):
    t = store.open_table(spark, "tower_test", store.TOWER)
    assert t.count() == 0 and store.open_table(spark, "tower_test", store.TOWER).columns == t.columns
    two = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "model string, item_emb array<double>")
    with pytest.raises(Exception, match="several models"):
        store.one_model(two).collect()
    ids = store.numbered(spark.createDataFrame([(x,) for x in "dbacfe"], "k string"), ["k"]).orderBy("id").collect()
    assert [(r["id"], r["k"]) for r in ids] == list(enumerate("abcdef"))


def test_encoder(spark):
    d = spark.createDataFrame([("a cat",), ("a cat",), (None,), ("",)], "t string")
    got = encode.encode_texts(d, "t", lambda: encode.stub(8)).collect()
    assert len(got) == 4 and sum(r["text_emb"] is None for r in got) == 1
    assert encode.resolve("stub-64").dim == 64 and encode.resolve("other").kind == "clip"


def test_large_query_sets_go_in_blocks(spark, monkeypatch):
    """Broadcasts hold at most QUERY_VALUES values; blocks give the same rows as one broadcast."""
    from pyspark.sql import functions as F

    from quillon.operators import rank, search

    x = clustered(120, 8, 6, 0.3, 9)
    items = spark.createDataFrame([(i, v.tolist(), v[::-1].tolist()) for i, v in enumerate(x)], "id long, img array<double>, txt array<double>")
    q = items.where("id < 12").select(F.col("id").alias("qid"), F.col("img").alias("qv"))
    cells = [x[i].tolist() for i in (0, 40, 80)]
    centroids = F.array(*[F.array(*map(F.lit, v)) for v in cells])
    filed = retrieve.assign_cells(items, centroids)
    likes = spark.createDataFrame([(u, (7 * u + k) % 120) for u in range(9) for k in range(3)], "user_id long, id long")
    scales = F.array(*[F.lit(0.01)] * 8)

    def everything():
        best, ledger = retrieve.refine(q, items)
        results = (retrieve.top_k(retrieve.score_all(q, items), 5), retrieve.ivf_search(q, filed, centroids, 5, 2), search.search(q, items, method="int8", k=5, scales=scales), rank.recommend(likes, items, 4), best, ledger)
        return [sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in d.collect()) for d in results]

    assert len(retrieve.parts(q)) == 1
    whole = everything()
    scanned = {r["qid"]: r["scanned"] for r in retrieve.ivf_search(q, filed, centroids, 5, 2).collect()}
    sizes = {r["cell"]: r["count"] for r in filed.groupBy("cell").count().collect()}
    near = dict.fromkeys(range(12), 0)
    for r in retrieve.probe_cells(q, centroids, 2).collect():
        near[r["qid"]] += sizes.get(r["cell"], 0)
    assert scanned == near
    monkeypatch.setattr(retrieve, "QUERY_VALUES", 24)
    blocks = retrieve.parts(q)
    assert len(blocks) == 4 and sum(b.count() for b in blocks) == 12
    assert everything() == whole


def test_greedy_dedup_of_copies(spark):
    """A group of copies forms no pairs; zero and null vectors have no copies."""
    v, w = [1.0, 0.0], [0.96, 0.28]
    rows = [(i, v) for i in range(5, 300)] + [(1, w), (2, w), (400, [0.0, 1.0]), (401, [0.0, 0.0]), (402, [0.0, 0.0]), (403, None), (404, None)]
    d = spark.createDataFrame(rows, "id long, img array<double>")
    kept = lambda t: sorted(r["id"] for r in dedupe.greedy_keep(d, t).where("kept").collect())
    assert kept(0.99) == [1, 5, 400, 401, 402, 403, 404]
    assert kept(0.9) == [1, 400, 401, 402, 403, 404]
    assert dedupe.greedy_keep(d, 0.9).count() == len(rows) and dedupe.greedy_keep(d.limit(0), 0.9).count() == 0


def test_best_of_a_shared_tag(spark, monkeypatch):
    from pyspark.sql import functions as F

    x = clustered(90, 8, 5, 0.4, 4)
    x[1], x[61], x[31] = x[2], x[2], x[2]  # ties
    tags = [["all"] * 2 + [f"t{i % 7}"] if i % 3 else [f"t{i % 7}", "odd"] if i % 2 else None if i % 4 else ["alone" + str(i)] for i in range(90)]
    items = spark.createDataFrame([(i, v.tolist(), t) for i, (v, t) in enumerate(zip(x, tags, strict=True))], "id long, img array<double>, tags array<string>").repartition(3)
    asked = items.select(F.col("id").alias("qid"), F.col("img").alias("qv"), F.col("tags").alias("qtags"))
    want = {}
    for i in range(90):
        near = [(-round(float(x[i] @ x[j]), 9), j) for j in range(90) if j != i and set(tags[i] or ()) & set(tags[j] or ())]
        if near:
            want[i] = min(near)
    assert 0 < len(want) < 90
    for most in (4_000_000, 300):
        monkeypatch.setattr(retrieve, "QUERY_VALUES", most)
        assert {r["qid"]: (-round(r["best"], 9), r["best_id"]) for r in retrieve.best_sharing(asked, items).collect()} == want
    assert retrieve.best_sharing(asked.limit(0), items).count() == 0 and retrieve.best_sharing(asked, items.limit(0)).count() == 0
