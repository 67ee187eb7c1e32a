"""Exact quantiles, running sums, packs, links, robots, gates and streams against brute force."""

import random
import urllib.parse
import urllib.robotparser

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import calibrate, index
from quillon.sources import store
from quillon.streaming import jobs


def test_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 1.0, 1.0, rng.random() * 9])) for _ in range(400)] + [("one", 4.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["k"], r["p"]): r["q"] for r in calibrate.quantiles(df, probs, key="k").collect()}
    for k in ("a", "b", None, "one"):
        own = [v for g, v in rows if g == k and v is not None]
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(own, p))
    assert calibrate.quantiles(df.limit(0), probs).count() == 0


def test_ks(spark):
    rng = random.Random(5)
    ref = [rng.choice([0.5, rng.random()]) for _ in range(300)]
    live = [(rng.choice("xyz"), rng.choice([0.5, rng.random() * 1.2 - 0.1])) for _ in range(200)] + [("alone", 7.0)]
    got = {r["window_id"]: r for r in calibrate.ks(spark.createDataFrame([(v,) for v in ref], "value double"), spark.createDataFrame(live, "window_id string, value double")).collect()}
    for w in ("x", "y", "z", "alone"):
        own = [v for k, v in live if k == w]
        at = sorted({*ref, *own})
        want = max(abs(sum(v <= t for v in ref) / len(ref) - sum(v <= t for v in own) / len(own)) for t in at)
        assert got[w]["ks"] == pytest.approx(want) and (got[w]["n_ref"], got[w]["n_live"]) == (len(ref), len(own))


def test_running(spark):
    rows = [(i, (i * 7) % 11) for i in range(200)]
    got = sorted((r["k"], r["upto"]) for r in store.running(spark.createDataFrame(rows, "k long, n long").repartition(6), ["k"], "n").collect())
    assert got == list(zip(range(200), np.cumsum([r[1] for r in rows]).tolist(), strict=True))


def test_pack_round_trip(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 16)) * np.array([9.0, 0.0] + [1.0] * 14)  # one wide dimension, one empty
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), None if i == 5 else f"https://pics.example.org/a/{i:03d}.jpg") for i, v in enumerate(x)]
    items = spark.createDataFrame(rows, "id long, img array<double>, url string").repartition(3)
    books = index.pq_train(items, 4, 16, iters=3)
    store.export_pack(items, str(tmp_path / "p"), books, recalls={"codes": 0.5})
    packed, model = store.load_pack(spark, str(tmp_path / "p"))
    m = model.first()
    assert m["url_prefix"] == "https://pics.example.org/a/" and m["recalls"] == {"codes": 0.5} and m["scales"][1] == 1.0
    back = {r["id"]: r for r in store.unpacked(packed, model).collect()}
    assert [back[i]["url"] for i in range(400)] == [r[2] for r in rows]
    y = np.array([back[i]["img"] for i in range(400)])
    assert np.abs(y - x).max() <= np.abs(x).max(axis=0).max() / 254 + 1e-9
    exact, refined = np.argsort(-(x @ x.T), axis=1)[:, :10], np.argsort(-(x @ y.T), axis=1)[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, refined, strict=True)])
    assert recall >= 0.9
    store.export_pack(items.drop("url"), str(tmp_path / "q"), books)
    assert store.load_pack(spark, str(tmp_path / "q"))[1].first()["url_prefix"] == ""


BASES = ["http://a.org/b/c/d;p?q", "https://a.org", "https://a.org/", "http://a.org/x/y/", "http://a.org/x?u=/v/w"]
REFS = ["g", "./g", "g/", "/g", "//h.net/x", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "g..", "./g/.", "g/./h", "g/../h", "http://z.org/k", "mailto:x@y", "g?y/../x", "a/b/../../c"]


def test_url_join(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", text.url_join(F.col("b"), F.col("r")).alias("u")).collect()
    for row in got:
        want = urllib.parse.urldefrag(urllib.parse.urljoin(row["b"], row["r"]))[0]
        if urllib.parse.urlparse(want).path == "":  # an empty path and "/" name the same page
            assert row["u"].replace("?", "/?").rstrip("/") in (want.replace("?", "/?").rstrip("/"), want) or row["u"].rstrip("/") == want
        else:
            assert row["u"] == want, (row, want)


def test_links_and_images(spark):
    html = """<A HREF='one'>x</A><a class=b href=two>y</a><a\nhref = "three four">z</a><a data-href="no" title=t>n</a><area href="no"><a href="">e</a><IMG alt="" SRC=pic.jpg><img src='a b.png'/>"""
    d = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    got = d.select(text.hrefs(F.col("html")).alias("l"), text.images(F.col("html")).alias("i")).collect()
    assert got[0]["l"] == ["one", "two", "three four"] and got[0]["i"] == ["pic.jpg", "a b.png"]
    assert got[2]["l"] == [] and got[2]["i"] == []


def test_decoded(spark):
    raw = [b"plain", "é日".encode(), b"\xff\xfeab\xc3", b"", None]
    got = spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(raw)], "i int, b binary").select("i", text.decoded(F.col("b")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: None if r is None else r.decode("utf-8", "replace") for i, r in enumerate(raw)}


ROBOTS = {
    "a.org": "User-agent: *\nDisallow: /private\nAllow: /private/open # ok\n\nUser-agent: other\nDisallow: /\n",
    "b.org": "user-agent: collector\nuser-agent: x\nDisallow: /no\n\nUser-agent: *\nDisallow: /",
    "c.org": "Disallow: /ignored\nUser-agent: *\nDisallow:\n",
    "d.org": None,
}


def test_robots(spark):
    files = spark.createDataFrame(list(ROBOTS.items()), "host string, robots string")
    urls = [(h, p) for h in ROBOTS for p in ("/", "/private/x", "/no/y", "/ok", "/ignored")]
    got = store.allowed(spark.createDataFrame(urls, "host string, path string"), store.robots_rules(files, "Collector/1.0"))
    for r in got.collect():
        parser = urllib.robotparser.RobotFileParser()
        parser.parse((ROBOTS[r["host"]] or "").splitlines())
        assert r["allowed"] == parser.can_fetch("Collector/1.0", f"http://{r['host']}{r['path']}"), r
    inside = store.allowed(spark.createDataFrame([("a.org", "/private/open/z")], "host string, path string"), store.robots_rules(files))
    assert inside.first()["allowed"]  # the longest rule decides


def test_gate_over_a_written_reference(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "reference")
    base = spark.createDataFrame([(rng.random(),) for _ in range(300)], "value double")
    first = calibrate.gate_at(spark, path, base).first()
    assert (first["frozen"], first["passed"]) == (False, True)
    again = calibrate.gate_at(spark, path, base).first()
    assert (again["frozen"], again["level"], again["passed"]) == (True, "stable", True)
    low = calibrate.gate_at(spark, path, base.select((F.col("value") * 0.3).alias("value"))).first()
    assert (low["level"], low["passed"]) == ("drift", False) and "psi" in low["reasons"]
    assert spark.read.parquet(path).count() == 300


def test_ingest_replays_and_polls(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(10).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    run = lambda: jobs.ingest(stream(), sink, checkpoint=state).trigger(availableNow=True).start().awaitTermination()
    run()
    run()  # nothing new
    spark.range(10, 25).write.mode("append").parquet(source)
    run()
    rows, meta = spark.read.parquet(f"{sink}/rows/*"), spark.read.parquet(f"{sink}/meta/*")
    assert sorted(r["id"] for r in rows.collect()) == list(range(25)) and sorted(r["rows"] for r in meta.collect()) == [10, 15]
    seen = []
    q = jobs.polled(stream(), 1, lambda batch, n: seen.append(batch.count()), checkpoint=str(tmp_path / "poll")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 25


def test_distinct_within_a_watermark(spark, tmp_path):
    rows = [(i % 5, f"2024-01-01 00:0{i % 10}:00") for i in range(40)]
    spark.createDataFrame(rows, "k int, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t timestamp").parquet(str(tmp_path / "in"))
    got = jobs.drained(jobs.append_new(stream, "k", within=("t", "1 hour")))
    assert sorted(r["k"] for r in got.collect()) == list(range(5))
