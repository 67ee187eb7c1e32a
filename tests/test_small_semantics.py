"""Expressions, phases, drafts by a model, towers in memory, files, and the table of encoders, by known answers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import encode, vec
from quillon.operators import explain, search
from quillon.plans.vector_queries import pca_2d
from quillon.sources import files, store
from quillon.sources.gallery import clustered


def test_terms():
    assert vec.terms("a + b - c") == [(1.0, "a"), (1.0, "b"), (-1.0, "c")] and vec.terms("a") == [(1.0, "a")]
    for wrong in ("", "a b", "a * b", "a +"):
        with pytest.raises(ValueError, match="names"):
            vec.terms(wrong)


def test_arithmetic(spark):
    rows = [(1, "cat1", [1.0, 0.0]), (2, "dog", [0.0, 1.0]), (3, "cat2", [0.6, 0.8]), (4, "anti", [-1.0, 0.0])]
    items = spark.createDataFrame(rows, "id long, path string, img array<double>").withColumn("txt", F.col("img"))
    best = search.arithmetic(items, "cat + dog", 1).first()
    assert best["path"] == "cat2" and math.isclose(best["score"], 1.4 / math.sqrt(2))
    assert [r["path"] for r in search.arithmetic(items, "cat - dog", 4).orderBy("rank").collect()] == ["cat1", "cat2", "dog", "anti"]
    for expression, why in (("cat + horse", "no item"), ("cat + anti", "cancel")):
        with pytest.raises(Exception, match=why):
            search.arithmetic(items, expression, 1).collect()


def test_drafts(spark):
    def good():
        return lambda facts: [None if "none" in f else "The top match shows a cat. It scores 0.99." for f in facts]

    def broken():
        raise RuntimeError("no model here")

    rows = spark.createDataFrame([(1, "a cat", [(["cat"], 0.31), (["cat", "dog"], 0.28)]), (2, "a dog", [(["dog"], 0.31), (["sky"], 0.2)])], "id int, query string, hits array<struct<tags:array<string>,score:double>>")
    rows = rows.withColumn("ev", explain.evidence(F.col("query"), F.col("hits")))
    got = {r["id"]: (r["said"], r["source"]) for r in explain.drafted(rows, good).collect()}
    plain = {r["id"]: r["said"] for r in rows.select("id", explain.describe(F.col("ev")).alias("said")).collect()}
    assert got == {1: ("The top match shows a cat.", "model"), 2: (plain[2], "none")}
    assert {(r["said"], r["source"]) for r in explain.drafted(rows, broken).collect()} == {(s, "none") for s in plain.values()}
    assert {r["source"] for r in explain.drafted(rows, lambda: lambda facts: ["Zebras everywhere!"] * len(facts)).collect()} == {"gate"}


def test_tower_in_memory(spark):
    tower = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [1.0, 0.0])], "path string, item_emb array<double>")
    paths, m = store.tower_matrix(tower)
    assert paths == ["a", "b"] and m.tolist() == [[1, 0], [0, 1]] and m.dtype == np.float32
    paths, m = store.tower_matrix(tower.limit(0))
    assert paths == [] and m.shape == (0, 0)


def test_tables_are_made_once(spark):
    spark.sql("drop table if exists made_tower")
    assert store.open_table(spark, "made_tower", store.TOWER).count() == 0
    spark.sql("insert into made_tower (path, caption) values ('p', 'c')")
    assert store.open_table(spark, "made_tower", store.TOWER).count() == 1
    spark.sql("drop table made_tower")


def test_files(spark, tmp_path):
    for name, content in (("a.bin", b"ab"), ("sub/b.bin", b"xyz"), ("bad.bin", b"!"), ("skip.txt", b"t")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)

    def make():
        def embed(content):
            if content == b"!":
                raise ValueError("unreadable")
            return [float(len(content)), 1.0]

        return embed

    got = files.embedded(files.read_files(spark, str(tmp_path), "*.bin"), make).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["img"] for r in got} == {"a.bin": [2.0, 1.0], "b.bin": [3.0, 1.0], "bad.bin": None}
    assert all(len(r["hash"]) == 12 for r in got) and sum(r["img"] is None for r in got) == 1


def test_gallery_file(spark, tmp_path):
    path = tmp_path / "gallery.json"
    path.write_text(json.dumps({"items": [{"file": "x.jpg", "caption": "c", "tags": ["a"], "image_emb": [1.0, 0.0], "text_emb": [0.0, 1.0]}]}, indent=1))
    row = store.read_gallery_file(spark, str(path)).first()
    assert row["file"] == "x.jpg" and np.allclose(row["fused"], np.array([1, 0, 0, 1]) / math.sqrt(2))


def test_encoders():
    assert encode.resolve("clip-b32") == encode.resolve("openai/clip-vit-base-patch32") and encode.resolve("clip-b32").dim == 512
    assert encode.resolve("siglip2-base")[2:] == ("siglip", "max_length", 64)
    assert encode.resolve("else/where") == encode.Model("else/where", None, "clip")


def test_principal_axes(spark):
    items = clustered(spark, 300, dim=8, blobs=3, noise=0.3, seed=5)
    rows = sorted((r["id"], r["img"]) for r in items.collect())
    x = np.array([r[1] for r in rows])
    axes = np.linalg.svd(x - x.mean(axis=0))[2][:2]
    axes *= np.where(np.abs(axes.max(axis=1)) >= np.abs(axes.min(axis=1)), 1, -1)[:, None]
    p = x @ axes.T
    p = (p - p.min(axis=0)) / (p.max(axis=0) - p.min(axis=0))
    got = np.array([(r["x"], r["y"]) for r in pca_2d(items).orderBy("id").collect()])
    assert np.abs(got - p).max() <= 1e-4
    assert [tuple(r) for r in pca_2d(items.limit(1)).collect()] == [(0, 0.0, 0.0)] and pca_2d(items.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 0.0, 0.0]) for i in range(3)], "id long, img array<double>")
    assert {(r["x"], r["y"]) for r in pca_2d(same).collect()} == {(0.0, 0.0)}
