"""Trained searches against exact search, for every item whose id is divisible by 20."""

import numpy as np
import pytest

from quillon.plans import catalogue
from quillon.sources.gallery import gallery


@pytest.fixture(scope="module")
def exact(spark, data):
    rows = sorted((r["id"], r["img"]) for r in gallery(spark, data).select("id", "img").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    return {int(i): [int(j) for j in ids[np.lexsort((ids, -(x @ v)))]] for i, v in zip(ids, x, strict=True) if i % 20 == 0}


@pytest.mark.parametrize(("name", "k"), [("ivf_search", 10), ("pq_search", 10), ("opq_search", 10), ("cascade_search", 5), ("ivf_trained", 10), ("pq_trained", 10), ("opq_trained", 10), ("cascade_trained", 5)])
def test_recall(spark, data, exact, name, k):
    hits = {}
    found = catalogue.QUERIES[name](spark, data)
    for r in (found.where("stage = 'exact'") if "stage" in found.columns else found).select("qid", "id").collect():
        hits.setdefault(r["qid"], set()).add(r["id"])
    assert hits.keys() == exact.keys() and all(len(h) <= k for h in hits.values())
    recall = np.mean([len(h & set(exact[q][:k])) / k for q, h in hits.items()])
    print(f"{name} recall@{k} {recall:.3f} over {len(hits)} queries")
    assert recall >= 0.9
