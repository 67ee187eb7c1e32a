"""Near-dedup by similarity against all pairs of shingle sets."""

import random

from quillon.llm import similar

from .test_operators import brute_simhash


def brute_stay(rows):
    """Ids that single linkage at Jaccard 0.8 of five-word shingle sets keeps, smallest first."""
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    stay, todo = [], set(range(len(rows)))
    while todo:
        front = {todo.pop()}
        group = set()
        while front:
            group |= front
            front = {j for j in todo for i in front if near(sets[i], sets[j])}
            todo -= front
        stay.append(min(rows[i][0] for i in group))
    return sorted(stay)


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = similar.drop_similar(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == brute_stay(rows)


def test_edited_copies(spark):
    """Chains of edited copies, copies at exactly 0.8, null, blank and short texts."""
    rng = random.Random(3)
    rows = [(0, None), (1, " \n"), (2, "one two"), (3, "One  two"), (4, "one three")]
    for _ in range(15):
        words = [f"w{rng.randrange(9999)}" for _ in range(220)]
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.choice((1, 3, 5, 12))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
    words = [f"e{i}" for i in range(40)]
    rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words + [f"f{i}" for i in range(9)]))]
    got = sorted(r["doc_id"] for r in similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_stay(rows)
    assert len(rows) - 1 not in got  # 36 of 45 shingles
    assert (brute_simhash(rows[-2][1]) ^ brute_simhash(rows[-1][1])).bit_count() > 3


def test_pipeline_similar(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, data)
    stages = dict(corpus_pipeline.SIMILAR_STAGES)
    stay = stages["similarity near-dedup"](spark, kept, data)
    assert sorted(r["doc_id"] for r in stay.collect()) == brute_stay([(r["doc_id"], r["text"]) for r in kept.collect()])
    ids = {r["doc_id"] for r in corpus_pipeline.run_similar(spark, data).select("doc_id").distinct().collect()}
    assert ids and ids <= {r["doc_id"] for r in stay.collect()}
