"""Near-duplicates by Jaccard similarity of word-shingle sets: MinHash bands propose, whole texts decide.

BANDS bands of ROWS minima: a pair at exactly 0.8 shares no band with probability (1 - 0.8**4)**24, some
3 in a million; a pair above it with less.  Every proposed pair is verified on its shingle sets.
Rows of one shingle set count once.  A bucket first links its members to its least one; only buckets
whose members are still in different components then give their pairs across components.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import components
from .storage import only, set_aside, store
from .words import encode, lower_ascii

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4


def shingles(text: str | None, shingle: int = SHINGLE):
    """Sorted distinct 64-bit hashes of a text's word shingles; of all its words where they are fewer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = lower_ascii(encode(text)).split()
    h = [xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))] if words else []
    return np.unique(np.array(h, np.uint64))


@lru_cache(1)
def _factors():
    import numpy as np

    a, b = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
    return 2 * a + np.uint64(1), b


def sketch(hashes) -> tuple[int, list[int]]:
    """(key of the set, its bands' hashes) as signed longs."""
    import numpy as np
    from xxhash import xxh64_intdigest

    a, b = _factors()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 512):
        mixed = a * hashes[None, i : i + 512]
        mixed += b
        least = np.minimum(least, mixed.min(axis=1))
    signed = lambda data: int(np.uint64(xxh64_intdigest(data, 42)).astype(np.int64))
    return signed(hashes.tobytes()), [signed(band.tobytes()) for band in least.reshape(BANDS, ROWS)]


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of keys whose shingle sets have at least the similarity."""
    import numpy as np

    @F.pandas_udf("boolean")
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        of = lru_cache(64)(lambda t: shingles(t, shingle))

        def pair(a, b) -> bool:
            x, y = of(a), of(b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both >= similarity * (len(x) + len(y) - both) - 1e-9

        return pd.Series([pair(a, b) for a, b in zip(left, right, strict=True)], dtype=bool)

    a, b = (texts.select(F.col("key").alias(f"_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")
    both = pairs.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"))
    return both.where(close("text_a", "text_b")).select("a", "b")


def links(sets: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(node, root) over the keys of ``sets`` (key, bands) that have a similar other one."""
    filed = sets.select("key", F.posexplode("bands").alias("band", "bucket"))
    least = filed.groupBy("band", "bucket").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    filed = store(filed.join(least, ["band", "bucket"]), "buckets")
    stars = filed.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    near = store(verified(stars, texts, similarity, shingle), "stars")
    roots = store(components(near), "roots")
    named = filed.join(roots, F.col("key") == F.col("node"), "left").select("band", "bucket", "least", "key", F.coalesce("root", "key").alias("root"))
    mixed = named.groupBy("band", "bucket").agg(F.countDistinct("root").alias("n")).where("n > 1").drop("n")
    named = store(named.join(mixed, ["band", "bucket"]), "mixed")
    other = named.select("band", "bucket", F.col("key").alias("b"), F.col("root").alias("root_b"))
    across = named.where("key <> least").withColumnRenamed("key", "a").join(other, ["band", "bucket"]).where("a < b and root <> root_b").select("a", "b").distinct()
    return components(near.unionByName(verified(across, texts, similarity, shingle)))


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Docs with exactly one row of each component of similar rows: the one with the smallest id (null ids last).

    Null and blank texts are one set.  Of rows repeated under an id one stays.  Columns keep their names and order.
    """

    @F.pandas_udf("key long, bands array<long>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(shingles(t, shingle)) for t in texts], columns=["key", "bands"])

    own, moved = set_aside(docs, "_key", "_row", "_sketch", "_dropped")
    numbered = store(own.withColumn("_row", F.monotonically_increasing_id()), "marked")
    slim = numbered.select("_row", F.col(id_col).alias("_id"), sketched(F.col(text_col)).alias("_sketch"))
    slim = store(slim.select("_row", "_id", F.col("_sketch.key").alias("key"), F.col("_sketch.bands").alias("bands")), "sketches")
    mark = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    sets = store(slim.groupBy("key").agg(F.min(mark).alias("own"), F.first("bands").alias("bands")), "sets")
    texts = numbered.select("_row", F.col(text_col).alias("text")).join(sets.select("key", F.col("own.row").alias("_at")), F.col("_row") == F.col("_at")).select("key", "text")
    roots = store(links(sets.select("key", "bands"), texts, similarity, shingle), "similar")
    rooted = sets.select("key", "own").join(roots, F.col("key") == F.col("node"), "left").select("key", "own", F.coalesce("root", "key").alias("root"))
    first = rooted.groupBy("root").agg(F.min("own").alias("first")).withColumnRenamed("root", "_root")
    of = rooted.join(first, F.col("root") == F.col("_root")).select(F.col("key").alias("_k"), F.col("first.row").alias("first"))
    dropped = slim.join(of, F.col("key") == F.col("_k")).where("_row <> first").select(F.col("_row").alias("_dropped"))
    return only(numbered.join(dropped, F.col("_row") == F.col("_dropped"), "left_anti"), docs.columns, moved)
