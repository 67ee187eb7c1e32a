"""SimHash near-duplicates: fingerprints of word shingles, linked at few differing bits.

Candidates come from a pigeonhole split.  With BLOCKS blocks and at most d differing bits, two close
fingerprints agree on at least BLOCKS - d blocks, so each is filed under every choice of that many blocks
and close pairs share a file.  Only distinct fingerprints are filed, so copies cost nothing; a file is
compared in squares of bounded size and gives back a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import only, set_aside, store
from .words import encode, lower_ascii

SHINGLE, DISTANCE, BLOCKS = 3, 3, 6
SQUARE = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text's word shingles (repeats count); 0 for no words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = lower_ascii(encode(text)).split()
    if not words:
        return 0
    if len(words) < shingle:
        h = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        flat, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends)]
        h = [xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    total, values = np.zeros(64, np.int64), np.array(h, np.uint64)
    for i in range(0, len(values), 8192):
        total += np.unpackbits(values[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(values)).view(">i8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """SimHash as a long column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def hexed(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _files(blocks: int, distance: int) -> list[int]:
    """Bit masks: every choice of ``blocks - distance`` of the blocks of a 64-bit fingerprint."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(a, b, distance: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links within ``a`` (``b`` None) or between ``a`` and ``b``."""
    import numpy as np

    n, left = len(a), np.array(a, np.int64)
    right = left if b is None else np.array(b, np.int64)
    near = np.bitwise_count((left[:, None] ^ right[None, :]).view(np.uint64)) <= distance
    fresh_a, fresh_b = np.ones(n, bool), np.ones(len(right), bool)
    if b is None:
        fresh_b = fresh_a
    for seed in range(n):
        if not fresh_a[seed]:
            continue
        fresh_a[seed], queue = False, [(0, seed)]
        while queue:
            side, u = queue.pop()
            row = (near[u] & fresh_b) if side == 0 else (near[:, u] & fresh_a)
            for v in np.flatnonzero(row):
                (fresh_b if side == 0 else fresh_a)[v] = False
                yield (left[u], right[v]) if side == 0 else (right[u], left[v])
                queue.append((0 if b is None else 1 - side, int(v)))


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all that lie within ``distance``."""
    masks = [_signed(m) for m in _files(blocks, distance)]
    filed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("file", "key"))
    sizes = filed.groupBy("file", "key").count().where("count > 1").withColumnsRenamed({"file": "_f", "key": "_k"})
    shared = filed.join(sizes, (F.col("file") == F.col("_f")) & (F.col("key") == F.col("_k")))
    # a file of n goes to squares (i, j) of two parts of at most about SQUARE each
    parts = F.ceil(F.col("count") / F.lit(SQUARE)).cast("int")
    shared = shared.withColumn("part", F.pmod(F.xxhash64("fp"), parts).cast("int"))
    spread = shared.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    squares = spread.groupBy("file", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list(F.when(F.col("part") <= F.col("other"), F.col("fp"))).alias("a"), F.collect_list(F.when(F.col("part") > F.col("other"), F.col("fp"))).alias("b"))

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def edges(inner: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"a": int(x), "b": int(y)} for x, y in forest(p, None if same else q, distance)] for same, p, q in zip(inner, a, b, strict=True)])

    found = squares.select(F.explode(edges(F.col("i") == F.col("j"), "a", "b")).alias("e"))
    return found.select("e.a", "e.b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node it reaches.

    Large-star and small-star steps, alternated until the edges stay the same; each writes its edges to
    shared storage.  Only counts and checksums come to the driver.
    """
    at, last = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"), None
    while True:
        now = at.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(now) == last or now[0] == 0:
            return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        last = tuple(now)
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
        star = store(both.where("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        least = star.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
        moved = star.join(least, F.col("a") == F.col("_a"))
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
        at = store(small.where("a <> b").distinct(), "small-star")


def classes(prints: DataFrame, first: Column, distance: int = DISTANCE) -> DataFrame:
    """(fp, first): for every distinct ``fp`` of ``prints``, the least ``first`` over its component."""
    distinct = store(prints.groupBy("fp").agg(first.alias("own")), "fingerprints")
    roots = store(components(links(distinct.select("fp"), distance)), "roots")
    rooted = distinct.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "own")
    linked = rooted.groupBy("root").agg(F.min("own").alias("first"))
    of_linked = rooted.drop("own").join(linked.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root")).select("fp", "first")
    alone = distinct.join(roots, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("own").alias("first"))
    return alone.unionByName(of_linked)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row, repeated rows included.

    Null and empty texts have fingerprint zero and link like any other.  Null ids belong to their
    component but never name it, unless it has no other.  Equal texts share a fingerprint and so a component.
    Long texts are hashed whole; an empty table gives no row.  Other columns, whatever their names, are ignored.
    """
    prints = store(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), shingle).alias("fp")), "prints")
    of = classes(prints, F.min("doc_id"), distance).withColumnRenamed("fp", "_fp")
    return prints.join(of, F.col("fp") == F.col("_fp")).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """Docs with exactly one row of each component: the one with the smallest id (null ids last).

    Of rows repeated under that id one stays.  Null and empty texts form a component like any other; long
    texts are hashed whole; an empty table stays empty.  Input columns keep their names and order, those
    called like working columns too.
    """
    mark = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    own, moved = set_aside(docs, "_fp", "_row", "_dropped")
    kept = store(own.select(*own.columns, fingerprints(F.col(text_col), shingle).alias("_fp"), F.monotonically_increasing_id().alias("_row")), "marked")
    slim = kept.select(F.col("_fp").alias("fp"), "_row", id_col)
    of = classes(slim, F.min(mark), distance).select(F.col("fp").alias("_f"), F.col("first.row").alias("first"))
    dropped = slim.join(of, F.col("fp") == F.col("_f")).where("_row <> first").select(F.col("_row").alias("_dropped"))
    return only(kept.join(dropped, F.col("_row") == F.col("_dropped"), "left_anti"), docs.columns, moved)
