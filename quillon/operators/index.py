"""Index training: k-means, product codes, rotated product codes, and index freshness.

Each round ships the current model (bounded: centroids or code books) and gets back one partial sum per
partition and cell, added up by a grouped sum; vectors never leave the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..session import new_path, saved

#: Rows of the bounded sample for each centroid or code word wanted.
POOL = 8


def block(batch, column: int):
    """Rows of a list column as a matrix."""
    import numpy as np

    return np.asarray(batch.column(column).flatten()).reshape(batch.num_rows, -1).astype(float)


def _sums(items: DataFrame, assign, width: int, column: str):
    """{cell: (n, sum vector)} over all rows; ``assign`` gives for a matrix (cells, vectors to add)."""
    import numpy as np

    def run(batches) -> Iterator:
        import pyarrow as pa

        total: dict = {}
        for b in batches:
            for cell, vectors in assign(block(b, 0)):
                for c in np.unique(cell):
                    own = vectors[cell == c]
                    n, s = total.get(int(c), (0, 0.0))
                    total[int(c)] = n + len(own), s + own.sum(axis=0)
        rows = [(c, n, list(map(float, s))) for c, (n, s) in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["cell", "n", "s"])

    part = items.select(column).mapInArrow(run, "cell long, n long, s array<double>")
    added = part.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)])
    return {r["cell"]: (r["n"], np.array([r[f"s{i}"] for i in range(width)])) for r in added.collect()}


def first_centroids(items: DataFrame, c: int, column: str = "img"):
    """Starting centroids: the c rows with the least hash of their id; a bounded sample."""
    import numpy as np

    rows = items.select("id", column).where(F.col(column).isNotNull()).orderBy(F.xxhash64("id"), "id").limit(c).collect()
    return np.array([r[column] for r in rows], float)


def spread_out(pool, c: int):
    """c rows of a matrix, each the farthest by dot product from those before it, from the first; with the rows left."""
    import numpy as np

    near, chosen = np.full(len(pool), -np.inf), [0]
    while len(chosen) < min(c, len(pool)):
        near = np.maximum(near, pool @ pool[chosen[-1]])
        near[chosen] = np.inf
        chosen.append(int(near.argmin()))
    return pool[chosen], np.delete(pool, chosen, axis=0)


def kmeans(items: DataFrame, c: int, *, iters: int = 6, column: str = "img", spread: bool = False, reseed: bool = False):
    """Unit centroids by Lloyd rounds on the dot product.

    They start from rows by hash, or with ``spread`` from rows of a bounded sample (POOL rows a centroid) that lie
    far apart.  A cell that gets no rows keeps its centroid, or with ``reseed`` takes an unused row of that sample.
    """
    import numpy as np

    pool = first_centroids(items, POOL * c if spread or reseed else c, column)
    centroids, spare = spread_out(pool, c) if spread else (pool[:c], pool[c:])
    unused = iter(spare if reseed else ())
    for _ in range(iters):
        now = centroids

        def assign(x, now=now):
            return [((x @ now.T).argmax(axis=1), x)]

        sums = _sums(items, assign, centroids.shape[1], column)
        centroids = np.array([sums[i][1] if i in sums and np.linalg.norm(sums[i][1]) > 0 else next(unused, now[i]) for i in range(len(now))])
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


def ivf_train(items: DataFrame, c: int, *, sample: int = 100_000, iters: int = 6, column: str = "img"):
    """Centroids fitted on at most ``sample`` rows, by the least hash of their id, empty cells reseeded; ``filed`` files every row."""
    some = saved(items.select("id", column).orderBy(F.xxhash64("id"), "id").limit(sample))
    return kmeans(some, c, iters=iters, column=column, reseed=True)


def pq_train(items: DataFrame, m: int, ks: int, *, iters: int = 6, column: str = "img", rotation=None, books=None):
    """Code books (m, ks, d/m) by Lloyd rounds on squared distance; all subspaces advance in one job a round.

    A word that gets no rows takes an unused row of a bounded sample (POOL rows a word), while there are any.
    """
    import numpy as np

    pool = first_centroids(items, POOL * ks, column)
    pool = np.stack(np.split(pool if rotation is None else pool @ rotation.T, m, axis=1))
    if books is None:
        books = pool[:, :ks]
    sub, unused = books.shape[2], [iter(p[ks:]) for p in pool]
    for _ in range(iters):
        now = books

        def assign(x, now=now):
            x = x if rotation is None else x @ rotation.T
            parts = np.split(x, m, axis=1)
            return [(j * ks + (2 * p @ now[j].T - (now[j] ** 2).sum(axis=1)).argmax(axis=1), p) for j, p in enumerate(parts)]

        sums = _sums(items, assign, sub, column)
        books = np.stack([[sums[j * ks + i][1] / sums[j * ks + i][0] if j * ks + i in sums else next(unused[j], now[j][i]) for i in range(now.shape[1])] for j in range(m)])
    return books


def encode(x, books, rotation=None):
    """Codes of a matrix's rows, and their reconstruction."""
    import numpy as np

    x = x if rotation is None else x @ rotation.T
    parts = np.split(x, len(books), axis=1)
    codes = np.stack([(2 * p @ b.T - (b**2).sum(axis=1)).argmax(axis=1) for p, b in zip(parts, books, strict=True)], axis=1)
    return codes, np.hstack([b[codes[:, j]] for j, b in enumerate(books)])


def opq_train(items: DataFrame, m: int, ks: int, *, outer: int = 4, inner: int = 2, column: str = "img"):
    """(rotation, books): product codes and an orthogonal Procrustes step in turn, from the identity.

    A step needs only the d x d product of reconstructions and rows, summed over partitions.
    """
    import numpy as np

    d = len(items.select(column).first()[0])
    rotation, books = np.eye(d), None
    for _ in range(outer):
        books = pq_train(items, m, ks, iters=inner, column=column, rotation=rotation, books=books)
        r, b = rotation, books

        def gram(batches, r=r, b=b) -> Iterator:
            import pyarrow as pa

            total = np.zeros((d, d))
            for batch in batches:
                x = block(batch, 0)
                total += encode(x, b, r)[1].T @ x
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

        part = items.select(column).mapInArrow(gram, "i long, row array<double>")
        rows = part.groupBy("i").agg(*[F.sum(F.get("row", F.lit(k))).alias(f"c{k}") for k in range(d)]).orderBy("i").collect()
        u, _, vt = np.linalg.svd(np.array([[r[f"c{k}"] for k in range(d)] for r in rows]))
        rotation = u @ vt
    return rotation, books


def filed(items: DataFrame, centroids, *, column: str = "img") -> DataFrame:
    """Adds ``cell`` by block products."""
    from pyspark.sql.types import LongType, StructField, StructType

    at = items.columns.index(column)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cell = (block(b, at) @ centroids.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64())], names=[*b.schema.names, "cell"])

    return items.mapInArrow(run, StructType([*items.schema.fields, StructField("cell", LongType())]))


def _with(rows: DataFrame, column: str, name: str, kind, of) -> DataFrame:
    """Adds ``name``: what ``of`` gives for the matrix of a column, batch by batch."""
    at = rows.columns.index(column)
    schema = StructType([*rows.schema.fields, StructField(name, kind)])

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of(block(b, at)).tolist(), to_arrow_type(kind))], names=[*b.schema.names, name])

    return rows.mapInArrow(run, schema)


def turned(rows: DataFrame, rotation, *, column: str = "img", name: str = "turn") -> DataFrame:
    """Adds the vector after a rotation, by block products."""
    return _with(rows, column, name, ArrayType(DoubleType()), lambda x: x @ rotation.T)


def coded(rows: DataFrame, books, rotation=None, *, column: str = "img") -> DataFrame:
    """Adds ``codes``, the nearest word of each subspace, by block products."""
    return _with(rows, column, "codes", ArrayType(IntegerType()), lambda x: encode(x, books, rotation)[0])


def tabled(queries: DataFrame, books, rotation=None, *, column: str = "qv") -> DataFrame:
    """Adds ``tables``: per subspace the products with every code word."""
    import numpy as np

    def of(x):
        x = x if rotation is None else x @ rotation.T
        return np.stack([p @ b.T for p, b in zip(np.split(x, len(books), axis=1), books, strict=True)], axis=1)

    return _with(queries, column, "tables", ArrayType(ArrayType(DoubleType())), of)


def healed(corpus: DataFrame, folder: str, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """(index, rebuilt): the index kept under a folder, built anew where it is missing or counts other rows than the corpus.

    Each build is a version of its own and counts only once its entry is written, so a build that dies leaves the
    old version in place.
    """
    spark, n = corpus.sparkSession, corpus.count()
    try:
        last = spark.read.parquet(f"{folder}/versions").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        last = None
    if last and last["rows"] == n:
        return spark.read.parquet(last["path"]), False
    path = f"{folder}/{new_path(spark, 'index').rsplit('/', 1)[-1]}"
    build(corpus).write.parquet(path)
    entry = [((last["version"] if last else 0) + 1, n, path)]
    spark.createDataFrame(entry, "version long, rows long, path string").coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return spark.read.parquet(path), True


def stale(meta: DataFrame, corpus: DataFrame) -> DataFrame:
    """(index, rows, now, stale): an index is stale if it is missing or counts other rows than the corpus."""
    n = corpus.agg(F.count("*").alias("now"))
    return meta.crossJoin(F.broadcast(n)).withColumn("stale", ~F.col("rows").eqNullSafe(F.col("now")))
