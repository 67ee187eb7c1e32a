"""Storage: upserts, cleaning ingest, ordered lookups, manifests, towers, exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec
from ..session import saved

#: Limits of cleaned text fields, and of crawled images.
NAME_CHARS, DESCRIPTION_CHARS, CAFE_CHARS = 60, 300, 80
MIN_BYTES, MIN_SIDE = 20_000, 160
TOWER = T.StructType([T.StructField("path", T.StringType()), T.StructField("caption", T.StringType()), T.StructField("labels", T.MapType(T.StringType(), T.DoubleType())), T.StructField("item_emb", T.ArrayType(T.DoubleType())), T.StructField("model", T.StringType()), T.StructField("created_at", T.TimestampType())])


def open_table(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """The named table, created empty if it isn't there."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)
    return spark.table(name)


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows by unique key; of rows that share one, the last by ``seq`` stays."""
    return first_of(old.unionByName(new, allowMissingColumns=True), [key], [F.desc(seq)])


def publish(records: DataFrame, model: str, *, key: str = "path") -> DataFrame:
    """Tower rows: records stamped with their model and time, one a key, the last by ``seq``.

    ``key`` is another column where two records may share a path without being versions of one.
    """
    stamped = first_of(records, [key], [F.desc("seq")])
    return stamped.select("path", "caption", "labels", "item_emb", F.lit(model).alias("model"), F.date_trunc("second", F.current_timestamp()).alias("created_at"))


def one_model(tower: DataFrame) -> DataFrame:
    """The tower, or an error where vectors of several models or lengths would mix."""
    kinds = tower.agg(F.count_distinct("model", F.size("item_emb")).alias("kinds"))
    ok = F.when(F.col("kinds") > 1, F.raise_error(F.lit("vectors of several models"))).otherwise(F.lit(True))
    return tower.crossJoin(F.broadcast(kinds)).where(ok).drop("kinds")


def tower_matrix(tower: DataFrame):
    """(paths, matrix) of a tower that a server holds in memory, in the order of paths; nothing and 0 x 0 if it is empty."""
    import numpy as np

    rows = tower.select("path", "item_emb").orderBy("path").toArrow()
    paths = rows.column("path").to_pylist()
    return paths, np.array(rows.column("item_emb").to_pylist(), np.float32) if paths else np.empty((0, 0), np.float32)


def _or_json(df: DataFrame, name: str, schema: str) -> Column:
    """A column that holds either a value or its JSON."""
    return F.from_json(name, schema) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name).cast(schema)


def clean(records: DataFrame, dim: int) -> DataFrame:
    """Cleaned records with ``ok``: vectors of ``dim`` finite values made unit, names filled in, texts trimmed.

    Rows that fail keep ok = false, so that they can be counted.
    """
    v = _or_json(records, "vector", "array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cafe = _or_json(records, "cafe", "struct<name:string>")["name"]
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    name = filled(F.trim(F.coalesce("name", F.lit(""))), F.substring(filled(F.col("description"), F.lit("food")), 1, NAME_CHARS))
    return records.select(
        "pos",
        F.coalesce((F.size(v) == dim) & finite, F.lit(False)).alias("ok"),
        name.alias("name"),
        F.substring(F.coalesce("description", F.lit("")), 1, DESCRIPTION_CHARS).alias("caption"),
        F.substring(F.coalesce(cafe, F.lit("")), 1, CAFE_CHARS).alias("cafe"),
        F.coalesce("image", F.lit("")).alias("url"),
        vec.unit(v).alias("vector"),
    )


def running(rows: DataFrame, order: list[str], amount: str, name: str = "upto") -> DataFrame:
    """Adds the sum of ``amount`` up to each row in ``order``: within sorted ranges, plus the sums of those before.

    Rows should be unique in ``order`` (group them first), so that a frequent value is one row and no range is hot.
    """
    ranged = saved(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy("_p").agg(F.sum(amount).alias("_c"))
    start = sums.select(F.col("_p").alias("_q"), (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_start"))
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(start), F.col("_p") == F.col("_q")).withColumn(name, F.col("_start") + F.sum(amount).over(w)).drop("_p", "_q", "_start")


def numbered(rows: DataFrame, order: list[str], limit: int | None = None, name: str = "id") -> DataFrame:
    """Consecutive numbers from 0 in ``order``: sorted ranges, then each range's start from the counts before it.

    No task sees more than one range.  The ranges are materialised first, as their bounds come from a sample
    and both uses must see the same ones.
    """
    ranged = saved(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    start = counts.select(F.col("_p").alias("_q"), (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_start"))
    w = Window.partitionBy("_p").orderBy(*order)
    out = ranged.join(F.broadcast(start), F.col("_p") == F.col("_q")).withColumn(name, F.col("_start") + F.row_number().over(w) - 1).drop("_p", "_q", "_start")
    return out if limit is None else out.where(F.col(name) < limit)


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], *, strict: bool = False) -> DataFrame:
    """Rows side by side by place (``pos``, from 0), each side in its own order; the longer one's rest drops out.

    ``strict`` raises where the sides differ in length.  Orders should be unique; ties are dealt in any order.
    """
    a, b = numbered(left, left_order, name="pos"), numbered(right, right_order, name="_pos")
    if not strict:
        return a.join(b, F.col("pos") == F.col("_pos")).drop("_pos")
    paired = F.when(F.col("pos").isNotNull() & F.col("_pos").isNotNull(), True).otherwise(F.raise_error(F.lit("sides of different lengths")))
    return a.join(b, F.col("pos") == F.col("_pos"), "full").where(paired).drop("_pos")


def lookup(ranked: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Records of ranked ids, in rank order; unknown ids drop out."""
    return ranked.join(records, key).orderBy("rank")


def strided(rows: DataFrame, want: int, key: str = "id") -> DataFrame:
    """About ``want`` rows evenly spaced by id, exactly the first ``want`` of them."""
    n = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") / want)).alias("_s"))
    return rows.crossJoin(F.broadcast(n)).where(F.col(key) % F.col("_s") == 0).drop("_s").orderBy(key).limit(want)


def to_blob(v: Column) -> Column:
    """Little-endian float32 bytes of a vector."""
    @F.pandas_udf("binary")
    def pack(xs: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([None if x is None else np.asarray(x, "<f4").tobytes() for x in xs])

    return pack(v)


def from_blob(b: Column) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(xs: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([None if x is None else np.frombuffer(x, "<f4") for x in xs])

    return unpack(b)


def gallery_json(items: DataFrame) -> DataFrame:
    """Interchange rows: JSON with vectors to five digits."""
    short = lambda c: F.transform(c, lambda x: F.round(x, 5))
    return items.select("id", F.to_json(F.struct(F.col("path").alias("file"), "caption", "tags", short("img").alias("image_emb"), short("txt").alias("text_emb"))).alias("json"))


def read_gallery_json(rows: DataFrame) -> DataFrame:
    """Items of interchange rows, the fused vector derived."""
    p = F.from_json("json", "file string, caption string, tags array<string>, image_emb array<double>, text_emb array<double>")
    x = rows.select("id", p.alias("x")).select("id", "x.*")
    return x.withColumn("fused", vec.fuse("image_emb", "text_emb"))


def read_gallery_file(spark: SparkSession, path: str) -> DataFrame:
    """A gallery document {items: [...]} as rows, the fused vector derived."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("items").alias("x")).select("x.*")
    return rows.withColumn("fused", vec.fuse("image_emb", "text_emb"))


def discovered(pages: DataFrame, term: str) -> DataFrame:
    """Records of a search service's JSON answers (column ``json``); those without a picture drop out."""
    value = "struct<value:string>"
    schema = f"query struct<pages:map<string,struct<title:string,imageinfo:array<struct<thumburl:string,url:string,descriptionurl:string,extmetadata:struct<Artist:{value},LicenseShortName:{value}>>>>>>"
    p = pages.select(F.explode(F.map_values(F.from_json("json", schema)["query"]["pages"])).alias("p"))
    info = F.get("p.imageinfo", F.lit(0))
    text = lambda c: F.coalesce(c, F.lit(""))
    out = p.select(F.regexp_replace(text(F.col("p.title")), "^File:", "").alias("name"), text(F.coalesce(F.nullif(info["thumburl"], F.lit("")), info["url"])).alias("thumb_url"), text(info["descriptionurl"]).alias("source"), text(info["extmetadata"]["Artist"]["value"]).alias("author"), text(info["extmetadata"]["LicenseShortName"]["value"]).alias("license"), F.lit(term).alias("term"))
    return out.where("thumb_url <> ''")


def merge_providers(results: DataFrame, cap: int = 12) -> tuple[DataFrame, DataFrame]:
    """(merged, ledger) of rows (provider, provider_pos, pos, thumb_url): the first provider of a thumb wins."""
    merged = first_of(results, ["thumb_url"], [F.col("provider_pos"), F.col("pos")]).orderBy("provider_pos", "pos").limit(cap)
    return merged, results.groupBy("provider").agg(F.count("*").alias("n"))


def provider_ledger(asked: DataFrame, results: DataFrame) -> DataFrame:
    """(provider, n, error) for every asked provider: (provider, error), a failed one with 0 results and its error in words."""
    n = results.groupBy("provider").agg(F.count("*").alias("n"))
    return asked.join(n, "provider", "left").select("provider", F.coalesce("n", F.lit(0)).alias("n"), "error")


def unseen(found: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return found.join(manifest.select(key).distinct(), key, "left_anti")


def allowed(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """urls (host, path) under robots rules (rule_host, prefix, allow): the longest prefix decides; no rule allows."""
    hit = urls.join(robots, (F.col("host") == F.col("rule_host")) & F.col("path").startswith(F.col("prefix")), "left")
    keys = [c for c in urls.columns]
    # of rules equally long the one that allows
    return hit.groupBy(*keys).agg(F.coalesce(F.max_by("allow", F.struct(F.length("prefix"), "allow")), F.lit(True)).alias("allowed"))


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """(rule_host, prefix, allow) of robots.txt files (host, robots).

    The group that names the agent holds, else the group for ``*``; lines of several groups for one agent add up.
    Comments, unknown lines and empty rules (which allow all) give no rule; a null file none.
    """

    @F.pandas_udf("array<struct<prefix:string,allow:boolean>>")
    def parse(texts: pd.Series) -> pd.Series:
        def rules(text):
            groups, names, open_ = {}, [], False
            for line in (text or "").splitlines():
                field, _, value = (x.strip() for x in line.split("#")[0].partition(":"))
                field = field.lower()
                if field == "user-agent":
                    names = [*names, value.lower()] if open_ else [value.lower()]
                    open_ = True
                elif field in ("allow", "disallow"):
                    open_ = False
                    for n in names:
                        groups.setdefault(n, [])
                        if value:
                            groups[n].append({"prefix": value, "allow": field == "allow"})
            own = [n for n in groups if n != "*" and n in agent.lower()]
            return groups[max(own, key=len)] if own else groups.get("*", [])

        return pd.Series([rules(t) for t in texts], dtype=object)

    return files.select(F.col("host").alias("rule_host"), F.explode(parse("robots")).alias("r")).select("rule_host", "r.*")


def keepable(size: Column, width: Column, height: Column) -> Column:
    return (size >= MIN_BYTES) & (F.least(width, height) >= MIN_SIDE)


def dimension_scales(items: DataFrame, column: str = "img") -> DataFrame:
    """One row (scales): per dimension the largest absolute value over 127, 1 where that is 0; from partial maxima."""

    def peak(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        top = None
        for b in batches:
            if b.num_rows:
                x = np.abs(np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)).max(axis=0)
                top = x if top is None else np.maximum(top, x)
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array([top.tolist()], pa.list_(pa.float64()))], names=["top"])

    parts = items.select(F.col(column).cast("array<double>")).mapInArrow(peak, "top array<double>")
    peaks = parts.select(F.posexplode("top").alias("pos", "x")).groupBy("pos").agg(F.max("x").alias("x"))
    scale = F.when(F.col("x") == 0, 1.0).otherwise(F.col("x") / 127)
    return peaks.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", scale.alias("s")))), lambda s: s["s"]).alias("scales"))


def export_pack(items: DataFrame, path: str, books, rotation=None, *, recalls: dict[str, float] | None = None) -> None:
    """A compressed export in two tiers: product codes, and int8 vectors under one scale a dimension.

    Rows go to Parquet (id, codes, i8, and url without the prefix that all share, where items have urls).  The
    model is one row: code books, rotation, scales, the prefix, and the recalls the caller measured; sizes are
    checked on load.  Null urls stay null.
    """
    from ..operators import index

    scales = dimension_scales(items)
    numbers = scales.first()["scales"]

    def pack(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = index.block(b, 1)
            codes = index.encode(x, books, rotation)[0]
            i8 = np.rint(x / np.array(numbers)).astype(int)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.tolist(), pa.list_(pa.int16())), pa.array(i8.tolist(), pa.list_(pa.int8())), b.column(2)], names=["id", "codes", "i8", "url"])

    spark = items.sparkSession
    rows = items.select("id", "img", (F.col("url") if "url" in items.columns else F.lit(None)).cast("string").alias("url"))
    ends = rows.agg(F.min("url").alias("a"), F.max("url").alias("b"))  # what the first and the last share, all share
    shared = "size(filter(sequence(1, greatest(1, least(length(a), length(b)))), k -> substr(a, 1, k) = substr(b, 1, k)))"
    prefix = ends.selectExpr(f"coalesce(substr(a, 1, {shared}), '') AS prefix")
    short = rows.crossJoin(F.broadcast(prefix)).select("id", "img", F.expr("substr(url, length(prefix) + 1)").alias("url"))
    short.mapInArrow(pack, "id long, codes array<smallint>, i8 array<tinyint>, url string").write.mode("overwrite").parquet(f"{path}/rows")
    model = [(len(books), books.shape[1], books.shape[2], books.ravel().tolist(), None if rotation is None else rotation.ravel().tolist(), recalls or {})]
    made = spark.createDataFrame(model, "m int, ks int, sub int, books array<double>, rotation array<double>, recalls map<string,double>")
    made.crossJoin(scales).crossJoin(prefix.withColumnRenamed("prefix", "url_prefix")).write.mode("overwrite").parquet(f"{path}/model")


def unpacked(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(id, img, url) of a loaded pack: int8 values times their dimension's scale, whole urls."""
    both = rows.crossJoin(F.broadcast(model.select("scales", "url_prefix")))
    return both.select("id", F.zip_with("i8", "scales", lambda c, s: c * s).alias("img"), F.concat("url_prefix", "url").alias("url"))


def load_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, model) of an export; rows whose lengths don't fit the model raise."""
    model, rows = spark.read.parquet(f"{path}/model"), spark.read.parquet(f"{path}/rows")
    width = F.col("m") * F.col("sub")
    ok = (F.size("codes") == F.col("m")) & (F.size("i8") == width) & (F.size("scales") == width) & (F.size("books") == F.col("ks") * width)
    checked = rows.crossJoin(F.broadcast(model.select("m", "sub", "ks", "books", "scales"))).where(F.when(ok, True).otherwise(F.raise_error(F.lit("pack sizes don't match"))))
    return checked.drop("m", "sub", "ks", "books", "scales"), model
