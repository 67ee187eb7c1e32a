"""A polite breadth-first crawl over fetched pages: robots, domains, caps, picture gate and content hashes in one loop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import new_path, saved
from ..sources import store

#: Endings of picture addresses.
PICTURES = ("jpg", "jpeg", "png", "webp")

#: What a crawl keeps of each level.
KEPT = {"seen": "url string", "visited": "number long, url string", "found": "number long, url string, name string, source string, hash string, page long"}


@dataclass
class Crawl:
    """Pages (number, url, level) in the order of their visits, and new pictures (number, url, name, source, hash)."""

    pages: DataFrame
    pictures: DataFrame


def host(url: Column) -> Column:
    return F.regexp_extract(url, "(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def polite(rows: DataFrame, robots: DataFrame | None) -> DataFrame:
    """Rows whose ``url`` the rules (rule_host, prefix, allow) let be fetched; a host without rules allows all."""
    if robots is None:
        return rows
    asked = rows.select("url").distinct().select(F.col("url").alias("_u"), host(F.col("url")).alias("host"), F.coalesce(F.nullif(path(F.col("url")), F.lit("")), F.lit("/")).alias("path"))
    return rows.join(store.allowed(asked, robots).where("not allowed").select(F.col("_u").alias("url")), "url", "left_anti")


def mentions(pages: DataFrame) -> DataFrame:
    """(url, source, number, kind, pos) of what pages (number, url, html) name: pictures (kind 0) before links (kind 1)."""

    def named(targets: Column, kind: int) -> Column:
        return F.transform(targets, lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), text.url_join(F.col("url"), h).alias("to")))

    found = named(text.images(F.col("html")), 0), named(text.hrefs(F.col("html")), 1)
    out = pages.select(F.col("url").alias("source"), "number", F.explode(F.concat(*found)).alias("m"))
    return out.select(F.col("m.to").alias("url"), "source", "number", "m.kind", "m.pos")


def crawl(seeds: DataFrame, pages: DataFrame, pictures: DataFrame, *, robots: DataFrame | None = None, known: DataFrame | None = None, max_pages: int | None = 10, max_pictures: int | None = 12, same_domain: bool = True, depth: int | None = None) -> Crawl:
    """Crawl from seeds (pos, url) over pages (url, html) and pictures (url, size, width, height, hash).

    A level's pages are visited in the order in which they were first named; forbidden and missing ones don't
    count.  An address counts where it is first named, as picture or as link.  Pictures must be large enough, and of
    those with equal hashes only the first is new, none that ``known`` (hash) has.  The crawl ends with the page that
    brings the last picture asked for.  None lifts a cap.  Null and empty addresses name nothing; of rows that share
    an address one is taken.

    A level is a bounded number of joins, whatever its size; what it adds is written to shared storage once.
    """
    spark, folder = seeds.sparkSession, new_path(seeds.sparkSession, "crawl")
    front = store.numbered(store.first_of(seeds.where("url <> ''"), ["url"], [F.col("pos")]), ["pos"], name="turn").select("turn", "url")
    domains = front.select(host(F.col("url")).alias("_host")).distinct()
    known = (spark.createDataFrame([], "hash string") if known is None else known).select("hash").distinct()
    fetched = pages.where("html is not null").select("url", "html")
    files = pictures.where(store.keepable(F.col("size"), F.col("width"), F.col("height"))).select("url", "hash")

    def keep(rows: DataFrame, what: str, level: int) -> DataFrame:
        """Levels are added to what is there; none is written again."""
        rows.write.parquet(f"{folder}/{what}/level={level}")
        return spark.read.schema(f"{KEPT[what]}, level int").parquet(f"{folder}/{what}")

    seen = keep(front.select("url"), "seen", -1)
    hashes, n_pages, n_found, level = known, 0, 0, 0
    while True:
        left = None if max_pages is None else max_pages - n_pages
        # only the level's own pages are compared with their copies, not the table's
        here = store.first_of(polite(front, robots).join(fetched, "url"), ["url"], [F.xxhash64("html"), F.col("html")])
        here = store.numbered(here, ["turn"], left, name="n")
        here = saved(here.select((F.col("n") + n_pages).alias("number"), "url", "html"))
        named = mentions(here)
        picture = (F.col("kind") == 0) & F.lower(path(F.col("url"))).rlike(rf"\.({'|'.join(PICTURES)})$")
        link = (F.col("kind") == 1) & F.col("url").rlike("^https?://")
        if same_domain:
            named = named.join(domains, host(F.col("url")) == F.col("_host"), "left")
            link &= F.col("_host").isNotNull()
        order = ["number", "kind", "pos"]
        fresh = store.first_of(named.where(picture | link), ["url"], [F.col(c) for c in order])
        fresh = saved(fresh.join(seen, "url", "left_anti").select("url", "source", *order))
        new = polite(fresh.where("kind = 0"), robots).join(files, "url")
        new = store.first_of(new, ["url"], [F.col("hash")]).join(hashes, "hash", "left_anti")
        new = store.first_of(new, ["hash"], [F.col(c) for c in order])
        new = store.numbered(new, order, None if max_pictures is None else max_pictures - n_found, name="n")
        found = keep(new.select((F.col("n") + n_found).alias("number"), "url", F.regexp_extract("url", "([^/]*)$", 1).alias("name"), "source", "hash", F.col("number").alias("page")), "found", level)
        own = found.where(F.col("level") == level).agg(F.count("*").alias("n"), F.max("page").alias("last")).first()
        full = max_pictures is not None and n_found + own["n"] >= max_pictures
        if full:
            here = here.where(F.col("number") <= own["last"]) if own["n"] else here.limit(0)
        visited = keep(here.select("number", "url"), "visited", level)
        n_pages, n_found, level = visited.count(), n_found + own["n"], level + 1
        if full or n_pages == max_pages or (depth is not None and level > depth):
            break
        front = store.numbered(fresh.where("kind = 1").select("url", *order), order, name="turn").select("turn", "url")
        if front.isEmpty():
            break
        seen, hashes = keep(fresh.select("url"), "seen", level - 1), known.unionByName(found.select("hash"))
    return Crawl(visited.select("number", "url", "level"), found.select("number", "url", "name", "source", "hash"))
