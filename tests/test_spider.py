"""The crawl against a queue of single pages."""

import random
from urllib.parse import urljoin, urlparse

import pytest

from quillon.operators import spider


def world(seed):
    rng = random.Random(seed)
    urls = [f"http://{h}/p{i}" for i in range(14) for h in ("a.org", "b.org")]
    pics = [f"http://a.org/i{i}.{rng.choice(['jpg', 'png', 'gif'])}" for i in range(25)]
    pages = {}
    for u in urls[:-4]:
        tags = [rng.choice([f'<a href="{urlparse(x).path}">', f"<a href='{x}'>", f"<A HREF={x}>"]) for x in rng.choices(urls + pics[:3], k=4)]
        tags += [f'<img src="{x}">' for x in rng.choices(pics, k=2)] + ['<a href="mailto:x@a.org">', '<img src="">']
        rng.shuffle(tags)
        pages[u] = "\n".join(tags)
    files = {p: (rng.choice([19_999, 20_000, 50_000]), rng.choice([100, 200, 400]), 300, f"h{rng.randrange(12)}") for p in pics[:-3]}
    rules = [("a.org", "/p1", False), ("a.org", "/p12", True), ("a.org", "/i2", False), ("b.org", "/p3", False)]
    return urls[:2], pages, files, rules


def expected(seeds, pages, files, rules, known, max_pages, max_pictures, same_domain):
    def can(u):
        fit = [(len(p), ok) for h, p, ok in rules if urlparse(u).netloc == h and urlparse(u).path.startswith(p)]
        return max(fit)[1] if fit else True

    queue, seen, hashes, visited, new = list(seeds), set(seeds), set(known), [], []
    hosts = {urlparse(s).netloc for s in seeds}
    while queue and len(visited) < max_pages and len(new) < max_pictures:
        u = queue.pop(0)
        if not can(u) or u not in pages:
            continue
        visited.append(u)
        # tags stand one a line here; values are bare, or in one kind of quotes
        value = lambda t: t.split("=", 1)[1][:-1].strip("\"'")
        tags = pages[u].split("\n")
        for x in [urljoin(u, value(t)) for t in tags if t.startswith("<img") and value(t)]:
            if len(new) >= max_pictures:
                break
            if not x.endswith((".jpg", ".jpeg", ".png", ".webp")) or x in seen:
                continue
            seen.add(x)
            size, w, h, digest = files.get(x, (0, 0, 0, None))
            if can(x) and size >= 20_000 and min(w, h) >= 160 and digest not in hashes:
                hashes.add(digest)
                new.append((x, u, digest))
        for x in [urljoin(u, value(t)) for t in tags if t.lower().startswith("<a")]:
            if x.startswith("http") and x not in seen and (not same_domain or urlparse(x).netloc in hosts):
                seen.add(x)
                queue.append(x)
    return visited, new


@pytest.mark.parametrize(("seed", "caps", "same"), [(1, (100, 100), True), (2, (6, 100), False), (3, (100, 3), False), (4, (5, 2), True)])
def test_crawl(spark, seed, caps, same):
    seeds, pages, files, rules = world(seed)
    seeds = seeds[:1] if same else seeds
    given = spark.createDataFrame(list(enumerate(seeds)), "pos long, url string")
    fetched = spark.createDataFrame([*pages.items(), (None, "x"), ("http://a.org/p0x", None)], "url string, html string")
    pictures = spark.createDataFrame([(u, *v) for u, v in files.items()], "url string, size long, width int, height int, hash string")
    robots, known = spark.createDataFrame(rules, "rule_host string, prefix string, allow boolean"), spark.createDataFrame([("h1",)], "hash string")
    out = spider.crawl(given, fetched, pictures, robots=robots, known=known, max_pages=caps[0], max_pictures=caps[1], same_domain=same)
    visited, new = expected(seeds, pages, files, rules, ["h1"], *caps, same)
    assert [r["url"] for r in out.pages.orderBy("number").collect()] == visited
    assert [(r["url"], r["source"], r["hash"]) for r in out.pictures.orderBy("number").collect()] == new
    assert visited


def test_nothing_to_crawl(spark):
    none = spark.createDataFrame([], "pos long, url string")
    out = spider.crawl(none, spark.createDataFrame([], "url string, html string"), spark.createDataFrame([], "url string, size long, width int, height int, hash string"))
    assert out.pages.count() == out.pictures.count() == 0
