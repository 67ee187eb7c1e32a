"""Text functions: templates, token normalisation, keyword scores, extraction from pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Templates and the tag vocabulary.
TAG_TEMPLATE, CAPTION_TEMPLATE, NEUTRAL = "a photo of a {tag}", "a photo of {tags}", "a photo"
TEMPLATE_POOL = (TAG_TEMPLATE, "a close-up photo of a {tag}", "a photograph of a {tag}", "an image showing a {tag}")
VOCABULARY = (
    "cat dog bear parrot bird horse fish insect animal pet wildlife waterfall mountain forest beach lake river sky sunset snow flower "
    "sunflower tree garden landscape city street tower castle palace church bridge building landmark architecture house car bicycle train "
    "airplane boat vehicle pizza apple strawberry fruit food drink dessert person portrait crowd planet moon stars space painting toy book computer"
).split()


def fill(template: str | Column, hole: str, value: Column) -> Column:
    t = F.lit(template) if isinstance(template, str) else template
    return F.replace(t, F.lit("{" + hole + "}"), value)


def caption(tags: Column, template: str = CAPTION_TEMPLATE) -> Column:
    return fill(template, "tags", F.array_join(tags, ", "))


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def norm(word: Column) -> Column:
    """Lower case, without punctuation (but . % -), and without a plural s on words of over three characters."""
    w = F.regexp_replace(F.lower(word), r"(?U)[^\w.%-]", "")
    return F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def numbers(text: Column) -> Column:
    """Numbers that a text claims, as fractions: n% over 100, and .nn or 0.nn."""
    pct = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1)), lambda x: x.cast("double") / 100)
    dec = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\d%])(0?\.\d+)(?![\d%])"), F.lit(1)), lambda x: x.cast("double"))
    return F.concat(pct, dec)


def keyword_score(query_words: Column, tags: Column, caption_: Column) -> Column:
    """Query words that some tag or the caption contains."""
    return F.size(F.filter(query_words, lambda w: F.exists(tags, lambda t: F.contains(t, w)) | F.contains(caption_, w)))


def overlap_live(query_words: Column, tags: Column) -> Column:
    """Tags that contain a query word or are contained in one."""
    return F.size(F.filter(tags, lambda t: F.exists(query_words, lambda w: F.contains(t, w) | F.contains(w, t))))


def and_join(xs: Column) -> Column:
    """"a, b and c"."""
    n = F.size(xs)
    return F.when(n == 0, "").when(n == 1, F.get(xs, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(xs, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(xs, -1)))


def attributes(html: Column, tag: str, name: str) -> Column:
    """Values of an attribute of every such tag, in order: in double quotes, single quotes or none, in any case."""
    head = rf"(?is)<{tag}(?:\s[^>]*?)?\s{name}\s*=\s*"
    found = F.regexp_extract_all(html, F.lit(head + r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(0))
    value = F.transform(found, lambda m: F.regexp_replace(m, "^" + head, ""))
    bare = F.transform(value, lambda v: F.when(v.rlike("^[\"']"), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v))
    return F.filter(bare, lambda v: v != "")


def hrefs(html: Column) -> Column:
    """Targets of links, in order."""
    return attributes(html, "a", "href")


def images(html: Column) -> Column:
    """Addresses of pictures, in order."""
    return attributes(html, "img", "src")


def _flat(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; those above the root drop out."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).when(p == ".", out).otherwise(F.concat(out, F.array(p))))
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    joined = F.concat(F.array_join(kept, "/"), folder)
    return F.when(joined == "", "/").otherwise(joined)


def url_join(base: Column, href: Column) -> Column:
    """Absolute form of a link on a page, by RFC 3986, without its fragment; dot segments are resolved.

    ``//host`` takes the page's scheme, ``?x`` its path, an empty link the page itself; what has a scheme stays.
    """
    h, page = F.regexp_replace(F.trim(href), "#.*$", ""), F.regexp_replace(base, "#.*$", "")
    scheme, root = F.regexp_extract(page, "(?i)^([a-z][a-z0-9+.-]*:)", 1), F.regexp_extract(page, "(?i)^([a-z][a-z0-9+.-]*://[^/?]*)", 1)
    own = F.regexp_extract(page, "(?i)^[a-z][a-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path, query = F.regexp_extract(h, "^([^?]*)", 1), F.regexp_extract(h, r"^[^?]*(\?.*)?$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(own, "^(.*/)", 1), F.lit("")), F.lit("/"))
    absolute = F.when(path.startswith("/"), _flat(path)).otherwise(_flat(F.concat(folder, path)))
    return F.when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h == "", page).when(path == "", F.concat(root, own, query)).otherwise(F.concat(root, absolute, query))


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text, each malformed stretch as U+FFFD."""

    @F.pandas_udf("string")
    def decode(xs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else bytes(x).decode("utf-8", "replace") for x in xs], dtype=object)

    return decode(content)


def describe_error(kind: Column, message: Column, seconds: int = 8) -> Column:
    """Plain words for a failed fetch."""
    slow = kind.isin("TimeoutError", "AbortError") | message.rlike("(?i)abort|timed? ?out")
    away = (kind == "TypeError") | message.rlike("(?i)load failed|failed to fetch|network")
    return F.when(slow, f"no answer in {seconds}s").when(away, "unreachable — blocked or offline").otherwise(message)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")
