"""URL verdicts: host/path rules first, then a weighted vocabulary matched with an Aho-Corasick automaton.

A term counts where it stands between boundaries (the url's ends or anything but a letter or digit), at
most once a url.  One strict term rejects; soft terms reject once their distinct hits weigh enough
together.  Every soft term weighs less than the limit, so it takes several; words that honest urls hold as
well ("free", "track") weigh less than words that hardly do.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import local_schema, put_back, set_aside


class Term(NamedTuple):
    text: str
    strict: bool
    weight: int = 1


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
STRICT_TERMS = (
    "porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "milf", "camgirls", "escort", "escorts", "brothel", "bdsm",
    "casino", "casinos-online", "sportsbook", "viagra", "cialis", "levitra", "tramadol", "warez", "nulled", "cracked-apk",
    "spam-farm", "link-farm", "adult-x", "phishing-kit", "carding", "malware-download",
)
#: Soft terms by weight.
SOFT_TERMS = {
    2: (
        "adult", "nude", "nudes", "sexy", "erotic", "fetish", "webcam-girls", "hookup", "swingers", "bet", "bets", "betting", "poker", "slots",
        "jackpot", "roulette", "blackjack", "gambling", "pills", "pharmacy-online", "steroids", "replica", "replicas", "payday", "keygen", "serials",
        "torrent", "torrents", "magnet-links", "hacked", "spam", "clickbait", "popunder", "adserver", "ads", "doubleclick", "affiliate-id",
    ),
    1: (
        "free", "win", "winner", "cheap", "discount", "bonus", "loan", "loans", "credit", "track", "tracker", "tracking", "farm", "crack", "dating",
        "singles", "hot", "deal", "deals", "prize", "gift-card", "earn", "cash", "promo", "sponsored", "redirect", "popup", "clickhere", "unlimited",
    ),
}
SOFT_LIMIT = 3
VOCABULARY = tuple(Term(t, True) for t in STRICT_TERMS) + tuple(Term(t, False, w) for w, terms in SOFT_TERMS.items() for t in terms)


def automaton(terms: Sequence[Term]):
    """Aho-Corasick automaton of lower-case terms."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(t.text.lower(), i)
    if terms:
        out.make_automaton()
    return out


def hits(url: str, terms: Sequence[Term], auto) -> set[int]:
    """Places in ``terms`` of those that the url holds between boundaries."""
    low, found = url.lower(), set()
    if not terms:
        return found
    for end, i in auto.iter(low):
        start = end - len(terms[i].text) + 1
        if not (start and low[start - 1].isascii() and low[start - 1].isalnum()) and not (end + 1 < len(low) and low[end + 1].isascii() and low[end + 1].isalnum()):
            found.add(i)
    return found


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of an absolute url; empty strings for null or for no ``://``."""
    rest = F.regexp_extract(url, "^(?s)(.*?)://(.*)$", 2)
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: len(r.name)):  # the last that fits stands outermost
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, *, url_col: str = "url", rules: Sequence[Rule] = RULES, terms: Sequence[Term] = VOCABULARY, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Adds host, path, rule, verdict, strict_hits, soft_hits, soft_weight and the terms hit.

    Rules decide where one fits; else the vocabulary does.  A null or relative url has empty host and
    path, no rule, and is judged on its characters alone (a null: allowed).  A term weighs once a url,
    however often it stands there; long urls are read whole.  Input columns of those names are replaced.  Rows are judged one by one, so repeated rows get equal results and an empty table stays
    empty.
    """
    terms, limit = tuple(terms), soft_limit

    @F.pandas_udf("strict_hits int, soft_hits int, soft_weight int, terms array<string>")
    def match(urls: pd.Series) -> pd.DataFrame:
        auto, out = automaton(terms), []
        for u in urls:
            found = [terms[i] for i in sorted(hits(u, terms, auto))] if u else []
            soft = [t for t in found if not t.strict]
            out.append((len(found) - len(soft), len(soft), sum(t.weight for t in soft), [t.text for t in found]))
        return pd.DataFrame(out, columns=["strict_hits", "soft_hits", "soft_weight", "terms"])

    made = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight", "terms")
    host, path = host_path(F.col(url_col))
    pages, moved = set_aside(pages, "_hit", "_rule")
    rows = pages.select(*[F.col(c) for c in local_schema(pages, *made) if c != url_col], F.col(url_col), host.alias("host"), path.alias("path"), match(F.col(url_col)).alias("_hit"))
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    by_terms = F.when((F.col("_hit.strict_hits") > 0) | (F.col("_hit.soft_weight") >= limit), "block").otherwise("allow")
    out = rows.select(*[c for c in rows.columns if c not in ("_hit", "_rule")], F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", by_terms).alias("verdict"), "_hit.*")
    return put_back(out, moved)
