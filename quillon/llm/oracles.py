"""DuckDB SQL for the queries that SQL can express; the others have brute-force tests."""

from __future__ import annotations

from .quality_rules import EXACT_BITS, FENCE, LEAST_ROWS, LEAST_WORDS, MOST_REPEATED, RULES, WINDOW
from .url_filters import RULES as URL_RULES
from .url_filters import SOFT_LIMIT, VOCABULARY
from .warc import LEAST_PAYLOAD


def _hits(strict: bool, weigh: bool = False) -> str:
    return " + ".join(f"(CASE WHEN regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9]){t.text}([^a-z0-9]|$)') THEN {t.weight if weigh else 1} ELSE 0 END)" for t in VOCABULARY if t.strict is strict)


def url_filters() -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r.name))
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ordered}
    case = lambda pick, other: "CASE " + " ".join(f"WHEN {fits[r]} THEN '{pick(r)}'" for r in ordered) + f" {other} END"
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, CAST({_hits(True)} AS INTEGER) AS strict_hits, CAST({_hits(False)} AS INTEGER) AS soft_hits,
    CAST({_hits(False, True)} AS INTEGER) AS soft_weight FROM cut)
SELECT page_id, host, path, {case(lambda r: r.name, "ELSE NULL")} AS rule,
    {case(lambda r: r.verdict, f"WHEN strict_hits > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow'")} AS verdict, strict_hits, soft_hits, soft_weight
FROM parts"""


def warc() -> str:
    return f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_PAYLOAD} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m"""


def quality_rules() -> str:
    shift, edge = f"greatest(length(bin(v)) - {EXACT_BITS}, 0)", "greatest(b // 32 - 1, 0)"
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {d} AS least, {str(s == 'both').lower()} AS both_sides, CAST({e.replace(' div ', ' // ')} AS BIGINT) AS v FROM base WHERE NOT base_failed" for m, (e, d, s) in RULES.items())
    limits = ", ".join(f"max(lower) FILTER (measure = '{m}') AS {m}_lower, max(upper) FILTER (measure = '{m}') AS {m}_upper" for m in RULES)
    within = " AND ".join(f"{e.replace(' div n_words', ' // greatest(n_words, 1)')} BETWEEN {m}_lower AND {m}_upper" for m, (e, _, _) in RULES.items())
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents),
grams AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY doc_id),
measured AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
base AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM measured),
vals AS ({values}),
bins AS (SELECT lang, source, measure, least, both_sides, {shift} * 32 + (v >> {shift}) AS b FROM vals),
levels AS (SELECT 2 AS level, lang, source, measure, least, both_sides, b FROM bins UNION ALL SELECT 1, lang, NULL, measure, least, both_sides, b FROM bins UNION ALL SELECT 0, NULL, NULL, measure, least, both_sides, b FROM bins),
hist AS (SELECT level, lang, source, measure, least, both_sides, b, count(*) AS n FROM levels GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM hist),
quart AS (SELECT level, lang, source, measure, least, both_sides, max(total) AS n_rows, min(b) FILTER (4 * upto >= total) AS b1, min(b) FILTER (4 * upto >= 3 * total) AS b3 FROM run GROUP BY ALL),
q AS (SELECT level, lang, source, measure, least, both_sides, n_rows, (b1 - 32 * {edge.replace("b //", "b1 //")}) << {edge.replace("b //", "b1 //")} AS q1, (b3 - 32 * {edge.replace("b //", "b3 //")}) << {edge.replace("b //", "b3 //")} AS q3 FROM quart),
fence AS (SELECT *, q3 + {FENCE} * greatest(q3 - q1, least) AS upper, CASE WHEN both_sides THEN q1 - {FENCE} * greatest(q3 - q1, least) ELSE 0 END AS lower FROM q),
chosen AS (SELECT o.lang, o.source, o.measure,
    CASE WHEN o.n_rows >= {LEAST_ROWS} THEN o.lower WHEN l.n_rows >= {LEAST_ROWS} THEN l.lower ELSE a.lower END AS lower,
    CASE WHEN o.n_rows >= {LEAST_ROWS} THEN o.upper WHEN l.n_rows >= {LEAST_ROWS} THEN l.upper ELSE a.upper END AS upper
    FROM fence o JOIN fence l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure JOIN fence a ON a.level = 0 AND a.measure = o.measure WHERE o.level = 2),
lim AS (SELECT lang, source, {limits} FROM chosen GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({within}, false) AS kept
FROM base LEFT JOIN lim ON base.lang IS NOT DISTINCT FROM lim.lang AND base.source IS NOT DISTINCT FROM lim.source"""


ORACLES = {"op2_url_filters": url_filters(), "op4_warc": warc(), "op8_quality_rules": quality_rules()}
