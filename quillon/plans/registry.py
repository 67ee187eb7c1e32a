"""Registration of queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The shared views, as DuckDB common table expressions.
GALLERY = """gallery AS (SELECT vec_id AS id, 'img_' || lpad(CAST(vec_id AS VARCHAR), 5, '0') AS path, label, CAST(embedding AS DOUBLE[]) AS img,
    list_concat(CAST(embedding AS DOUBLE[])[33:64], CAST(embedding AS DOUBLE[])[1:32]) AS txt, ['c' || CAST(label AS VARCHAR), 'm' || CAST(vec_id % 7 AS VARCHAR)] AS tags FROM embeddings)"""
PAIRS = f"""{GALLERY}, q AS (SELECT id AS qid, img AS qv, tags AS qtags FROM gallery WHERE id % 20 = 0),
pairs AS (SELECT qid, qv, qtags, gallery.*, list_dot_product(img, qv) AS cos_image, list_dot_product(txt, qv) AS cos_text FROM q, gallery)"""
#: Leave-one-out pairs over all items.
LOO = f"""{GALLERY}, loo AS (SELECT a.id AS qid, b.id AS id, list_dot_product(a.img, b.img) AS cos, list_has_any(a.tags, b.tags) AS rel FROM gallery a JOIN gallery b ON a.id <> b.id)"""


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_HEAD = r"<a(?:\s[^>]*?)?\shref\s*=\s*"
#: Targets of a page's links, in any quotes and case, as a DuckDB list of ``html``.
LINKS_SQL = rf"""list_filter(list_transform(list_transform(regexp_extract_all(html, '(?is){_HEAD}(?:"[^"]*"|''[^'']*''|[^\s"''>]+)', 0), lambda m: regexp_replace(m, '(?is)^{_HEAD}', '')),
    lambda v: CASE WHEN v[1] IN ('"', '''') THEN substr(v, 2, length(v) - 2) ELSE v END), lambda v: v <> '')"""
