"""Vector algebra on array<double> columns; all of it stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products from left to right."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str) -> Column:
    """Scaled to length 1; a zero vector stays zero."""
    length = lambda u: F.coalesce(F.nullif(norm(u), F.lit(0.0)), F.lit(1.0))
    # the vector and its length are bound first, else each element would compute them again
    by = lambda u: F.get(F.transform(F.array(length(u)), lambda n: F.transform(u, lambda x: x / n)), F.lit(0))
    return F.get(F.transform(F.array(_c(v)), by), F.lit(0))


def scaled(v: Column | str, by: Column | float) -> Column:
    k = by if isinstance(by, Column) else F.lit(by)
    return F.transform(_c(v), lambda x: x * k)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def fuse(a: Column | str, b: Column | str) -> Column:
    """[a; b] / sqrt(2): a unit vector if both are."""
    return F.transform(F.concat(_c(a), _c(b)), lambda x: x / F.sqrt(F.lit(2.0)))


def lift(q: Column | str) -> Column:
    """A query in fused space."""
    return fuse(q, q)


def mode_score(img: Column | str, txt: Column | str, q: Column | str, mode: str) -> Column:
    """Cosine by image, by text, or fused; the fused score is their mean, so no fused vector is built."""
    scores = {"image": dot(img, q), "text": dot(txt, q), "fused": (dot(img, q) + dot(txt, q)) / 2}
    return scores[mode]


def combine(terms: list[tuple[float, Column]], *, strict: bool = False) -> Column:
    """Unit vector of a weighted sum; where the sum is shorter than 1e-9, null, or with ``strict`` an error."""
    total = reduce(add, [scaled(v, k) for k, v in terms])
    made = F.when(norm(total) >= 1e-9, unit(total))
    return made.when(norm(total) < 1e-9, F.raise_error(F.lit("the terms cancel out"))) if strict else made


def terms(expression: str) -> list[tuple[float, str]]:
    """(sign, name) of "a + b - c"; anything but + or - between names raises."""
    parts = expression.split()
    if len(parts) % 2 == 0 or not set(parts[1::2]) <= {"+", "-"}:
        raise ValueError(f"not names with + or - between them: {expression!r}")
    return [(-1.0 if sign == "-" else 1.0, name) for sign, name in zip(["+", *parts[1::2]], parts[::2], strict=True)]


def bits(v: Column | str, words: int = 2, width: int = 32) -> Column:
    """Signs packed into ``words`` longs of ``width`` bits."""
    part = lambda i: F.aggregate(F.slice(_c(v), i * width + 1, width), F.lit(0).cast("long"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0))
    return F.array(*[part(i) for i in range(words)])


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def project(v: Column | str, mean: Column, component: Column) -> Column:
    return dot(subtract(v, mean), component)
