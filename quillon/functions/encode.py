"""Pluggable text encoders: a deterministic stub, a registry, and encoding of distinct texts only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Model(NamedTuple):
    name: str
    dim: int | None
    kind: str
    padding: str | bool = True
    max_length: int | None = None


#: Known encoders by key, with the length of their vectors, how scores become probabilities, and padding.
MODELS = {
    "stub-64": Model("stub-64", 64, "stub"),
    "stub-512": Model("stub-512", 512, "stub"),
    "clip-b32": Model("openai/clip-vit-base-patch32", 512, "clip"),
    "clip-l14": Model("openai/clip-vit-large-patch14", 768, "clip"),
    "siglip2-base": Model("google/siglip2-base-patch16-224", 768, "siglip", "max_length", 64),
    "siglip2-384": Model("google/siglip2-base-patch16-384", 768, "siglip", "max_length", 64),
}


def resolve(name: str) -> Model:
    """A known encoder by its key or its full name; any other is taken as one of the clip kind, its length unknown."""
    by_name = {m.name: m for m in MODELS.values()}
    return MODELS.get(name) or by_name.get(name) or Model(name, None, "clip")


def stub(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """An encoder without a model: each word adds a fixed direction drawn from its hash; unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                v += np.random.default_rng(zlib.crc32(w.encode())).standard_normal(dim)
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def encode_texts(rows: DataFrame, column: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], name: str = "text_emb") -> DataFrame:
    """Adds vectors of a text column; each distinct text is encoded once, the encoder made once a worker."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for p in parts:
            yield pd.Series(embed(p.tolist()))

    once = rows.select(F.col(column).alias("_text")).where("_text is not null").distinct()
    return rows.join(once.withColumn(name, run("_text")), F.col(column) == F.col("_text"), "left").drop("_text")
