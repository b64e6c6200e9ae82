"""Embeddings: a pluggable embedder over Arrow batches, an offline one of hashed words, likeness, metadata beside vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .retrieval import _bucket

#: put before texts that are stored, and before those that ask
PASSAGE, QUERY = "passage: ", "query: "
Embedder = Callable[[list[str]], list[tuple[int, list[float]]]]


def hashed(text: Column | str, dims: int = 64) -> Column:
    """The offline vector of a text: its tokens hashed to ``dims`` buckets, counted, of length 1; all 0 without tokens."""

    def run(buckets: pd.Series) -> pd.Series:
        out = []
        for b in buckets:
            v = np.bincount(b, minlength=dims).astype(np.float64) if b is not None and len(b) else np.zeros(dims)
            size = np.linalg.norm(v)
            out.append(v / size if size else v)
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(F.transform(tokens(text), lambda t: _bucket(t, dims)))


def embedded(df: DataFrame, text: str, embedder: Embedder | None = None, prefix: str = PASSAGE, batch: int = 2048, dims: int = 64) -> DataFrame:
    """``df`` with ``vector``, of length 1. ``embedder`` takes up to ``batch`` texts, each after ``prefix``, and returns
    (place, vector) in any order; without one words are hashed. Null texts are read as empty; a zero vector stays.
    """
    if embedder is None:
        return df.withColumn("vector", hashed(text, dims))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = []
            for a in range(0, len(texts), batch):
                got = sorted(embedder([prefix + (t or "") for t in texts[a : a + batch]]), key=lambda x: x[0])
                for _, v in got:
                    v = np.asarray(v, dtype=np.float64)
                    size = np.linalg.norm(v)
                    out.append(v / size if size else v)
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("vector", F.pandas_udf(run, "array<double>")(F.coalesce(F.col(text), F.lit(""))))


def likeness(a: Column | str, b: Column | str) -> Column:
    """The product of two vectors of length 1, clipped to [0, 1]; 0 if one is null."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, z: s + z)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dot, F.lit(0.0))))


def clean_metadata(df: DataFrame, kinds: dict[str, tuple[str, object]]) -> DataFrame:
    """The named columns cast to what may stand beside a vector, with a default for null and for what cannot be cast; others stay."""
    def of(c: str) -> Column:
        if c not in kinds:
            return F.col(c)
        kind, default = kinds[c]
        return F.coalesce(F.col(c).cast("string").try_cast(kind), F.lit(default).cast(kind)).alias(c)

    return df.select(*map(of, df.columns))
