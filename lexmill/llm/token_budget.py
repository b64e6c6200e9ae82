"""Tokens per source, language and domain, kept up to date.

State is a table of counts by content hash and tokenizer hash, and a table of the documents with
their content hash and slices. An update encodes only contents that the count table lacks, takes the
difference of the document tables as signed deltas (a changed document leaves its old slice and
enters the new one, a removed one only leaves) and adds the deltas to the cube.

Texts are hashed and encoded where they are read; only hashes and counts are shuffled. A text
delivered twice within an Arrow batch is encoded once, and one in two batches gives the same count.

Edge cases: null or empty texts have no tokens but count as documents; null keys are slices of
their own; a document delivered again is taken in its latest form; languages are reduced to the
lower-case code before a hyphen; very long texts are encoded in pieces cut between a letter and a blank that a letter
follows, where the tokenizer's pattern always cuts, and whole where there is no such place.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpointed

#: where the vocabulary files of public tokenizers are
TOKENIZERS = os.environ.get("LEXMILL_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
_LONG = 200_000
COUNTS = "content string, tokenizer string, n_tokens long"


def pattern_of(path: str) -> str:
    """The splitting pattern that belongs to a rank file, from the module beside it."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("_public_tokenizers", os.path.join(os.path.dirname(path), "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def _encoding(ranks: bytes, pattern: str) -> object:
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=4)
def encoder(path: str) -> object:
    """The encoder of a rank file."""
    with open(path, "rb") as f:
        return _encoding(f.read(), pattern_of(path))


class Shipped:
    """A tokenizer as it goes to the workers: about a megabyte, broadcast, so that only the driver needs the folder. Made once per worker."""

    _made: dict[str, object] = {}

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = f.read()
        self.name, self.pattern = tokenizer_hash(path), pattern_of(path)
        self.share = SparkSession.getActiveSession().sparkContext.broadcast(ranks)

    def count(self, text: str | None) -> int:
        if self.name not in self._made:
            self._made[self.name] = _encoding(self.share.value, self.pattern)
        return counted(text, self._made[self.name])


def tokenizer_hash(path: str) -> str:
    """Names a tokenizer by the content of its file."""
    with open(path, "rb") as f:
        return hashlib.md5(f.read()).hexdigest()


def n_tokens(text: str | None, path: str) -> int:
    """The number of tokens of a whole text."""
    return counted(text, encoder(path)) if text else 0


def counted(text: str | None, enc: object) -> int:
    """The number of tokens of a whole text under an encoder."""
    if not text:
        return 0
    if len(text) < _LONG:
        return len(enc.encode_ordinary(text))
    cuts = [0, *[m.end() - 1 for m in re.finditer(r"[^\W\d_] (?=[^\W\d_])", text)], len(text)]
    total, at = 0, 0
    for c in cuts[1:]:
        if c - at >= _LONG or c == len(text):
            total += len(enc.encode_ordinary(text[at:c]))
            at = c
    return total


def token_count(text: F.Column | str, path: str | None = None) -> F.Column:
    """Tokens of a text column, null and empty texts have none."""
    path = path or f"{TOKENIZERS}/{TOKENIZER}"
    own = Shipped(path)
    return F.pandas_udf(lambda s: s.map(own.count).astype("int64"), "long")(text)


def content_hash(text: F.Column | str) -> F.Column:
    return F.md5(F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8"))


def language(lang: F.Column | str) -> F.Column:
    """``sk`` for ``sk``, ``SK`` and ``sk-SK``; null stays null."""
    return F.nullif(F.lower(F.substring_index(F.trim(F.col(lang) if isinstance(lang, str) else lang), "-", 1)), F.lit(""))


def units(kind: str, df: DataFrame, key: str, text: str, at: str, source: str, lang: str, domain: str) -> DataFrame:
    """(kind, key, content, source, lang, domain, text, at) of a table's documents as delivered."""
    return df.select(
        F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), content_hash(text).alias("content"), F.col(source).alias("source"),
        language(lang).alias("lang"), F.col(domain).alias("domain"), F.col(text).alias("text"), F.col(at).alias("at"),
    )


def documents(rows: DataFrame) -> DataFrame:
    """The document table: each document once, in its latest form. No text is shuffled. Rows without a key stand for themselves by content."""
    of = [F.col(c) for c in ("at", "content", "source", "lang", "domain")]
    key = F.coalesce("key", F.concat(F.lit("\u0000"), F.col("content")))
    return rows.groupBy("kind", key.alias("key")).agg(F.max(F.struct(*of)).alias("d")).select("kind", "key", "d.content", "d.source", "d.lang", "d.domain")


def new_counts(rows: DataFrame, known: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """(content, tokenizer, n_tokens) of contents that ``known`` lacks for this tokenizer."""
    path = path or f"{TOKENIZERS}/{TOKENIZER}"
    own = Shipped(path)
    name = own.name
    fresh = rows.select("content", "text")
    if known is not None:
        fresh = fresh.join(known.where(F.col("tokenizer") == name).select("content"), "content", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            once = b.drop_duplicates("content")
            yield pd.DataFrame({"content": once["content"], "tokenizer": name, "n_tokens": [own.count(t) for t in once["text"]]})

    return fresh.mapInPandas(run, COUNTS).groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


SLICE = ["kind", "source", "lang", "domain"]


def deltas(old: DataFrame | None, new: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, source, lang, domain, n_docs, n_tokens): signed changes of each slice between two document tables."""
    plus = new.withColumn("sign", F.lit(1))
    if old is not None:
        key = ["kind", "key", "content", *SLICE[1:]]
        minus = old.withColumn("sign", F.lit(-1))
        plus = plus.select(*key, "sign").unionByName(minus.select(*key, "sign")).groupBy(*key).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    sized = plus.join(counts.select("content", "n_tokens"), "content", "left")
    return sized.groupBy(*SLICE).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))


def updated(base: DataFrame | None, change: DataFrame) -> DataFrame:
    """The finest level of the cube after adding deltas; empty slices go."""
    both = change if base is None else base.select(*SLICE, "n_docs", "n_tokens").unionByName(change)
    return both.groupBy(*SLICE).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")


class State:
    """What is kept between updates: counts by content and tokenizer, the documents with their slices, the finest level of the cube."""

    def __init__(self, counts: DataFrame | None = None, docs: DataFrame | None = None, base: DataFrame | None = None) -> None:
        self.counts, self.docs, self.base = counts, docs, base

    def update(self, rows: DataFrame, path: str | None = None) -> tuple[State, DataFrame]:
        """(the state after all of ``rows``, the signed deltas). ``rows``: all units as they are now; documents that are no longer among them leave their slices.

        Only contents without a count are encoded. Each part is cut from its lineage, as it would be by writing it down.
        """
        docs = checkpointed(documents(rows))
        fresh = new_counts(rows, self.counts, path)
        counts = checkpointed(fresh if self.counts is None else self.counts.unionByName(fresh))
        change = checkpointed(deltas(self.docs, docs, counts))
        return State(counts, docs, updated(self.base, change)), change


def cube(base: DataFrame) -> DataFrame:
    """Totals by every combination of source, language and domain. ``level`` is the grouping id: a bit set for each key summed over."""
    out = base.cube("kind", "source", "lang", "domain").agg(F.grouping_id().cast("int").alias("level"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return out.where("level < 8")
