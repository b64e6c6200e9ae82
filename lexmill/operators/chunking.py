"""Chunking: one document to many rows, without a shuffle.

Splits keep the text: pieces of a recursive split, put together, give the text again (overlaps
aside). Empty documents give no rows; chunk numbers are dense.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, squash, strip, token_length

# Separators in the order in which they are tried.
SEPARATORS = (r"\n\n+", r"(?=\n\s*\d+\.\s+)", r"\n", r";\s+", r"\s+")
INNER_SEPARATORS = (r"\n\n+", r"\n", r";\s+", r"\s+")
#: tokens from which a paragraph is split again, and the overlap then
LONG_PARAGRAPH, LONG_OVERLAP = 4000, 200


def count_tokens(text: str) -> int:
    return len(text.split())


def pieces_of(text: str, separator: str) -> list[str]:
    """The text cut after each match of ``separator`` (before it, if the match is empty)."""
    cuts = sorted({m.end() for m in re.finditer(separator, text)} - {0, len(text)})
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` tokens; a piece without any separator may be longer.

    The first separator that occurs cuts the text; pieces that are too long are cut by the next
    ones; neighbours are put together while they fit, a chunk beginning with the last pieces of the
    one before up to ``overlap`` tokens.
    """
    at = next((i for i, s in enumerate(separators) if len(pieces_of(text, s)) > 1), None)
    if at is None or count_tokens(text) <= size:
        return [text] if text.strip() else []
    out: list[str] = []
    held: list[tuple[str, int]] = []
    total = 0

    def flush() -> None:
        if held and "".join(p for p, _ in held).strip():
            out.append("".join(p for p, _ in held).strip())

    for piece in pieces_of(text, separators[at]):
        n = count_tokens(piece)
        if n > size:
            flush()
            held, total = [], 0
            out += split_recursive(piece, size, overlap, separators[at + 1 :])
            continue
        if total + n > size:
            flush()
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[1]
        held.append((piece, n))
        total += n
    flush()
    return out


def recursive(x: Column | str, size: int, overlap: int) -> Column:
    """Array of chunks of a text."""
    return F.pandas_udf(lambda s: s.map(lambda t: split_recursive(t or "", size, overlap)), "array<string>")(x)


def without_label(x: Column | str) -> Column:
    """Without the heading of the reasoning at the start."""
    return F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), rf"^(?iu)[oó]d[oôó]vodnenie{WS}*:?{WS}*", "")


def points(x: Column | str) -> Column:
    """Numbered points with the text before the first one; without points, blocks between blank lines that are more than noise."""
    t = F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    cut = F.filter(F.transform(F.split(t, rf"(?m)(?=^{WS}*\d+\.{WS}+)"), strip), lambda p: p != "")
    numbered = t.rlike(rf"(?m)^{WS}*\d+\.{WS}+")
    blocks = F.filter(F.transform(F.split(t, r"\n\n+"), strip), lambda p: (p != "") & ~((token_length(p) <= 1) & (F.char_length(p) <= 2)))
    return F.when(numbered, cut).otherwise(blocks)


def resplit(parts: Column) -> Column:
    """Points with those of more than ``LONG_PARAGRAPH`` tokens cut again; the others do not leave the JVM's plan as text changes."""
    long = F.exists(parts, lambda p: token_length(p) > LONG_PARAGRAPH)

    def again(s: pd.Series) -> pd.Series:
        cut = lambda p: split_recursive(p, LONG_PARAGRAPH, LONG_OVERLAP, INNER_SEPARATORS) if count_tokens(p) > LONG_PARAGRAPH else [p]
        return s.map(lambda ps: None if ps is None else [c for p in ps for c in cut(p)])

    return F.coalesce(F.pandas_udf(again, "array<string>")(F.when(long, parts)), parts)


def rows(df: DataFrame, parts: Column, strategy: str, keep: list[str]) -> DataFrame:
    """Chunk rows: (keep..., chunk_index, page_content, strategy, char_len, token_len), empty chunks left out before numbering."""
    clean = F.filter(F.transform(parts, strip), lambda p: p != "")
    out = df.select(*keep, F.posexplode(clean).alias("chunk_index", "page_content"))
    return out.select(*keep, "chunk_index", "page_content", F.lit(strategy).alias("strategy"), F.char_length("page_content").alias("char_len"), token_length("page_content").alias("token_len"))


def paragraphs(df: DataFrame, text: str, keep: list[str], resplit_long: bool = True) -> DataFrame:
    """Flat chunks by numbered points."""
    has = df.where(strip(text) != "")
    parts = points(without_label(text))
    return rows(has, resplit(parts) if resplit_long else parts, "paragraph", keep)


def parents(df: DataFrame, text: str, key: str) -> DataFrame:
    """Parent chunks: ids, point number (-1 if none), relative position, lengths."""
    has = df.where(strip(text) != "").withColumn("_parts", points(without_label(text)))
    out = has.select(F.col(key).alias("source_file"), F.size("_parts").alias("n"), F.posexplode("_parts").alias("parent_index", "page_content"))
    return out.select(
        "source_file", F.format_string("%s_parent_%03d", F.regexp_replace("source_file", r"\.\w+$", ""), "parent_index").alias("parent_id"), "parent_index",
        F.coalesce(F.regexp_extract("page_content", rf"^{WS}*(\d+)\.", 1).try_cast("int"), F.lit(-1)).alias("point_number"),
        F.bround((F.col("parent_index") + 0.5) / F.col("n"), 4).alias("position_ratio"), F.char_length("page_content").alias("char_len"), token_length("page_content").alias("token_len"), "page_content",
    )


def children(parents: DataFrame, whole: int = 280, size: int = 220, overlap: int = 60) -> DataFrame:
    """Child chunks: parents of at most ``whole`` tokens stay whole, others are split."""
    parts = F.when(F.col("token_len") <= whole, F.array("page_content")).otherwise(recursive("page_content", size, overlap))
    out = parents.withColumn("_parts", parts).select("source_file", "parent_id", "parent_index", F.size("_parts").alias("child_count_in_parent"), F.posexplode("_parts").alias("child_index", "page_content"))
    return out.select("source_file", "parent_id", "parent_index", F.format_string("%s_child_%02d", "parent_id", "child_index").alias("child_id"), "child_index", "child_count_in_parent", F.char_length("page_content").alias("char_len"), token_length("page_content").alias("token_len"), "page_content")


def report(chunks: DataFrame) -> DataFrame:
    """Chunks in all and per document, by strategy."""
    return chunks.groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.countDistinct("filename").alias("n_docs")).withColumn("per_doc", F.bround(F.col("n_chunks") / F.col("n_docs"), 6))


def block_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks between empty lines per text: how many, the longest and the 95th percentile of their lengths."""
    sizes = df.select(F.col(key), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), rf"\n{WS}*\n")).alias("b")).select(key, F.char_length(squash("b")).alias("n")).where("n > 0")
    return sizes.groupBy(key).agg(F.count("*").alias("n_blocks"), F.max("n").alias("longest"), F.bround(F.percentile("n", 0.95), 6).alias("p95"))
