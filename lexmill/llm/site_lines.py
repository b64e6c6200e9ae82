"""Lines repeated across the documents of one source.

Pass 1 builds mergeable heavy-hitter summaries (Misra-Gries) per source inside each Arrow batch and
adds them up per source. A batch keeps its counters after subtracting the (k+1)-th largest count,
with k = ceil(batch lines / (err_share * batch documents)), so its counts are too small by at most
``err_share`` times its documents. Added up, a line of at least ``share`` of a source's documents
keeps a count above 0 while err_share * rows < share * documents; sources for which that sum does
not hold (heavy redelivery) skip the summary and are counted exactly.
Pass 2 counts documents per candidate line exactly; confirmed lines are joined back (broadcast if
their counted number is small) to remove them.

Summaries hold hashes of lines, not lines, so that sources of which a batch has one or two documents, where
nothing can be left out, cost 8 bytes a line; pass 2 tells lines with one hash apart. The shuffle holds only counters and
candidate lines. A source with a third of all rows is reduced
in every task before it is shuffled, and the exact count is spread by (source, line, document).

Edge cases: null source, null or empty text give no cases; lines without letters and digits and
labelled lines never count; a document delivered again counts once; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed, small_side

#: fixed values: labels of the decision's own lines
LABELS = ("Súd:", "Spisová značka:", "Identifikačné číslo súdneho spisu:", "Dátum vydania rozhodnutia:", "Meno a priezvisko sudcu, VSÚ:", "ECLI:")


def normal_line(line: F.Column) -> F.Column:
    """Lower case, one blank for any white space, no outer characters that are neither letters nor digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), r"(?U)\s+", " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def exploded_lines(df: DataFrame, source: str, doc: str, text: str, labels: tuple[str, ...]) -> DataFrame:
    """(source, doc, line_no, norm) of the lines that may be cases."""
    lines = df.where(F.col(source).isNotNull() & F.col(text).isNotNull()).select(
        F.col(source).alias("source"), F.col(doc).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")
    )
    return lines.where(~_any_prefix(F.col("line"), labels)).select("source", "doc", "line_no", normal_line(F.col("line")).alias("norm")).where("norm <> ''")


def _summaries(err_share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            docs: dict[str, dict[str, set]] = defaultdict(lambda: defaultdict(set))
            for s, d, lines in zip(b["source"], b["doc"], b["lines"]):
                docs[s][d].update(lines.tolist())
            out = []
            for s, by_doc in docs.items():
                counts = Counter(x for lines in by_doc.values() for x in lines)
                k = math.ceil(counts.total() / (err_share * len(by_doc)))
                cut = 0
                if len(counts) > k:
                    cut = sorted(counts.values(), reverse=True)[k]
                out.append((s, True, 0, cut))
                out += [(s, False, line, n - cut) for line, n in counts.items() if n > cut]
            yield pd.DataFrame(out, columns=["source", "is_error", "line", "n"])

    return run


def heavy_lines(df: DataFrame, source: str, doc: str, text: str, labels: tuple[str, ...] = LABELS, share: float = 0.2, least: int = 3, err_share: float = 0.1) -> DataFrame:
    """(source, norm, n_docs, n_all): lines of at least ``least`` and ``share`` of a source's documents."""
    per_doc = exploded_lines(df, source, doc, text, labels)
    has = F.col(source).isNotNull()
    totals = df.where(has).groupBy(F.col(source).alias("source")).agg(F.countDistinct(doc).alias("n_all"))
    line = F.col(text)
    parts = F.transform(F.split(line, "\n"), lambda x: F.when(~_any_prefix(x, labels), normal_line(x)))
    batches = df.where(has & line.isNotNull()).select(
        F.col(source).alias("source"), F.col(doc).cast("string").alias("doc"), F.transform(F.filter(parts, lambda x: x.isNotNull() & (x != "")), lambda x: F.xxhash64(x)).alias("lines")
    )
    added = batches.mapInPandas(_summaries(err_share), "source string, is_error boolean, line long, n long").groupBy("source", "is_error", "line").agg(F.sum("n").alias("n"))
    added = checkpointed(added)
    loose = (
        added.where("is_error").select("source", F.col("n").alias("err"))
        .join(totals, "source").select("source", "n_all", (F.col("err") >= F.col("n_all") * share).alias("exact"), "err")
    )
    loose = checkpointed(loose)
    candidates = (
        added.where("NOT is_error").join(small_side(loose.where("NOT exact")), "source")
        .where((F.col("n") + F.col("err") >= F.col("n_all") * share) & (F.col("n") + F.col("err") >= least)).select("source", "line")
    )
    candidates = checkpointed(candidates)
    kept = per_doc.withColumn("line", F.xxhash64("norm")).join(small_side(candidates), ["source", "line"], "left_semi").drop("line")
    rest = per_doc.join(small_side(loose.where("exact")), "source", "left_semi")
    counted = kept.unionByName(rest).select("source", "norm", "doc").distinct().groupBy("source", "norm").agg(F.count("*").alias("n_docs"))
    return counted.join(small_side(loose.select("source", "n_all")), "source").where((F.col("n_docs") >= least) & (F.col("n_docs") >= F.col("n_all") * F.lit(share)))


def _any_prefix(x: F.Column, labels: tuple[str, ...]) -> F.Column:
    out = F.lit(False)
    for label in labels:
        out = out | x.startswith(label)
    return out


def found_lines(df: DataFrame, source: str, doc: str, text: str, **kw) -> DataFrame:
    """(doc, line_no) of every occurrence of a confirmed line, once per document."""
    heavy = checkpointed(heavy_lines(df, source, doc, text, **kw).select("source", "norm"))
    lines = exploded_lines(df, source, doc, text, kw.get("labels", LABELS))
    return lines.join(small_side(heavy), ["source", "norm"], "left_semi").select("doc", "line_no").distinct()


def cleaned(df: DataFrame, source: str, doc: str, text: str, **kw) -> DataFrame:
    """``df`` with ``clean_text``: the text without the confirmed lines of its source; all other lines stay as they are.

    Confirmed lines per source are at most (lines per document) / share, so they travel as one array per source.
    """
    labels = kw.get("labels", LABELS)
    heavy = heavy_lines(df, source, doc, text, **kw).groupBy("source").agg(F.collect_set("norm").alias("_heavy"))
    heavy = checkpointed(heavy.withColumnRenamed("source", "_source"))
    keep = lambda x: _any_prefix(x, labels) | ~F.coalesce(F.array_contains(F.col("_heavy"), normal_line(x)), F.lit(False))
    out = df.join(small_side(heavy, 20_000), F.col(source) == F.col("_source"), "left")
    return out.withColumn("clean_text", F.array_join(F.filter(F.split(F.col(text), "\n"), keep), "\n")).drop("_heavy", "_source")
