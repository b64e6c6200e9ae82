"""Evaluation texts leaking into training text: template windows, hash join, slot check.

Both sides are folded (look-alikes, case, accents, line-end division) and cut into words. Numbers,
names and units become typed placeholders, so that a window of ``n_words`` has a template and slots.
The items' windows - a stated query set - are counted and broadcast; a document emits only windows
whose words all occur in the items (lossless), joined by the hash of the template. Slots then tell
verbatim windows (same slots) from re-parameterised occurrences (other slots, one renaming in both directions).

Names and units are typed by what the items show, whatever the case on the other side: a name is a
word that the items write with a capital inside sentences only; a unit is a word that follows a
number at least twice. Unknown capitalised words of a document count as names.

Edge cases: null or empty texts and passages of fewer than ``n_words`` words give no rows; a word
divided at a line end is read joined and, where its mark may be its own hyphen, also apart; repeated
rows give one pair; very long texts are read once, window by window.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import replaced

N_WORDS = 12
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"(?<=\w)[-¬][ \t]*\n\s*(?=\w)")
_SOFT = re.compile(r"(?<=\w)¬[ \t]*\n\s*(?=\w)")
_PIECES = "thash long, whash long, slots array<string>, item_at int"


def _plain(text: str) -> str:
    t = unicodedata.normalize("NFD", text)
    return re.sub(r"[̀-ͯ]", "", t) if len(t) != len(text) else t


def words_of(text: str) -> list[list[str]]:
    """The readings of a text as words in their own case, without accents: divided words joined, and apart if a mark may be a hyphen."""
    t = replaced(text)
    joined = _plain(_BREAK.sub("", t))
    out = [_WORD.findall(joined)]
    if (apart := _SOFT.sub("", t)) != _BREAK.sub("", t):
        out.append(_WORD.findall(_plain(apart)))
    return out


class Typing:
    """Vocabulary, names and units that the items show."""

    def __init__(self, passages: list[str]) -> None:
        self.seen: dict[str, tuple[str | None, str]] = {}
        lower, mid, unit = Counter(), Counter(), Counter()
        for p in passages:
            for s in re.split(r"[.!?]\s+", _plain(replaced(p))):
                ws = _WORD.findall(s)
                lower.update(w.casefold() for w in ws if w[0].islower())
                mid.update(w.casefold() for w in ws[1:] if w[0].isupper() and not w.isupper())
                unit.update(b.casefold() for a, b in zip(ws, ws[1:]) if a.isdigit() and b[0].isalpha())
        self.vocab = frozenset(w.casefold() for p in passages for ws in words_of(p) for w in ws)
        self.names = frozenset(w for w in mid if w not in lower)
        self.units = frozenset(w for w, n in unit.items() if n > 1 and w not in self.names)

    def typed(self, word: str) -> tuple[str | None, str]:
        """(template word or None if it can't occur in an item, literal word), remembered per worker."""
        if word not in self.seen:
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = self._typed(word)
        return self.seen[word]

    def _typed(self, word: str) -> tuple[str | None, str]:
        w = word.casefold()
        if any(c.isdigit() for c in w):
            return "<num>", w
        if w in self.names:
            return "<name>", w
        if w in self.units:
            return "<unit>", w
        if w in self.vocab:
            return w, w
        return ("<name>" if word[0].isupper() else None), w


def windows(text: str | None, typing: Typing, n: int) -> Iterator[tuple]:
    """(thash, whash, slots, place) of every window of ``n`` words that may occur in an item."""
    if not text:
        return
    seen = set()
    for ws in words_of(text):
        run: list[tuple[str, str]] = []
        for i, w in enumerate([*ws, ""]):
            got = typing.typed(w) if w else (None, "")
            if got[0] is not None:
                run.append(got)
                continue
            if len(run) >= n:
                at = i - len(run)
                for k in range(len(run) - n + 1):
                    part = run[k : k + n]
                    t = xxhash.xxh64_intdigest(" ".join(x for x, _ in part)) - 2**63
                    v = xxhash.xxh64_intdigest(" ".join(x for _, x in part)) - 2**63
                    if (t, v) not in seen:
                        seen.add((t, v))
                        yield t, v, [b for a, b in part if a[0] == "<"], at + k
            run = []


def _windows_of(df: DataFrame, key: str, text: str, typing: Typing, n: int) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *w) for k, t in zip(b["k"], b["t"]) for w in windows(t, typing, n)]
            yield pd.DataFrame(rows, columns=["k", "thash", "whash", "slots", "item_at"])

    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, {_PIECES}")


def matches(docs: DataFrame, items: DataFrame, n_words: int = N_WORDS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, place, item_place, verbatim, slots_doc, slots_item) of template windows found on both sides; places count words.

    ``items`` is the stated query set, read by the driver for its vocabulary; its windows are broadcast, as many as its words.
    """
    passages = [r["passage"] for r in items.where("passage IS NOT NULL").select("passage").collect()]
    typing = Typing(passages)
    wanted = _windows_of(items, "item_id", "passage", typing, n_words).select(
        F.col("k").alias("item_id"), "thash", F.col("whash").alias("item_whash"), F.col("slots").alias("slots_item"), F.col("item_at").alias("item_place")
    )
    held = _windows_of(docs, doc, text, typing, n_words)
    joined = held.join(F.broadcast(wanted) if sum(map(len, passages)) < 50_000_000 else wanted, "thash")
    return joined.select(F.col("k").alias("doc_id"), "item_id", F.col("item_at").alias("place"), "item_place", (F.col("whash") == F.col("item_whash")).alias("verbatim"), F.col("slots").alias("slots_doc"), "slots_item")


def leaks(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """(doc_id, item_id): documents that hold ``n_words`` consecutive words of an item."""
    return matches(docs, items, **kw).where("verbatim").select("doc_id", "item_id").distinct()


def reparameterised(docs: DataFrame, items: DataFrame, least: int = 1, literal: int = 6, **kw) -> DataFrame:
    """(doc_id, item_id, n_windows): items that stand in a document with other slot values.

    Windows that lie alike in document and item (place less item place) are one occurrence, so a document may hold an item
    several times, with other values each time or as it is. An occurrence counts if each item value has one value in it and
    each of its values one item value, at least one differs, ``least`` windows belong to it and one of them has at least
    ``literal`` words that are no slots, as windows of placeholders alone meet by chance. ``n_windows`` is that of the
    largest occurrence. Windows without slots belong to an occurrence but tell nothing.
    """
    n = kw.get("n_words", N_WORDS)
    m = matches(docs, items, **kw).withColumn("shift", F.col("place") - F.col("item_place"))
    of = ["doc_id", "item_id", "shift"]
    pair = F.explode_outer(F.arrays_zip("slots_item", "slots_doc"))
    pairs = m.select(*of, "place", F.size("slots_item").alias("slots"), pair.alias("pair"))
    pairs = pairs.select(*of, "place", "slots", F.col("pair.slots_item").alias("a"), F.col("pair.slots_doc").alias("b"))
    # values are few in an occurrence (at most the item's words), so it is settled on one row
    seen = pairs.groupBy(*of).agg(F.collect_set(F.when(F.col("a").isNotNull(), F.struct("a", "b"))).alias("ways"), F.countDistinct("place").alias("n_windows"), F.min("slots").alias("fewest"))
    distinct = lambda c: F.size(F.array_distinct(F.transform("ways", lambda w: w[c])))
    steady = (distinct("a") == F.size("ways")) & (distinct("b") == F.size("ways")) & F.exists("ways", lambda w: w["a"] != w["b"])
    good = seen.where(steady & (F.col("n_windows") >= least) & (F.lit(n) - F.col("fewest") >= literal))
    return good.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"))
