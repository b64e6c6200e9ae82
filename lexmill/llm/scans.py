"""Noise in text from scanned pages: find it, correct it, and put the text back as paragraphs.

1. *Counts.* Words and hyphenated compounds of all pages are counted (inside each batch first).
2. *Links.* Every word is rewritten by plausible glyph edits (``rn`` for ``m``, ``0`` for ``o`` ...); an
   equi-join with the counts links a rare word to a much more frequent one.
3. *Vectors.* Co-occurrence pairs of the words on either side of a link with frequent words are
   counted over all pages in one pass; skip-gram vectors with negative sampling are trained on the pairs (damped
   multiplicity) in blocks of about ``BLOCK`` pairs, whose vectors are averaged after every round, so no task grows
   with the corpus. A word's context vector is the mean of its neighbours' vectors; a link holds if both context
   vectors agree or one word never stands beside a frequent one.
4. *Pages.* Page numbers, running headers and hyphenated line ends are found at their places; rare
   words that are not known good are joined with the links. Where several links of a word hold, the neighbours of
   each occurrence decide between them. Furniture is removed and text reflowed.

What workers receive: words with at least ``FREQUENT`` of all tokens (at most 1 / FREQUENT words)
and compounds likewise, and the vectors of at most 1 / CONTEXT words. Rare words and rare compounds are never collected;
they are shuffled and joined. Every document is counted; nothing is sampled.

Edge cases: null pages and empty pages have no lines but keep their index; files without labelled
lines are known by their name alone; a file delivered again gives its cases once and is restored in its latest form;
characters that look right are folded before anything is judged; without any link the misread kind has no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import checkpointed, small_side
from .lookalike import one_form, replaced

#: share of all tokens from which a word is sent to every worker
FREQUENT = 1e-5
#: share of all tokens from which a word serves as context and has a vector
CONTEXT = 1e-4
WINDOW, DIMS = 2, 16
#: training: pairs a block, rounds of averaging, negative samples a pair, pairs a step, learning rate
BLOCK, ROUNDS, NEGATIVE, STEP, RATE = 500_000, 3, 5, 2048, 0.1
#: times that the right word must be as frequent: for edits that show, and for those within plain letters
RATIO_SEEN, RATIO_PLAIN, LIKE_SEEN, LIKE_PLAIN = 2, 8, 0.0, 0.35

#: fixed values: what scanners read, and what was printed
GLYPHS = (
    ("rn", "m"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("c", "e"), ("y", "v"), ("I", "l"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("6", "b"), ("5", "š"), ("5", "s"), ("2", "ž"), ("2", "z"), ("8", "B"), ("0", "O"),
    ("à", "á"), ("è", "é"), ("ì", "í"), ("ò", "ó"), ("ù", "ú"), ("ÿ", "ý"), ("ü", "ú"), ("ć", "č"),
)
_SEEN = frozenset("0125689àèìòùÿć")
_SITE = re.compile("|".join(re.escape(a) for a, _ in GLYPHS))
_WORD = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*")
_BLANK = " \t\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u202f\u2060\ufeff"
_CUT = re.compile(rf"([^\W\d_][\u0300-\u036f]*)([-\u00ad\u2010\u00ac])[{_BLANK}]*$")
_MARKS = frozenset("-\u00ad\u2010\u00ac")
_LABEL = re.compile(r"^(Súd|Spisová značka|Identifikačné číslo súdneho spisu|Dátum vydania rozhodnutia|Meno a priezvisko sudcu, VSÚ|ECLI):")
_FILLER = frozenset("sp zn č k pokračovanie rozhodnutia rozsudku uznesenia číslo konania spis".split())


def edits(word: str) -> list[str]:
    """What a word may have been before one or two glyphs were misread."""
    one = set()
    for a, b in GLYPHS:
        at = word.find(a)
        while at >= 0:
            one.add(word[:at] + b + word[at + len(a) :])
            at = word.find(a, at + 1)
    two = set()
    if len(word) > 4 and any(c in _SEEN for c in word):
        for w in one:
            for a, b in GLYPHS:
                at = w.find(a)
                while at >= 0:
                    two.add(w[:at] + b + w[at + len(a) :])
                    at = w.find(a, at + 1)
    return sorted((one | two) - {word})


def seen(word: str) -> bool:
    """Whether a word shows by itself that it is misread: digits among letters, foreign accents, a capital inside."""
    return any(c in _SEEN for c in word) and any(c.isalpha() for c in word) or "I" in word[1:] and not word.isupper()


def fair(word: str) -> bool:
    """Words that take part: two letters at least, more letters than digits."""
    letters = sum(map(str.isalpha, word))
    return letters >= 2 and letters > len(word) - letters


@lru_cache(maxsize=200_000)
def canon(word: str) -> str:
    """A form that a word and its misread forms share."""
    t = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", word.lower()))
    for a, b in (("rn", "m"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("ii", "u")):
        t = t.replace(a, b)
    return t.translate(_CANON)


_CANON = str.maketrans("016528yci", "olbszbvel")


_TOKEN = re.compile(r"[^\W_]+")


class Page:
    """Lines of one page of a file, raw and with look-alikes folded."""

    def __init__(self, no: int, text: str | None) -> None:
        self.no = no
        self.raw = (text or "").split("\n") if text else []
        self.lines = replaced(text).split("\n") if text else []
        if len(self.lines) != len(self.raw):
            self.lines = [replaced(x) for x in self.raw]
        self.kind: dict[int, str] = {}


def roman(n: int) -> str:
    out = ""
    for v, r in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += r * (n // v)
        n %= v
    return out


def is_page_number(line: str, number: int) -> bool:
    """Whether a line only numbers the page ``number``, in digits, or in Roman ones after a word for page or alone in small letters from two up."""
    letters = "".join(c for c in line if c.isalpha())
    nums = re.findall(r"\d+", line)
    if nums:
        if canon(letters) not in _NUMBER_WORDS:
            return False
        return len(nums) <= 2 and _is(nums[0], number) and (len(nums) == 1 or len(nums[1]) < 9 and int(nums[1]) >= number)
    if number == 1 and canon(letters) in _NUMBER_WORDS and canon(letters).endswith("l"):
        return True
    m = re.fullmatch(r"\W*([^\W\d_]*?)\W*([ivxlc]+|[IVXLC]+)\W*", line)
    if not m or m[2].lower() != roman(number):
        return False
    return bool(m[1]) and canon(m[1]) in _NUMBER_WORDS or not m[1] and number > 1 and m[2].islower() and "." not in line


def _is(digits: str, number: int) -> bool:
    return len(digits) < 9 and int(digits) == number


#: fixed values: words for page, and words between its number and the number of all pages
_NUMBER_WORDS = frozenset(
    canon(w) for w in ("", "strana", "str", "s", "stranaz", "zo", "z", "of", "l", "stranal", "strl", "stranazo", "p", "page", "pageof", "pg", "seite", "seitevon", "von", "oldal", "strona", "stronaz", "stranica", "pagina", "pág", "página", "stran")
)


def identity(filename: str, court: str | None, pages: list[Page]) -> tuple[set, set, str]:
    """(canonical words that name the file, those of which one is needed, digits of the docket)."""
    parts = re.sub(r"_\d+_dokument.*$", "", re.sub(r"\.\w+$", "", filename or "")).split("_")
    docket = parts[-3:] if len(parts) >= 5 else []
    words, key = set(), set()
    texts = [court or ""] + [x for p in pages[:1] for x in p.lines if _LABEL.match(x.strip())]
    for t in texts:
        label = _LABEL.match(t.strip())
        if label and label[1] not in ("Súd", "Spisová značka", "Dátum vydania rozhodnutia"):
            continue
        body = t.strip()[label.end() :] if label else t
        got = {canon(w) for w in re.findall(r"[^\W_]+", body)}
        words |= got
        if label and label[1] == "Dátum vydania rozhodnutia":
            key.add("".join(re.findall(r"\d+", body)))
    words |= {canon(w) for w in docket} | {canon(w) for w in parts[1:2]}
    if parts[0] in _COURTS:
        words |= {canon(w) for w in _COURTS[parts[0]].split()}
    return words, key, "/".join(docket)


#: fixed values: kinds of courts by the first part of a file's name
_COURTS = {"KS": "Krajský súd", "OS": "Okresný súd", "MS": "Mestský súd", "NS": "Najvyšší súd", "US": "Ústavný súd"}


def is_running_header(line: str, words: set, docket: str) -> bool:
    """Whether a line consists of nothing but what names the file: court, docket number, date; a full stop ends running text, not a header."""
    if _LABEL.match(line.strip()) or line.rstrip()[-1:] in ".,;?!":
        return False
    toks, foreign = [], 0
    for m in _TOKEN.finditer(line):
        toks.append(canon(m[0]))
        foreign += toks[-1] not in words and toks[-1] not in _FILLERS
        if foreign > 1:
            return False
    if not toks:
        return False
    own = [t for t in toks if t in words]
    rest = [t for t in toks if t not in words and t not in _FILLERS]
    if docket:
        number = [canon(x) for x in docket.split("/")]
        if rest and all(t.isdigit() or re.fullmatch(r"[obszl\d]+", t) for t in rest) and len(rest) == 1 and re.search(r"\d+/\d{4}-\d+\s*$", line) and toks[0] in number:
            rest = []
    return not rest and len(own) >= 2


_FILLERS = frozenset(canon(w) for w in _FILLER)


def furnish(pages: list[Page], filename: str, court: str | None, header: bool) -> None:
    """Mark page numbers and running headers at the edges of each page, as far as they follow each other there."""
    words, _, docket = identity(filename, court, pages)
    for p in pages:
        at = [i for i, x in enumerate(p.lines) if x.strip()]
        for order in (at, at[::-1]):
            for i in order:
                if i in p.kind:
                    continue
                if is_page_number(p.lines[i], p.no + 1):
                    p.kind[i] = "page_number"
                elif is_running_header(p.lines[i], words, docket) and not (header and order is not at and i > at[len(at) // 2]):
                    p.kind[i] = "running_header"
                else:
                    break


def cuts(pages: list[Page], compounds: frozenset, heads: frozenset, common: frozenset) -> Iterator[tuple[Page, int, str, str, Page, int, str | None]]:
    """(page, line_no, first part, second part, next page, next line_no, compound) of words cut by a line break, marks of known compounds left out.

    ``compound``: the word with its mark, if that may be its own and rarer compounds have to be asked.
    """
    text = [(p, i) for p in pages for i, x in enumerate(p.lines) if x.strip() and i not in p.kind]
    for (p, i), (q, j) in zip(text, text[1:]):
        m = _CUT.search(p.raw[i]) if p.raw[i].rstrip(_BLANK)[-1:] in _MARKS else None
        if not m:
            continue
        first = re.search(r"([^\W\d_]+)[-¬]?\s*$", p.lines[i])
        second = re.match(r"\s*([^\W\d_]+)", q.lines[j])
        if not first or not second:
            continue
        a, b = first[1], second[1]
        if not (b[0].islower() or a.isupper() and len(a) > 1 and b.isupper()):
            continue
        whole = None
        if m[2] in "-‐":
            whole = f"{a}-{b}".lower()
            if whole in compounds or a.lower() in heads and b.lower() in common and (a + b).lower() not in common:
                continue
        yield p, i, a, b, q, j, whole


def _pages(pages: list | np.ndarray | None) -> list[Page]:
    return [Page(i, t) for i, t in enumerate(pages if pages is not None else [])]


def inputs(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """(field_name, filename, court, pages, at) of the raw pages and of the headers; ``at`` is the time of delivery, if there is one."""
    at = lambda df: (F.col("ingested_at").cast("timestamp") if "ingested_at" in df.columns else F.lit(None).cast("timestamp")).alias("at")
    a = raw.select(F.lit("raw_pages").alias("field_name"), "filename", "court", F.col("raw_pages").alias("pages"), at(raw))
    b = processed.where("header IS NOT NULL").select(F.lit("header").alias("field_name"), "filename", "court", F.array("header").alias("pages"), at(processed))
    return a.unionByName(b).where("filename IS NOT NULL AND size(pages) > 0")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n: Counter = Counter()
        for pages in b["pages"]:
            for t in pages:
                if t:
                    n.update(_WORD.findall(replaced(t)))
        rows = [(w, k) for w, k in n.items() if fair(w)]
        yield pd.DataFrame([*rows, ("", n.total())], columns=["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all pages; the empty word holds the number of all tokens. A word divided by a line break counts as its parts."""
    return texts.select("pages").mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def glyph_links(counts: DataFrame) -> DataFrame:
    """(word, right, n, n_right, shows): words and more frequent words they may have been."""
    simple = counts.where(~F.col("word").contains("-") & (F.length("word") >= 3))
    site = simple.where(F.col("word").rlike(_SITE.pattern))
    rewrite = F.pandas_udf(lambda s: s.map(edits), "array<string>")
    shows = F.pandas_udf(lambda s: s.map(seen), "boolean")
    tried = site.select("word", "n", shows("word").alias("shows"), F.explode(rewrite("word")).alias("right"))
    right = simple.select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    ratio = F.when(F.col("shows"), RATIO_SEEN).otherwise(RATIO_PLAIN)
    return tried.join(right, "right").where(F.col("n_right") >= F.col("n") * ratio)


def _pairs(ids: dict[str, int], known: frozenset, right: frozenset) -> object:
    """(word, context, n, base) of neighbours among context words (base), and of words that are not known good or that a link names as ``right`` with context words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = list(ids)
        for b in batches:
            got: list[int] = []
            n: Counter = Counter()
            for pages in b["pages"]:
                for t in pages:
                    if not t:
                        continue
                    ws = _WORD.findall(replaced(t))
                    at = [ids.get(w, -1) for w in ws]
                    for i, k in enumerate(at):
                        if k < 0 and ((w := ws[i]) in right or w not in known and fair(w)):
                            n.update((w, c) for c in at[max(0, i - WINDOW) : i] + at[i + 1 : i + 1 + WINDOW] if c >= 0)
                    got += at
                    got += [-1] * WINDOW
            a = np.asarray(got, dtype=np.int64)
            keys = []
            for d in range(1, WINDOW + 1):
                x, y = a[:-d], a[d:]
                ok = (x >= 0) & (y >= 0)
                keys += [x[ok] << 32 | y[ok], y[ok] << 32 | x[ok]]
            k, m = np.unique(np.concatenate(keys), return_counts=True) if keys else (a[:0], a[:0])
            rows = [(names[i >> 32], names[i & 0xFFFFFFFF], j, True) for i, j in zip(k.tolist(), m.tolist())]
            rows += [(w, names[c], j, False) for (w, c), j in n.items()]
            yield pd.DataFrame(rows, columns=["word", "context", "n", "base"])

    return run


def _added(rows: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Values summed by row."""
    at = rows[:, None] * shape[1] + np.arange(shape[1])
    return np.bincount(at.ravel(), weights=values.ravel(), minlength=shape[0] * shape[1]).reshape(shape)


def trained(pairs: np.ndarray, own: np.ndarray, other: np.ndarray, noise: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One pass of skip-gram with negative sampling over (word, context) ids; steps are scaled per value by past gradients."""
    r = np.random.default_rng(seed)
    own, other = own.copy(), other.copy()
    past, past_other = np.full(own.shape, 1e-6), np.full(other.shape, 1e-6)
    order = r.permutation(len(pairs))
    for a in range(0, len(order), STEP):
        w, c = pairs[order[a : a + STEP]].T
        neg = np.searchsorted(noise, r.random((len(w), NEGATIVE)))
        for x, sign in ((c[:, None], 1.0), (neg, 0.0)):
            u, v = own[w], other[x]
            g = sign - 1 / (1 + np.exp(-np.einsum("id,ikd->ik", u, v)))
            up = _added(w, np.einsum("ik,ikd->id", g, v), own.shape)
            vp = _added(x.ravel(), g[:, :, None] * u[:, None, :], other.shape)
            past += up * up
            past_other += vp * vp
            own += RATE * up / np.sqrt(past)
            other += RATE * vp / np.sqrt(past_other)
    return own, other


def _turn(sent: object, noise: np.ndarray, turn: int) -> object:
    """One round over a block of (w, c, times)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "c"], kind="stable")
        own, other = sent.value
        p = np.repeat(pdf[["w", "c"]].to_numpy(), pdf["times"].to_numpy(), axis=0)
        own, other = trained(p, own, other, noise, 1000 * turn + int(pdf["block"].iloc[0]))
        return pd.DataFrame({"id": range(len(own)), "a": list(own), "b": list(other)})

    return run


def skip_grams(pairs: DataFrame, ids: dict[str, int]) -> dict[str, np.ndarray]:
    """A vector per context word. ``pairs``: (word, context, n) among context words, at most (1 / CONTEXT)^2 whatever the corpus.

    Pairs are dealt to blocks by hash and sorted there, so training gives the same vectors every time; after each
    round the blocks' vectors are averaged, and only these, of at most 1 / CONTEXT words, reach the driver.
    """
    spark, size = pairs.sparkSession, len(ids)
    numbers = spark.createDataFrame(list(ids.items()), "word string, id int")
    number = F.broadcast(numbers)
    times = F.ceil(F.log2(F.col("n") + 1)).cast("int")
    of = pairs.join(number.withColumnRenamed("id", "w"), "word").join(number.select(F.col("word").alias("context"), F.col("id").alias("c")), "context").select("w", "c", times.alias("times"))
    of = checkpointed(of)
    total = of.agg(F.sum("times")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    weight = np.zeros(size)
    for r in of.groupBy("c").agg(F.sum("times").alias("n")).toLocalIterator():
        weight[r["c"]] = r["n"] ** 0.75
    noise = np.cumsum(weight) / weight.sum()
    start = np.random.default_rng(7)
    own, other = (start.random((size, DIMS)) - 0.5) / DIMS, np.zeros((size, DIMS))
    dealt = of.withColumn("block", F.pmod(F.xxhash64("w", "c"), F.lit(blocks)).cast("int"))
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((own, other))
        mean = lambda c: F.array(*[F.avg(F.col(c)[i]) for i in range(DIMS)]).alias(c)
        out = dealt.groupBy("block").applyInPandas(_turn(sent, noise, turn), "id int, a array<double>, b array<double>").groupBy("id").agg(mean("a"), mean("b"))
        for r in out.toLocalIterator():
            own[r["id"]], other[r["id"]] = r["a"], r["b"]
    return {w: own[i] for w, i in ids.items()}


def _often(counts: DataFrame, total: int, share: float, most: int | None = None) -> list[tuple[str, int]]:
    """Words with at least ``share`` of all tokens; at most 1 / share of them exist."""
    return [(r["word"], r["n"]) for r in counts.where(f"word <> '' AND n >= {max(2, share * total)}").orderBy(F.desc("n"), "word").collect()]


_OPTIONS = "word string, options array<struct<score: double, right: string, shows: boolean, likeness: double, v: array<double>>>"


class Learnt:
    """What the corpus teaches: known good words, compounds, vectors and the table of corrections.

    ``options``: (word, options), the links of each word that hold, the best of the word as such first;
    ``corrections``: that best one alone. ``compounds`` are frequent ones; ``rare_compounds`` (word) the others.
    """

    def __init__(self, texts: DataFrame) -> None:
        counts = checkpointed(word_counts(texts))
        total = (counts.where("word = ''").select(F.sum("n")).first() or [0])[0] or 0
        links = checkpointed(glyph_links(counts))
        good = counts.join(links.select("word").distinct(), "word", "left_anti")
        frequent = _often(good, total, FREQUENT)
        self.common = frozenset(w.lower() for w, _ in frequent if "-" not in w)
        self.known = frozenset(w for w, _ in frequent)
        self.compounds = frozenset(w.lower() for w, _ in frequent if "-" in w)
        self.heads = frozenset(w.split("-")[0] for w in self.compounds)
        # a rarer compound is known if it is written with its mark more often than without
        lower = counts.where("word <> ''").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
        marked = lower.where(F.col("word").contains("-")).select(F.col("word").alias("compound"), F.replace("word", F.lit("-"), F.lit("")).alias("word"), F.col("n").alias("n_marked"))
        bare = marked.join(lower, "word", "left")
        self.rare_compounds = bare.where("n_marked >= 2 AND n_marked > coalesce(n, 0)").select(F.col("compound").alias("word"))
        self.vectors: dict[str, np.ndarray] = {}
        contexts = [w for w, n in frequent if n >= CONTEXT * total]
        none = F.lit(None).cast("array<double>")
        if not contexts or not links.head(1):
            held = links.where("shows").withColumn("likeness", F.lit(1.0)).withColumn("v", none)
        else:
            ids = {w: i for i, w in enumerate(contexts)}
            right = checkpointed(links.select(F.col("right").alias("word")).distinct())
            linked = checkpointed(links.select("word").union(right).distinct().withColumn("linked", F.lit(True)))
            # of the right words, frequent ones that are no contexts are sent (at most 1 / FREQUENT); contexts are base pairs, rarer ones are not known good
            between = frozenset(w for w, _ in _often(good.join(right, "word", "left_semi"), total, FREQUENT)) - ids.keys()
            near = texts.select("pages").mapInPandas(_pairs(ids, self.known, between), "word string, context string, n long, base boolean")
            near = near.join(small_side(linked), "word", "left").where("base OR linked").groupBy("word", "context", "base").agg(F.sum("n").alias("n"))
            near = checkpointed(near)
            self.vectors = skip_grams(near.where("base"), ids)
            table = links.sparkSession.createDataFrame([(w, v.tolist()) for w, v in self.vectors.items()], "context string, v array<double>")
            means = checkpointed(_context_vectors(near.join(small_side(linked), "word", "left_semi"), F.broadcast(table)))  # at most 1 / CONTEXT words
            scored = links.join(means.select("word", F.col("v").alias("a")), "word", "left").join(means.select(F.col("word").alias("right"), "v"), "right", "left")
            scored = scored.withColumn("likeness", _cosine(F.col("a"), F.col("v")))
            least = F.when(F.col("shows"), LIKE_SEEN).otherwise(LIKE_PLAIN)
            # null: no context word beside any occurrence of the word or the right one, so nothing speaks against the counts
            held = scored.where(F.col("likeness").isNull() | (F.col("likeness") >= least))
        score = F.coalesce("likeness", F.lit(0.0)) + 0.05 * F.log10("n_right")
        each = F.struct((-score).alias("order"), "right", "shows", "likeness", "v")
        sorted_ = held.groupBy("word").agg(F.sort_array(F.collect_list(each)).alias("o"))
        self.options = checkpointed(sorted_.select("word", F.transform("o", lambda x: F.struct((-x["order"]).alias("score"), x["right"].alias("right"), x["shows"].alias("shows"), x["likeness"].alias("likeness"), x["v"].alias("v"))).alias("options")))
        self.corrections = self.options.select("word", F.col("options")[0]["right"].alias("right"), F.col("options")[0]["shows"].alias("shows"), F.col("options")[0]["likeness"].alias("likeness"))


def _cosine(a: F.Column, b: F.Column) -> F.Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def _context_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(word, v): the mean vector of each word's neighbours."""
    sums = pairs.join(vectors, "context").groupBy("word").agg(*[F.sum(F.col("n") * F.col("v")[i]).alias(f"v{i}") for i in range(DIMS)])
    return sums.select("word", F.array(*[f"v{i}" for i in range(DIMS)]).alias("v"))


_ROWS = "field_name string, filename string, version long, page_no int, line_no int, kind string, word string, part int, next_page int, next_line int, near array<double>"


def _look(known: frozenset, compounds: frozenset, heads: frozenset, common: frozenset, vectors: dict[str, np.ndarray]) -> object:
    """Furniture and cut words of every file, and its words that are not known good (kind ``?``) with the sum of their neighbours' vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for field, name, court, texts, version in zip(b["field_name"], b["filename"], b["court"], b["pages"], b["version"]):
                pages = _pages(texts)
                at = (lambda p: -1) if field == "header" else (lambda p: p.no)
                furnish(pages, name, court, field == "header")
                joined: set = set()
                for p, i, a, c, q, j, whole in cuts(pages, compounds, heads, common):
                    rows.append((field, name, version, at(p), i, "hyphen_break", whole, 0, 0, 0, None))
                    joined |= {(p.no, i, "end"), (q.no, j, "start")}
                    w = a + c
                    if w not in known and _SITE.search(w) and fair(w):
                        rows.append((field, name, version, at(p), i, "?", w, len(a), at(q), j, None))
                for p in pages:
                    for i, kind in p.kind.items():
                        rows.append((field, name, version, at(p), i, kind, None, 0, 0, 0, None))
                    flat: list[str] = []
                    odd: list[tuple[int, int]] = []
                    for i, line in enumerate(p.lines):
                        ws = _WORD.findall(line)
                        if ws and (p.no, i, "end") in joined:
                            ws = ws[:-1]
                        if ws and (p.no, i, "start") in joined:
                            ws = ws[1:]
                        odd += [(len(flat) + k, i) for k, w in enumerate(ws) if w not in known and _SITE.search(w)]
                        flat += ws
                    for k, i in odd:
                        parts = [x for x in flat[k].split("-") if x not in known and fair(x)]
                        if not parts:
                            continue
                        beside = [vectors[w] for w in flat[max(0, k - WINDOW) : k] + flat[k + 1 : k + 1 + WINDOW] if w in vectors]
                        near = np.add.reduce(beside) if beside else None
                        rows += [(field, name, version, at(p), i, "?", x, 0, 0, 0, near) for x in parts]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ROWS.split(", ")])

    return run


def _read(options: F.Column, near: F.Column) -> F.Column:
    """The right word of an occurrence: of several options the one whose context suits the neighbours, else the best of the word."""
    suited = F.transform(options, lambda o: F.struct((o["score"] + F.coalesce(_cosine(near, o["v"]), F.lit(0.0))).alias("s"), o["right"].alias("right")))
    best = F.aggregate(suited, suited[0], lambda a, x: F.when(x["s"] > a["s"], x).otherwise(a))
    return F.when((F.size(options) == 1) | near.isNull(), options[0]["right"]).otherwise(best["right"])


def noise(texts: DataFrame, learnt: Learnt | None = None) -> DataFrame:
    """(field_name, filename, version, page_no, line_no, kind, word, right): every noisy line and kind, with the word and its correction. ``version``: hash of the pages as delivered."""
    learnt = learnt or Learnt(texts)
    rows = texts.withColumn("version", F.xxhash64("pages")).select("field_name", "filename", "court", "pages", "version")
    rows = checkpointed(rows.mapInPandas(_look(learnt.known, learnt.compounds, learnt.heads, learnt.common, learnt.vectors), _ROWS))
    place = ["field_name", "filename", "version", "page_no", "line_no", "kind"]
    none = F.lit(None).cast("string")
    furniture = rows.where("kind NOT IN ('?', 'hyphen_break')").select(*place, none.alias("word"), none.alias("right"))
    cut = rows.where("kind = 'hyphen_break'").join(small_side(checkpointed(learnt.rare_compounds)), "word", "left_anti").select(*place, none.alias("word"), none.alias("right"))
    word = rows.where("kind = '?'").join(small_side(learnt.options), "word").withColumn("right", _read(F.col("options"), F.col("near")))
    same = F.length(F.regexp_extract(F.concat_ws("\u0001", "word", "right"), "^(.*).*\u0001\\1", 1))
    later = (F.col("part") > 0) & (same >= F.col("part"))
    misread = word.select(
        "field_name", "filename", "version", F.when(later, F.col("next_page")).otherwise(F.col("page_no")).alias("page_no"),
        F.when(later, F.col("next_line")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("kind"), "word", "right",
    )
    return furniture.unionByName(cut).unionByName(misread)


def found(texts: DataFrame) -> DataFrame:
    """(field_name, filename, page_no, line_no, kind), each once."""
    return noise(texts).select("field_name", "filename", "page_no", "line_no", "kind").distinct()


def reflow(pages: list | np.ndarray | None, marks: list, filename: str, court: str | None) -> list[str]:
    """The paragraphs of a file. ``marks``: (page_no, line_no, kind, word, right)."""
    own = _pages(pages)
    drop, cut, right = set(), set(), {}
    for m in marks:
        place = (m["page_no"], m["line_no"])
        if m["kind"] in ("page_number", "running_header"):
            drop.add(place)
        elif m["kind"] == "hyphen_break":
            cut.add(place)
        elif m["word"]:
            right.setdefault(place, {})[m["word"]] = m["right"]
    out: list[str] = []
    text, glue = "", False
    joined: dict[str, str] = {}  # corrections of words that two lines make up, for the paragraph

    def done() -> None:
        out.append(_corrected(text, joined))
        joined.clear()

    for p in own:
        for i, line in enumerate(p.lines):
            if (p.no, i) in drop:
                continue
            s = line.strip()
            new = not s and i + 1 < len(p.lines) or re.match(r"\(?\d{1,3}[.)]\s+[^\W\d_]", s) and text.rstrip()[-1:] in ".?!:…“" or _LABEL.match(s) or _LABEL.match(text)
            if new and not glue and text:
                done()
                text = ""
            if not s:
                continue
            if (p.no, i) in cut:
                s = re.sub(r"[-¬]\s*$", "", s)
            mine = right.get((p.no, i), {})
            whole = {x for w in _WORD.findall(s) for x in w.split("-")}
            joined.update({w: r for w, r in mine.items() if w not in whole})
            s = _corrected(s, {w: r for w, r in mine.items() if w in whole})
            text = f"{text}{'' if glue or not text else ' '}{s}"
            glue = (p.no, i) in cut
    if text:
        done()
    return [one_form(t) for t in out]


def _corrected(text: str, right: dict[str, str]) -> str:
    return _WORD.sub(lambda m: "-".join(right.get(x, x) for x in m[0].split("-")), text) if right else text


def restored(texts: DataFrame) -> DataFrame:
    """(field_name, filename, paragraph_no, paragraph): the latest delivery of each file without furniture, with whole and corrected words."""
    marks = noise(texts).withColumn("page_no", F.greatest("page_no", F.lit(0))).groupBy("field_name", "filename", "version").agg(
        F.collect_set(F.struct("page_no", "line_no", "kind", "word", "right")).alias("marks")
    )
    versions = texts.withColumn("version", F.xxhash64("pages"))
    newest = F.row_number().over(Window.partitionBy("field_name", "filename").orderBy(F.desc_nulls_last("at"), "version", "court"))
    latest = versions.withColumn("k", newest).where("k = 1").drop("k", "at")
    both = latest.join(marks, ["field_name", "filename", "version"], "left")
    build = F.pandas_udf(
        lambda p, m, f, c: pd.Series([reflow(a, [] if b is None else list(b), x, y) for a, b, x, y in zip(p, m, f, c)]), "array<string>"
    )
    return both.select("field_name", "filename", F.posexplode(build("pages", "marks", "filename", "court")).alias("paragraph_no", "paragraph"))
