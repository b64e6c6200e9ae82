"""Sentence boundaries across languages and scripts, by document-centred disambiguation.

Pass 1 gathers, per word, unambiguous occurrences over all documents: followed by a period and then
a small letter, digit or sign (abbreviation); without a period (ordinary word); with a period at a
paragraph's end (may end a sentence); at a certain sentence start; with a capital inside a
sentence (proper name). Pass 2 decides each period of a document by the document's own
unambiguous occurrences first and by the corpus otherwise. Scripts have their own terminators:
ideographic stops end at once, the danda ends in Devanagari where periods only abbreviate, a
semicolon asks in Greek, a blank parts sentences in Thai.

Corpus facts about words with at least ``least_share`` of all periods, starts or names are sent to the workers (at
most 3 / least_share words, whatever the corpus). Facts about all other words are joined by word with what each
document asks for, and reach that document alone, so that a rare word counts as much in a large corpus as in a small
one.

Edge cases: null and empty texts have no sentences; a text without terminators is one sentence per
paragraph; quotations are not cut inside; a paragraph number belongs to the sentence after it; documents with the same
key share what they ask for. A word before a period is looked at in its last ``WORD`` characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed, small_side

_PARA = re.compile(r"\n[^\S\n]*\n\s*")
_END = re.compile(r"(?:(?:\.(?!\d)|[!?…])[.!?…]*|[。！？｡]+|[।॥]+|[;;](?=\s|$))[\"”“’»」』）)\]]*")
_QUOTE = re.compile(r"„[^„“”]*[“”]|“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|\"[^\"\n]*\"")
_NUMBER = re.compile(r"(?:\(\d{1,3}\)|\d{1,3}[.)])\s+(?=[„“\"«「]?[^\W\d_])")
_MARK = re.compile(r"(?:\(?\d{1,3}[.)]|[*•–-])\s*")
_CHAIN = re.compile(r"(?:(?<=\s)|(?<=^)|(?<=[(„“\"]))((?:[^\W\d_]{1,2}\.\s?)+[^\W\d_]{1,3}|[^\W\d_]+)$")
_NEXT = re.compile(r"\s*[„“\"«「(]?([^\W_]+)")
_CODE = re.compile(r"^[^\W\d_]+\d")
_THAI = re.compile("[฀-๿]")
_GREEK = re.compile("[Ͱ-Ͽ]")
_DEVANAGARI = re.compile("[ऀ-ॿ]")
_CASELESS = re.compile("[ऀ-෿฀-໿぀-ヿ㐀-鿿]")
#: letters of the longest word that is taken for an abbreviation only because it never ends a paragraph
LONGEST = 5
#: characters of the longest word, number or code that is looked at whole
WORD = 200
_SPACE = re.compile(r"\s+")
_INK = re.compile(r"\S")
_TOKEN = re.compile(r"(?<![\w.])[^\W\d_]+(?:\.[^\W\d_]+)*(?![\w.])")
_CORE = re.compile(r"\w+")
_PLAIN = re.compile(r"(?<![\w.])[^\W\d_]+(?![\w.])")
_OPENS = re.compile("[„“«「『\"]")
_AFTER = ".,;:!?…)“”\"’»"
_CLOSERS = "\"”“’»」』）)]"


_ANY_END = ".!?…。！？｡।॥;;" + _CLOSERS


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stripped blocks between blank lines."""
    at = 0
    for m in [*_PARA.finditer(text), None]:
        end = m.start() if m else len(text)
        block = text[at:end]
        if block.strip():
            a = at + len(block) - len(block.lstrip())
            yield a, at + len(block.rstrip())
        at = m.end() if m else end


def token_start(p: str, i: int, least: int = 0) -> int:
    """Where the run without blanks that ends before ``i`` begins."""
    least = max(least, i - WORD)
    return max(p.rfind(" ", least, i), p.rfind("\n", least, i), least - 1) + 1


def key_of(p: str, i: int) -> str:
    """The word before a period at ``i``, with the short dotted words that lead up to it (``s. r. o``)."""
    tok = p[token_start(p, i) : i]
    if len(tok) > 3 and tok.isalpha():
        return tok.casefold()
    m = _CHAIN.search(p[max(0, i - max(40, len(tok))) : i])
    return _SPACE.sub("", m[1]).casefold() if m else ""


class Mark:
    """A terminator with its closing marks: where it is, what comes before and after."""

    __slots__ = ("_word", "at", "c", "end", "key", "p", "start", "stop")

    def __init__(self, p: str, start: int, end: int) -> None:
        self.p, self.start, self.end, self.stop = p, start, end, p[start]
        m = _INK.search(p, end)
        self.at = m.start() if m else len(p)
        self.c = p[self.at : self.at + 1]
        self._word: str | None = None
        plain = self.stop == "." and p[start + 1 : start + 2] != "."
        self.key = key_of(p, start) if plain else ""

    def numbered(self) -> re.Match | None:
        """The paragraph number of a line that follows."""
        return _NUMBER.match(self.p, self.at) if "\n" in self.p[self.end : self.at] else None

    @property
    def word(self) -> str:
        if self._word is None:
            n = _NEXT.match(self.p, self.end)
            self._word = n[1] if n else ""
        return self._word


def marks_of(p: str) -> list[Mark]:
    return [Mark(p, *m.span()) for m in _END.finditer(p)]


def tally(p: str, marks: list[Mark], n: dict[tuple[str, str], int]) -> None:
    """Count what periods, paragraph ends and certain starts of a paragraph tell."""

    def add(what: str, word: str) -> None:
        n[what, word] = n.get((what, word), 0) + 1

    m = _NUMBER.match(p)
    if first := _NEXT.match(p, m.end() if m else 0):
        add("start", first[1])
    for k in marks:
        if k.stop != ".":
            if k.word[:1].isupper():
                add("start", k.word)
        elif k.key:
            add("dot", k.key)
            c, nxt = k.c, p[k.end : k.end + 1]
            if not nxt:
                add("end", k.key)
            elif k.end - k.start == 1 and (nxt in ",:;)%" or nxt.isspace() and (c.islower() or (c.isdigit() or c == "(") and not k.numbered() or c in "§,;:%&№" or c.isalpha() and _CODE.search(k.word))):
                add("abbr", k.key)


def asked(marks: list[Mark]) -> set[tuple[str, str]]:
    """What a document may ask the corpus: words before its periods, and those that come next."""
    out: set[tuple[str, str]] = set()
    for k in marks:
        if k.stop == "." and k.c and not k.c.islower():
            if k.key:
                out.add(("key", k.key))
            if k.word:
                out.add(("next", k.word))
    return out


def observe(*texts: str, told: list[set] | None = None) -> Counter:
    """Counts of (what, word) for every unambiguous occurrence: abbr, dot, plain, end, start, mid.

    ``told``: a list that gets, for every text, what it may ask the corpus.
    """
    n: Counter = Counter()
    plain: Counter = Counter()
    inside: Counter = Counter()
    for text in texts:
        wants: set = set()
        for a, b in paragraphs(text):
            p = text[a:b]
            marks = marks_of(p)
            tally(p, marks, n)
            if told is not None:
                wants |= asked(marks)
        if told is not None:
            told.append(wants)
        plain.update(_PLAIN.findall(text))
        toks = text.split()
        inside.update([w for v, w in zip(toks, toks[1:]) if w[0].isupper() and v[0].islower() and v[-1].isalnum()])
    for w, k in plain.items():
        n["plain", w.casefold()] += k
    for w, k in inside.items():
        n["mid", w.rstrip(_AFTER)] += k
    return n


class Facts:
    """Counts of unambiguous occurrences, of one document or of the corpus."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.n = counts
        self.seen: dict[str, bool | None] = {}

    def known(self, k: str, sure: int) -> bool | None:
        """``abbreviation`` remembered, for facts that no longer change."""
        if k not in self.seen:
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[k] = self.abbreviation(k, sure)
        return self.seen[k]

    def abbreviation(self, k: str, sure: int) -> bool | None:
        """Whether ``k`` is an abbreviation; None if there is no evidence."""
        dot, abbr, plain, end = (self.n.get((x, k), 0) for x in ("dot", "abbr", "plain", "end"))
        if abbr and abbr >= 0.1 * plain and abbr >= 0.02 * dot:
            return True
        if dot >= sure and not end and plain <= 0.02 * dot and len(k) <= LONGEST:
            return True
        return False if plain or end else None

    def ender(self, k: str) -> bool | None:
        dot, end = self.n.get(("dot", k), 0), self.n.get(("end", k), 0)
        return True if end and end >= 0.01 * dot else False if dot >= 20 else None

    def starter(self, w: str) -> bool | None:
        start, mid = self.n.get(("start", w), 0), self.n.get(("mid", w), 0)
        return True if start and start >= 0.004 * mid else False if mid else None


class Told(Facts):
    """Corpus facts about the rarer words that one document asks for, before those that all workers have."""

    def __init__(self, counts: dict[tuple[str, str], int], base: Facts) -> None:
        super().__init__(counts)
        self.base = base

    def known(self, k: str, sure: int) -> bool | None:
        return self.abbreviation(k, sure) if ("dot", k) in self.n else self.base.known(k, sure)

    def ender(self, k: str) -> bool | None:
        return super().ender(k) if ("dot", k) in self.n else self.base.ender(k)

    def starter(self, w: str) -> bool | None:
        return super().starter(w) if ("start", w) in self.n or ("mid", w) in self.n else self.base.starter(w)


class Own(Facts):
    """Facts of one document. The first ordinary words and names asked for are looked up in the text, then all are counted at once, so that a text is read a fixed number of times."""

    #: words looked up before all are counted
    ONE_BY_ONE = 24

    def __init__(self, text: str, n: dict[tuple[str, str], int]) -> None:
        super().__init__(n)
        self.text, self.low = text, text.casefold()
        self.asked: set[tuple[str, str]] = set()
        self.all: dict[str, Counter] = {}
        self.times = Counter()

    def look(self, what: str, word: str) -> None:
        if (what, word) in self.asked or not word:
            return
        self.asked.add((what, word))
        self.times[what] += 1
        if self.times[what] > self.ONE_BY_ONE:
            if what not in self.all:
                self.all[what] = self._plain() if what == "plain" else self._names()
            self.n[what, word] = self.all[what][word]
            return
        t, at, n = (self.low if what == "plain" else self.text), -1, 0
        while (at := t.find(word, at + 1)) >= 0:
            left, right = t[at - 1 : at] if at else " ", t[at + len(word) : at + len(word) + 1]
            if right.isalnum() or right == "_":
                continue
            if what == "plain":
                n += not (left.isalnum() or left in "_.") and right != "."
            elif left.isspace():
                end = at
                while end and t[end - 1].isspace():
                    end -= 1
                begin = end
                while begin and not t[begin - 1].isspace():
                    begin -= 1
                n += begin < end and t[begin].islower() and t[end - 1].isalnum()
        self.n[what, word] = n

    def _plain(self) -> Counter:
        return Counter(_TOKEN.findall(self.low))

    def _names(self) -> Counter:
        toks = self.text.split()
        return Counter(m[0] for v, w in zip(toks, toks[1:]) if v[0].islower() and v[-1].isalnum() and (m := _CORE.match(w)))

    def abbreviation(self, k: str, sure: int) -> bool | None:
        self.look("plain", k)
        return super().abbreviation(k, sure)

    def starter(self, w: str) -> bool | None:
        self.look("mid", w)
        return super().starter(w)


def _first(*facts: bool | None) -> bool | None:
    return next((x for x in facts if x is not None), None)


def ends(text: str | None, corpus: Facts, sure: int = 8) -> list[int]:
    """The end positions of a text's sentences, in order."""
    if not text or not text.strip():
        return []
    parts = [(a, text[a:b]) for a, b in paragraphs(text)]
    all_marks = [marks_of(p) for _, p in parts]
    n: dict[tuple[str, str], int] = {}
    for (_, p), marks in zip(parts, all_marks):
        tally(p, marks, n)
    own = Own(text, n)
    greek, thai = bool(_GREEK.search(text)), bool(_THAI.search(text))
    out: list[int] = []
    for (a, p), marks in zip(parts, all_marks):
        spans = [m.span() for m in _QUOTE.finditer(p)] if _OPENS.search(p) else []
        start = 0
        for k in _candidates(p, marks) if thai else marks:
            e = k.end
            if e <= start or e >= len(p):
                continue
            if _boundary(p, start, k, spans, own, corpus, greek, sure):
                out.append(a + e)
                start = e
                while start < len(p) and p[start].isspace():
                    start += 1
        out.append(a + len(p))
    return out


def _candidates(p: str, marks: list[Mark]) -> list[Mark]:
    """Terminators, and in a paragraph with Thai letters blanks."""
    if not _THAI.search(p):
        return marks
    at = {k.end for k in marks}
    blanks = [Mark(p, m.start() - 1, m.start()) for m in re.finditer(r"(?<=\S)\s+(?=\S)", p) if m.start() not in at]
    return sorted([*marks, *blanks], key=lambda k: k.end)


def _boundary(p: str, start: int, k: Mark, spans: list, own: Facts, corpus: Facts, greek: bool, sure: int) -> bool:
    """Whether a sentence that began at ``start`` ends with the mark ``k``."""
    e, c = k.end, k.c
    if e - start < 12 and _MARK.fullmatch(p, start, e):
        return False
    last = p[e - 1]
    if p[e].isspace() and last not in _ANY_END:
        near = _THAI.search(p[max(0, e - 12) : e]) and _THAI.search(p[e : e + 14]) or _THAI.match(c)
        return bool(near)
    stop = p[k.start : e].rstrip(_CLOSERS)[-1:] or last
    if c.islower() and stop not in "。！？｡।॥;;":
        return False
    for s, t in spans:
        if s < e < t:
            return False
        if t == e:
            break
    spaced = k.at > e
    if stop in ";;":
        return greek and spaced
    if stop in "。！？｡।॥":
        return last not in "”」』\"»"
    if m := k.numbered():
        head = p[m.end() : m.end() + 4].lstrip("„“\"«「")[:1]
        if head.isupper() or not (head.islower() or head.isupper()):
            return True
    if stop == "." and _DEVANAGARI.search(p, max(start, k.start - 2), k.start):
        return False
    if _THAI.search(p[max(0, e - 2) : e]) or (stop == "." and _CASELESS.match(c)):
        return stop in "!?" or bool(_THAI.match(c)) and spaced
    if c in ",;:%)–—":
        return False
    if last in "”“’»\"":
        return not _CASELESS.match(c)
    if stop in "!?":
        return True
    opens = c in "„“\"«("
    if stop == "…" or last in ")]":
        return c.isupper() or opens or c.isdigit()
    w = k.word
    body = p[token_start(p, k.start, start) : k.start].lstrip("(„“\"«「【")
    if not spaced and not (c in "„“«" or c.isupper() and len(w) > 1 and w[1:2].islower() and len(body) > 2 or c.isupper() and len(w) == 1 and body[-3:].isalpha() and len(body) > 3):
        return False
    # a name inside a sentence may begin another one, so the document only confirms before the corpus is asked
    starts = lambda: _first(True if own.n.get(("start", w)) else None, corpus.starter(w), own.starter(w))
    code = w.isupper() and len(w) > 1
    if body[-1:].isdigit():
        if c.isdigit():
            return False
        amount = len(body) - len(body.rstrip("0123456789")) > 3 or any(x in body[:-1] for x in ".,/")
        return opens or (amount or starts() is not False) and not (code and not starts())
    key = k.key
    if not key:
        return c.isupper() or opens
    short = len(key) == 1 or "." in key
    # a short word with a period of its own next, that never began a sentence: two abbreviations in a row
    if len(w) <= (2 if short else 4) and len(key) <= LONGEST and p[k.at + len(w) : k.at + len(w) + 1] == ".":
        then = m[0] if (m := _INK.search(p, k.at + len(w) + 1)) else ""
        if short or (then.islower() or then.isdigit()) and not starts():
            return False
    if not (short or corpus.known(key, sure) or own.abbreviation(key, 10**9)):
        return True
    closes = _first(True if own.n.get(("end", key)) else None, corpus.ender(key))
    if c.isdigit() or _CODE.search(w) or closes is False or code:
        return False
    if opens:
        return c != "("
    return starts() is True or bool(closes) and starts() is not False


_GATHERED = "what string, word string, n long"


def gathered(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, what, word, n) from one pass over all texts: facts counted inside each batch (doc is null), and for every document what it asks for."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told: list[set] = []
            facts = observe(*b["t"], told=told)
            rows = [(None, what, word, n) for (what, word), n in facts.items()]
            rows += [(d, what, word, 1) for d, ws in zip(b["d"], told) for what, word in ws]
            yield pd.DataFrame(rows, columns=["doc", "what", "word", "n"], dtype=object)

    has = df.where(F.col(text).rlike(r"\S")).select(F.col(key).alias("d"), F.col(text).alias("t"))
    return has.mapInPandas(run, f"doc {kind}, {_GATHERED}")


def corpus_facts(df: DataFrame, text: str = "text") -> DataFrame:
    """(what, word, n) over all documents; counted inside each batch before the shuffle."""
    got = gathered(df.withColumn("_k", F.lit(0)), "_k", text)
    return got.where("doc IS NULL").groupBy("what", "word").agg(F.sum("n").alias("n"))


def learnt(df: DataFrame, key: str = "doc_id", text: str = "text", least_share: float = 1e-5, sure: int = 8) -> tuple[Facts, DataFrame]:
    """Corpus facts for all workers, and (doc, told): facts about rarer words as lines for the documents that ask for them.

    Of the rarer words before periods only those matter that may be abbreviations: with evidence, with ``sure`` periods or short.
    """
    rows = checkpointed(gathered(df, key, text))
    facts = rows.where("what IN ('dot', 'abbr', 'end', 'plain', 'start', 'mid')").groupBy("what", "word").agg(F.sum("n").alias("n"))
    n = lambda w: F.sum(F.when(F.col("what") == w, F.col("n")).otherwise(0)).alias(w)
    words = checkpointed(facts.groupBy("word").agg(*[n(w) for w in ("dot", "abbr", "end", "plain", "start", "mid")]).where("dot > 0 OR start > 0 OR mid > 0"))
    total = words.agg(*[F.sum(c).alias(c) for c in ("dot", "start", "mid")]).first()
    least = {c: max(1.0, (total[c] or 0) * least_share) for c in ("dot", "start", "mid")}
    words = words.withColumn("key_often", F.col("dot") >= least["dot"]).withColumn("next_often", (F.col("start") >= least["start"]) | (F.col("mid") >= least["mid"]))
    got: dict[tuple[str, str], int] = {}
    for r in words.where("key_often OR next_often").toLocalIterator():  # at most 3 / least_share words
        for c in (("dot", "abbr", "end", "plain") if r["key_often"] else ()) + (("start", "mid") if r["next_often"] else ()):
            if r[c]:
                got[c, r["word"]] = r[c]
    line = lambda *cs: F.concat_ws("\n", *[F.when(F.col(c) > 0, F.concat(F.lit(f"{c}\t"), "word", F.lit("\t"), c)) for c in cs])
    may = (F.col("abbr") > 0) | (F.col("dot") >= sure) | (F.length("word") == 1) | F.col("word").contains(".")
    rare = words.where(~F.col("key_often") & (F.col("dot") > 0) & may).select(F.lit("key").alias("what"), "word", line("dot", "abbr", "end", "plain").alias("line"))
    rare = rare.unionByName(words.where("NOT next_often AND start + mid > 0").select(F.lit("next").alias("what"), "word", line("start", "mid").alias("line")))
    often = words.select(F.explode(F.array(F.when(F.col("key_often"), F.lit("key")), F.when(F.col("next_often"), F.lit("next")))).alias("what"), "word").where("what IS NOT NULL")
    wants = rows.where("what IN ('key', 'next')").select("doc", "what", "word").join(small_side(often, 1_000_000), ["what", "word"], "left_anti")
    told = wants.join(rare, ["what", "word"]).groupBy("doc").agg(F.concat_ws("\n", F.collect_set("line")).alias("told"))
    return Facts(got), checkpointed(told)


def _lines(told: str) -> dict[tuple[str, str], int]:
    parts = [x.split("\t") for x in told.split("\n")]
    return {(what, word): int(n) for what, word, n in parts}


def split(df: DataFrame, key: str = "doc_id", text: str = "text", facts: Facts | None = None) -> DataFrame:
    """(key, sentence_no, end_pos): one row per sentence of every document."""
    has = df.where(F.col(text).rlike(r"\S")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    if facts is None:
        facts, told = learnt(df, key, text)
        has = has.join(small_side(told.select(F.col("doc").alias("k"), "told")), "k", "left")
    else:
        has = has.withColumn("told", F.lit(None).cast("string"))
    share = df.sparkSession.sparkContext.broadcast(facts.n)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus = Facts(share.value)
        for b in batches:
            rows = [(k, i, e) for k, t, x in zip(b["k"], b["t"], b["told"]) for i, e in enumerate(ends(t, Told(_lines(x), corpus) if x else corpus))]
            yield pd.DataFrame(rows, columns=[key, "sentence_no", "end_pos"])

    return has.mapInPandas(run, f"{key} {kind}, sentence_no int, end_pos int")
