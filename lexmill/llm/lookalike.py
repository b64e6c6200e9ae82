"""Visually identical text in one form: a skeleton by decomposing, replacing look-alikes, decomposing again.

``skeleton`` decides whether two texts look the same; it is for comparing alone. ``one_form`` is for reading: a function of
the skeleton, so equal for equal-looking texts, in which words of another script get that script's letters back. Differences
a reader sees - an accent, a digit, a capital - are kept: only characters outside ASCII are replaced, and never one ASCII
character by another.

Edge cases: null stays null, the empty text empty; order and kind of combining marks are canonical;
white space of every kind but the line feed is a blank, invisible characters vanish; blanks at the
ends of lines and runs of blanks count once, as no reader of the print can tell them apart.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed

#: fixed values: letters of other scripts and the Latin letters they look like, pairwise
LOOKALIKES = {
    "cyrillic": ("аеорсухіјѕԁһԛԝьѵАВЕКМНОРСТУХІЈЅԌԚԜ", "aeopcyxijsdhqwbvABEKMHOPCTYXIJSGQW"),
    "greek": ("οανικρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavikpuABEZHIKMNOPTYX"),
    "armenian": ("օսհոզՍՕԼ", "ouhnqUOL"),
    "cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏏᏒᏔᏙᏚᏞᏟᏢᏦᏴᎩ", "DRTAJEWMHGZbRWVSLCPKBY"),
    "coptic": ("ⲞⲟⲤⲥⲢⲣⲘⲚⲔⲎⲦⲬ", "OoCcPpMNKHTX"),
    "lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "latin": ("ɑɡıſꞌ", "agif'"),
    "marks": ("‐‑‒﹣－ʼ′＇", "----'''" + "'"),
}


#: code points that may be replaced: all planes' symbols and letters but ideographs, Hangul and private use
_RANGE = [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0100)]


def _table() -> dict[int, str | None]:
    """The look-alike table from rules: compatibility forms of the same shape, the pairs above, blanks, invisibles."""
    out: dict[int, str | None] = {}
    for c in map(chr, _RANGE):
        kind = unicodedata.category(c)
        tag = unicodedata.decomposition(c).partition(">")[0]
        if kind == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or c == "͏":
            out[ord(c)] = None
        elif kind == "Zs":
            out[ord(c)] = " "
        elif tag in ("<wide", "<narrow", "<font", "<compat", "<noBreak", "<initial", "<medial", "<final", "<isolated"):
            flat = unicodedata.normalize("NFKD", c)
            if not flat.startswith(" "):
                out[ord(c)] = flat
    del out[ord("…")]
    for like, latin in LOOKALIKES.values():
        out |= {ord(a): b for a, b in zip(like, latin)}
    return out


TABLE = _table()
#: characters that are replaced, or hold one that is
_TOUCHED = "".join(c for c in map(chr, _RANGE) if any(ord(d) in TABLE for d in unicodedata.normalize("NFD", c)) or ord(c) in TABLE)
#: one pattern per plane, as classes within the basic plane are matched by table
_ODD = re.compile("[" + re.escape("".join(c for c in _TOUCHED if c < "\U00010000")) + "]")
_ASTRAL = re.compile("[\U0001d400-\U0001d7ff\U000e0000-\U000e00ff]")
_BLANKS = re.compile(r"[ \t\r\f\v]{2,}|[\t\r\f\v]")


def replaced(text: str) -> str:
    """Decomposed, every character replaced by its prototype, decomposed again and composed.

    A text without any character of the table is only composed, which gives the same.
    """
    if text.isascii():
        return text
    if _ODD.search(text) or _ASTRAL.search(text):
        text = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(TABLE))
    return unicodedata.normalize("NFC", text)


def skeleton(text: str | None) -> str | None:
    """Equal for two texts exactly if they look the same."""
    if text is None:
        return None
    t = _BLANKS.sub(" ", replaced(text))
    if " \n" in t or "\n " in t:
        t = t.replace(" \n", "\n").replace("\n ", "\n")
    return t.strip()


#: scripts whose letters a skeleton may have lost, the letters that only they have, and what their look-alikes are called back to
_SCRIPTS = {"cyrillic": "Ѐ-ԯ", "greek": "Ͱ-Ͽἀ-῾", "armenian": "԰-֏", "cherokee": "Ꭰ-Ᏽꭰ-ꮿ", "coptic": "Ⲁ-⳿", "lisu": "ꓐ-꓿"}
_OWN = {n: re.compile(f"[{r}]") for n, r in _SCRIPTS.items()}
_BACK = {n: {ord(b): a for a, b in reversed([*zip(*LOOKALIKES[n])])} for n in _SCRIPTS}
_LETTERS = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")


def one_form(text: str | None) -> str | None:
    """The form in which equal-looking texts are equal, for reading.

    A word of the skeleton that holds letters of one other script alone is written in that script throughout. A word of
    Latin letters that all look like letters of the script is too, where the script has more letters of its own in the
    text than Latin has letters that the script lacks.
    """
    t = skeleton(text)
    if not t or t.isascii():
        return t
    main = [n for n, own in _OWN.items() if own.search(t)]
    if not main:
        return t
    t = unicodedata.normalize("NFD", t)
    counts = {n: len(_OWN[n].findall(t)) for n in main}
    best = max(main, key=lambda n: counts[n])
    latin = sum(1 for c in t if c.isalpha() and c.isascii() and ord(c) not in _BACK[best])

    def word(m: re.Match) -> str:
        w = m[0]
        of = [n for n in main if _OWN[n].search(w)]
        if len(of) == 1:
            return w.translate(_BACK[of[0]])
        bare = [c for c in w if c.isalpha()]
        if not of and counts[best] > latin and all(ord(c) in _BACK[best] for c in bare):
            return w.translate(_BACK[best])
        return w

    return unicodedata.normalize("NFC", _LETTERS.sub(word, t))


def skeleton_col(text: F.Column | str) -> F.Column:
    return F.pandas_udf(lambda s: s.map(skeleton, na_action="ignore"), "string")(text)


def with_one_form(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``one_form``: the text in its consistent form."""
    return df.withColumn("one_form", F.pandas_udf(lambda s: s.map(one_form, na_action="ignore"), "string")(text))


def _digests(skeletons: F.Column, raw: F.Column) -> F.Column:
    return F.struct(F.xxhash64(skeletons).alias("look"), F.crc32(F.encode(skeletons, "UTF-8")).alias("look2"), F.xxhash64(raw).alias("chars"))


def classes(df: DataFrame, key: str, text: F.Column) -> DataFrame:
    """(key, look, look2, chars): each key once per text, with the hash of its skeleton and of its characters.

    Only hashes travel, never texts.
    """
    has = df.select(F.col(key).alias("key"), text.alias("_text")).where(F.col("key").isNotNull() & F.col("_text").rlike(r"(?U)\S"))
    skel = has.select("key", "_text", skeleton_col("_text").alias("_look")).where("_look <> ''")
    return skel.select("key", _digests(F.col("_look"), F.col("_text")).alias("d")).select("key", "d.*").distinct()


#: keys of one look that one task pairs with all keys of that look
SALTED = 2_000


def same_look_pairs(df: DataFrame, key: str, text: F.Column) -> DataFrame:
    """(key_a, key_b), key_a < key_b: keys whose texts look the same but differ in characters.

    Skeletons with one stored form are dropped before the join, so a large group of exact copies
    costs one row per copy and no comparison; what is joined are different stored forms of one look. The keys of a
    large look are spread over salts of about ``SALTED`` keys, each of which meets all keys of the look. The rows are
    all pairs, as asked; where they are too many, ``form_pairs`` and ``groups`` say the same in rows that grow with the keys.
    """
    each = checkpointed(classes(df, key, text))
    forms = each.groupBy("look", "look2").agg(F.min("chars").alias("a"), F.max("chars").alias("b"), F.count("*").alias("n")).where("a <> b")
    salts = F.ceil(F.col("n") / SALTED).cast("int")
    mixed = each.join(forms.select("look", "look2", salts.alias("salts")), ["look", "look2"])
    a = mixed.select("look", "look2", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), F.col("key").alias("key_a"), F.col("chars").alias("chars_a"))
    b = mixed.select("look", "look2", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("key").alias("key_b"), F.col("chars").alias("chars_b"))
    return a.join(b, ["look", "look2", "salt"]).where("chars_a <> chars_b AND key_a < key_b").select("key_a", "key_b").distinct()


def form_pairs(df: DataFrame, key: str, text: F.Column) -> DataFrame:
    """(group_id, form_a, form_b, n_a, n_b): each stored form of a look, by its smallest key, against the look's first form. Other forms of a look are linked through that one."""
    each = checkpointed(classes(df, key, text))
    forms = each.groupBy("look", "look2", "chars").agg(F.min("key").alias("form"), F.count("*").alias("n"))
    first = forms.groupBy("look", "look2").agg(F.min(F.struct("form", "chars", "n")).alias("f"))
    return forms.join(first, ["look", "look2"]).where("chars <> f.chars").select(F.col("f.form").alias("group_id"), F.col("f.form").alias("form_a"), F.col("form").alias("form_b"), F.col("f.n").alias("n_a"), F.col("n").alias("n_b"))


def groups(df: DataFrame, key: str, text: F.Column) -> DataFrame:
    """(key, group_id, n_keys, n_forms): every key with the class of its look; group_id is the smallest key."""
    each = checkpointed(classes(df, key, text))
    size = each.groupBy("look", "look2").agg(F.min("key").alias("group_id"), F.count("*").alias("n_keys"), F.countDistinct("chars").alias("n_forms"))
    return each.join(size, ["look", "look2"]).select("key", "group_id", "n_keys", "n_forms").distinct()


def pages_text(pages: F.Column | str) -> F.Column:
    """Pages in order as one text; a null page reads as an empty one. Empty if no page has text."""
    flat = F.transform(F.coalesce(F.col(pages) if isinstance(pages, str) else pages, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")))
    return F.when(F.exists(flat, lambda p: p.rlike(r"(?U)\S")), F.array_join(flat, "\n\u0001\n"))
