"""Several values packed in one field, to one value per row.

1. *Skeletons.* Each cell is reduced to the characters that can delimit, quote or mark list items;
   every run of ordinary characters becomes ``a`` and repeated units collapse to one, so that the
   number of distinct skeletons depends on the packing habits, not on the number of cells.
2. *Rules.* A splitting rule (delimiter, quote, list mark, JSON) is resolved once per distinct
   skeleton; the rules are counted and broadcast (or joined by shuffle when they are many).
3. *Extraction.* Cells are cut by position with the rule of their skeleton.
4. *Check against the text the values come from* (optional): pieces whose concatenation with the
   delimiter between them stands in the text are one value (a semicolon of the sentence itself).

Edge cases: null, empty and blank cells, and cells of delimiters alone, give no rows; empty values
are dropped and not counted; a row delivered again gives its values once; without the text the
rule alone decides; very long cells are cut in one linear pass.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed, small_side

#: fixed values: delimiter characters in the order in which a rule prefers them
BARS = ("｜", "¦", "|", "\t")
#: fixed values: separators that may cut a value again, in the order in which they are tried
SPARE = (";", "|", "\n", "\t", "/", "@")

_PRINTED = {0xE001: "#", 0xE002: "*", 0xE003: "@", 0xE004: "Q", 0xE005: "/"}
_INLINE = re.compile(r"(?<!\S)\((\d{1,3})\)\s")
_LINE_MARK = re.compile(r"^\s*(?:[-*•–]\s+|\(\d{1,3}\)\s*|\d{1,3}[.)]\s+)")


def skeleton(cell: str) -> str:
    """The cell's delimiters with ordinary runs masked; list marks become ``#``, bullets ``*``, inline numbers ``@``."""
    t = _hide(cell.strip())
    if t[:1] == "[" and t[-1:] == "]":
        return "[]"
    s = re.sub(r"(^|\n)[ \t]*(?:\(\d{1,3}\)|\d{1,3}[.)])[ \t]+", "\\1\ue001", t)
    s = re.sub(r"(^|\n)[ \t]*[-*•–][ \t]+", "\\1\ue002", s)
    s = re.sub(r"\s\(\d{1,3}\)\s", "\ue003", s)
    s = re.sub("(^|[|｜¦;\t\n\ue001-\ue003]) *[\"']", "\\1\ue004", s)
    s = re.sub("[\"'] *(?=$|[|｜¦;\t\n\ue003])", "\ue004", s)
    s = s.replace(" / ", "\ue005")
    s = re.sub("[^|｜¦;\t\n\ue001-\ue005]+", "a", s)
    while (n := re.sub(r"(.{1,6}?)\1+", r"\1", s, flags=re.S)) != s:
        s = n
    return s.translate(_PRINTED)


def rule(skel: str) -> str:
    """The splitting rule of a skeleton: ``json``, or kinds of separators joined by ``,`` in the order of use.

    After a blank come the separators that the skeleton holds at all; only they may cut a value again that does not
    stand in the text.
    """
    if skel == "[]":
        return "json"
    kinds = [b for b in BARS if b in skel]
    if "\n" in skel:
        kinds.append("\n")
    if re.search(r"Q;a?Q", skel):
        kinds.append("q;")
    elif ";" in skel and not kinds:
        kinds.append(";")
    elif ";" in skel:
        kinds.append(";?")
    if "#" in skel[:1] and "@" in skel:
        kinds.append("@")
    spare = [k for k in SPARE if k in skel]
    named = lambda ks: ",".join({"\t": "tab", "\n": "nl"}.get(k, k) for k in ks)
    return f"{named(kinds) or 'one'} {named(spare)}".strip()


def _hide(t: str) -> str:
    """Delimiters escaped by a backslash, out of the way of splitting."""
    return re.sub(r"\\([|｜¦;\t\n])", lambda m: chr(0xE100 + ord(m[1]) % 256), t) if "\\" in t else t


def _show(t: str) -> str:
    return re.sub("[\ue100-\ue1ff]", lambda m: _HIDDEN[m[0]], t)


#: escaped delimiters by the private character that hides them
_HIDDEN = {chr(0xE100 + ord(c) % 256): c for c in "|｜¦;\t\n"}


def _unquote(v: str) -> str:
    v = v.strip()
    v = _LINE_MARK.sub("", v, count=1).strip() if _LINE_MARK.match(v) else v
    for q in "\"'":
        if len(v) > 1 and v[0] == q and v[-1] == q:
            inner = v[1:-1]
            bare = inner.replace(q * 2, "").replace("\\" + q, "")
            if q not in bare or q * 2 in inner or bare.count(q) % 2 == 0:
                v = inner.replace(q * 2, q).replace("\\" + q, q)
                break
    return v.strip()


def _quoted_split(text: str, delimiter: str) -> list[str]:
    """Cut at ``delimiter`` outside quotes that open right after a delimiter and close right before one; one pass.

    An odd run of quotes before a delimiter closes (pairs are escaped quotes); without one the last even run does,
    and without that the quote is an ordinary character.
    """
    n = len(text)

    def past_blanks(i: int) -> int:
        while i < n and text[i] != delimiter and text[i].isspace():
            i += 1
        return i

    runs = [m.span() for m in re.finditer('"+', text)]
    stops = [past_blanks(b) for _, b in runs]
    closing = [k == n or text[k] == delimiter for k in stops]
    following, even = [-1] * (len(runs) + 1), -1
    for r in range(len(runs) - 1, -1, -1):
        odd = (runs[r][1] - runs[r][0]) % 2
        following[r] = r if closing[r] and odd else following[r + 1]
        if closing[r] and not odd and even < 0:
            even = r
    out, at, r = [], 0, 0
    while True:
        i, end = past_blanks(at), -1
        if i < n and text[i] == '"':
            while runs[r][0] < i:
                r += 1
            own = runs[r][1] - runs[r][0] - 1  # quotes after the opening one
            close = r if closing[r] and own % 2 else following[r + 1] if following[r + 1] >= 0 else even if even > r else r if closing[r] and own else -1
            end = stops[close] if close >= 0 else -1
        if end < 0:
            end = text.find(delimiter, i)
            end = n if end < 0 else end
        out.append(text[at:end])
        if end >= n:
            return out
        at = end + 1


def split_cell(cell: str, how: str) -> list[tuple[str, str]]:
    """(delimiter before, value) of a cell under a rule; values stripped of blanks, marks, quoting and escapes."""
    t = cell.strip()
    how = how.split(" ")[0]
    if how == "json":
        try:
            got = json.loads(t)
            return [("[", _text(x)) for x in got if x is not None]
        except (ValueError, TypeError):
            how = "one"
    pieces = [("", _hide(t))]
    for kind in how.split(","):
        if kind in ("one", ";?"):
            continue
        sep = {"tab": "\t", "nl": "\n", "q;": ";"}.get(kind, kind)
        nxt = []
        for before, p in pieces:
            if kind == "@":
                cut = [m.start() for m in _INLINE.finditer(p)]
                parts = [p[a:b] for a, b in zip([0, *cut], [*cut, len(p)])] if cut else [p]
            elif '"' in p and kind in ("q;", *BARS):
                parts = _quoted_split(p, sep)
            else:
                parts = p.split(sep)
            nxt += [(sep if i else before, x) for i, x in enumerate(parts)]
        pieces = nxt
    return [(d, _show(p)) for d, p in pieces]


def _text(x: object) -> str:
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _squeeze(s: str) -> str:
    return " ".join(s.split())


def _fits(v: str, context: str) -> bool:
    return bool(v) and v in context


def values_of(cell: str | None, how: str, context: str | None) -> list[str]:
    """The values of a cell. With ``context`` neighbouring pieces whose concatenation stands in it are one value."""
    if cell is None or not cell.strip():
        return []
    pieces = split_cell(cell, how)
    spare = tuple({"tab": "\t", "nl": "\n"}.get(k, k) for k in how.partition(" ")[2].split(",") if k)
    if not context:
        return [v for _, p in pieces if (v := _unquote(p) if how != "json" else p.strip())]
    flat = _squeeze(context)
    if how == "json":
        return [v for _, p in pieces if (v := p.strip())]
    out = _joined(pieces, flat)
    if ";?" in how and not all(_fits(_squeeze(v), flat) for v in out):
        finer = _joined([(";" if i else d, x) for d, p in pieces for i, x in enumerate(p.split(";"))], flat)
        if all(_fits(_squeeze(v), flat) for v in finer):
            return finer
    return [w for v in out for w in ([v] if _fits(_squeeze(v), flat) else _recut(v, flat, spare))]


#: a spare separator as it stands in a cell, with its blanks first
_AS_CUT = {";": ("; ", ";"), "|": (" | ", "|"), "/": (" / ",)}


def _begins(raw: str, flat: str) -> bool:
    """Whether some place of the text starts like ``raw``, its list mark and an opening quote aside: if not, no longer run can stand there."""
    t = _LINE_MARK.sub("", raw.lstrip() + " ", count=1).lstrip()
    if _squeeze(t) in flat:
        return True
    q = t[:1]
    return q in ("\"", "'") and _squeeze(t[1:].replace(q * 2, q).replace("\\" + q, q)) in flat


def _joined(pieces: list[tuple[str, str]], flat: str) -> list[str]:
    """Pieces put together to the longest runs that stand in the text."""
    out: list[str] = []
    i = 0
    while i < len(pieces):
        raw, best, j = pieces[i][1], _unquote(pieces[i][1]), i + 1
        end = j
        while j < len(pieces) and pieces[j][1].strip() and _begins(raw, flat):
            if pieces[j][0] == "\n" and _fits(_squeeze(best), flat) and _fits(_squeeze(_unquote(pieces[j][1])), flat):
                break
            raw = raw + pieces[j][0] + pieces[j][1]
            j += 1
            v = _unquote(raw)
            if _fits(_squeeze(v), flat):
                best, end = v, j
        i = end
        if best:
            out.append(best)
    return out


def _recut(v: str, flat: str, spare: tuple[str, ...] = SPARE) -> list[str]:
    """A piece that is not in the text: cut it further at separators that its skeleton holds, if all parts then are."""
    for sep in (x for k in spare for x in _AS_CUT.get(k, (k,))):
        if sep == "@":
            parts = re.split(r"(?:^|\s)\(\d{1,3}\)\s", v)
        else:
            parts = v.split(sep)
        joined, k = [], 0
        while k < len(parts):
            raw, best, end = "", "", k
            for e in range(k, len(parts)):
                raw = parts[e] if e == k else raw + sep + parts[e]
                w = _unquote(raw)
                if _fits(_squeeze(w), flat):
                    best, end = w, e + 1
                elif not _begins(raw, flat):
                    break
            if best:
                joined.append(best)
                k = end
            elif parts[k].strip():
                joined = []
                break
            else:
                k += 1
        if joined and len(parts) > 1:
            return joined
    return [v]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [
            (k, f, n, v)
            for k, f, c, how, ctx in zip(b["key"], b["field_name"], b["cell"], b["how"], b["context"])
            for n, v in enumerate(values_of(c, how, ctx))
        ]
        yield pd.DataFrame(rows, columns=["key", "field_name", "value_no", "quote"])


def cells(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, cell) of the non-blank cells, rows delivered again removed."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in fields])
    out = df.select(F.col(key).alias("key"), F.explode(pairs).alias("x")).select("key", "x.*")
    return out.where(F.col("cell").rlike(r"\S")).dropDuplicates(["key", "field_name", "cell"])


def skeletons(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(skeleton, how, n_cells): the rule resolved for each distinct skeleton."""
    skel = F.pandas_udf(lambda s: s.map(skeleton), "string")
    how = F.pandas_udf(lambda s: s.map(rule), "string")
    found = cells(df, key, fields).groupBy(skel("cell").alias("skeleton")).agg(F.count("*").alias("n_cells"))
    return found.withColumn("how", how("skeleton"))


def unpack(df: DataFrame, key: str, fields: list[str], context: DataFrame | None = None) -> DataFrame:
    """(key, field_name, value_no, quote). ``context``: (key, context[, at]), the text in which the values stand; the latest delivery that has one counts."""
    skel = F.pandas_udf(lambda s: s.map(skeleton), "string")
    masked = cells(df, key, fields).withColumn("skeleton", skel("cell"))
    rules = checkpointed(skeletons(df, key, fields).select("skeleton", "how"))
    ruled = masked.join(small_side(rules), "skeleton")
    if context is None:
        ruled = ruled.withColumn("context", F.lit(None).cast("string"))
    else:
        wanted = df.select(F.col(key).alias("key")).distinct()
        newest = F.struct(F.col("at") if "at" in context.columns else F.lit(0), "context")
        has = context.where("context IS NOT NULL").join(wanted, "key", "left_semi")
        kept = has.groupBy("key").agg(F.max_by("context", newest).alias("context"))
        ruled = ruled.join(kept, "key", "left")
    out = ruled.select("key", "field_name", "cell", "how", "context")
    return out.mapInPandas(_extract, "key string, field_name string, value_no int, quote string").distinct()
