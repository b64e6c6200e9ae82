"""Cleaning, extraction and token functions as columns. Null texts read as empty unless said otherwise."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import CONTRACTS, FEATURES, STOPWORDS

#: white space as Unicode has it, without flags that engines read differently
WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}]"
_WORD = r"[\p{L}\p{N}_]"


def portable(pattern: str, sql: bool = False) -> str:
    """A pattern with Unicode classes written out; ``sql``: in the dialect without flags for Unicode folding."""
    out = _spaces(pattern).replace(r"\w", _WORD)
    return out if sql else out.replace("(?i)", "(?iu)")


def _spaces(p: str) -> str:
    out, inside, i = "", False, 0
    while i < len(p):
        c = p[i : i + 2]
        if c == r"\s" and not inside:
            out += WS
            i += 2
            continue
        if p[i] == "\\":
            out += WS[1:-1] if c == r"\s" else c
            i += 2
            continue
        inside = p[i] == "[" or inside and p[i] != "]"
        out += p[i]
        i += 1
    return out


def _c(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def strip(x: Column | str) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(_c(x), f"^{WS}+|{WS}+$", "")


def nfc(x: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore"), "string")(x)


def clean_light(x: Column | str) -> Column:
    """Composed, without zero-width space and soft hyphen, line feeds alone as line ends."""
    return F.replace(F.replace(F.translate(nfc(_c(x)), "​­", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def drop_pagination(x: Column | str) -> Column:
    """Without lines that hold only ``strana N [z M]``, ``- N -`` or ``pokračovanie``; bare numbers stay."""
    def furniture(line: Column) -> Column:
        s = strip(line)
        return s.rlike(rf"^(?iu)strana{WS}+\d+({WS}*z{WS}*\d+)?$") | s.rlike(rf"^-{WS}*\d+{WS}*-$") | s.rlike(rf"^(?iu)pokračovanie{WS}*\.{{0,3}}$")

    return F.array_join(F.filter(F.split(_c(x), "\n"), lambda line: ~furniture(line)), "\n")


def join_pages(pages: Column | str) -> Column:
    """Pages without outer white space, joined by line feeds; null pages are empty."""
    p = F.col(pages) if isinstance(pages, str) else pages
    return F.array_join(F.transform(F.coalesce(p, F.array().cast("array<string>")), strip), "\n")


_HEADING = rf"\n{WS}*(?iu:ROZSUDOK|UZNESENIE|ROZSUDOK{WS}+V{WS}+MENE{WS}+SLOVENSKEJ{WS}+REPUBLIKY){WS}*\n"


def split_header(x: Column | str) -> Column:
    """struct(header, body): at the first heading line, else after the ECLI line, else after 1000 characters."""
    t = _c(x)
    head, ecli = F.regexp_substr(t, F.lit(_HEADING)), F.regexp_substr(t, F.lit(r"ECLI:[^\n]+\n"))
    h = F.instr(t, head) - 1
    e = F.instr(t, ecli) - 1 + F.length(ecli)
    at = F.when(head.isNotNull(), h).when(ecli.isNotNull(), e).otherwise(F.lit(1000))
    a, b = F.substring(t, F.lit(1), at), F.substring(t, at + 1, F.length(t))
    cut = head.isNull() & ecli.isNull()
    return F.struct(F.when(cut, a).otherwise(strip(a)).alias("header"), F.when(cut, b).otherwise(strip(b)).alias("body"))


# Fixed value: what counts as a word printed letter by letter.
_SPACED = re.compile(r"(?<!\S)((?:[a-zA-ZÁ-Žá-ž]\s){2,}[a-zA-ZÁ-Žá-ž])(?=[\s.,;:!?()\[\]]|$)")


def despaced(text: str) -> str:
    """Words printed letter by letter, closed up."""
    return _SPACED.sub(lambda m: m[1].replace(" ", ""), text)


def fix_spaced_words(x: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(despaced), "string")(_c(x))


def is_spaced_header(x: Column | str) -> Column:
    s = F.trim(F.regexp_replace(_c(x), r"[.:]+$", ""))
    return (F.char_length(s) >= 5) & s.rlike(rf"^{WS}*(?:[a-zA-ZÁ-Žá-ž]{WS}+){{3,}}[a-zA-ZÁ-Žá-ž]{WS}*$")


# Words after which a line goes on.
_TITLES = "judr mgr ing mudr phdr rndr bc doc prof akad thlic paeddr".split()
_GOES_ON = re.compile(
    r"(?:(?:\bods\.|písm\.|č\.|č\.k\.|č\.\s*k\.|čl\.|\bsp\.|\bzn\.|\bsp\.\s*zn\.|z\.\s*z\.|\bzb\.|\bresp\.|\bnapr\.|\btzn\.|\btzv\.|\bt\.j\.|" + "|".join(rf"{t}\." for t in _TITLES) + r")\s*|(?:\s|^)(?:v|z|zo|k|ku|o|po|pri|pre|na|do))$",
    re.I,
)
# List items, and lines printed letter by letter.
_LIST_ITEM = re.compile(r"^(?:[a-z]\)|\d+\.(?!\s*\d)|•)\s")
_SPACED_LINE = re.compile(r"^\s*(?:[a-zA-ZÁ-Žá-ž]\s+){3,}[a-zA-ZÁ-Žá-ž]\s*$")


def _continues(buf: str, line: str) -> bool:
    """Whether ``line`` goes on the text in ``buf``: rules that join come before rules that part."""
    if _GOES_ON.search(buf) or buf[-1:].isdigit() and re.match(r"-\s*\d", line):
        return True
    bare = line.rstrip(".:").strip()
    ended = buf[-1:] in ".?!"
    if len(bare) >= 5 and _SPACED_LINE.match(bare) or buf.strip().upper().endswith("SLOVENSKEJ REPUBLIKY"):
        return False
    if _LIST_ITEM.match(line) and re.search(r"[.?!:;]\s*$", buf) or line[0].isupper() and ended:
        return False
    return not ended or line[0].islower()


def laid_out(text: str) -> str:
    """Lines put together to paragraphs parted by blank lines."""
    blocks, buf = [], ""
    for line in map(str.strip, text.split("\n")):
        if not line:
            if buf and re.search(r"[.?!:;]\s*$", buf) and not _GOES_ON.search(buf):
                blocks.append(buf)
                buf = ""
        elif not buf:
            buf = line
        elif buf.endswith("-"):
            buf = buf[:-1] + line
        elif _continues(buf, line):
            buf = f"{buf} {line}"
        else:
            blocks.append(buf)
            buf = line
    return despaced("\n\n".join(b for b in [*blocks, buf] if b.strip()))


def normalize_layout(x: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(laid_out), "string")(_c(x))


def advanced_unicode(x: Column | str, closers: str = r".,;:!?)") -> Column:
    """Dashes and curly quotes to plain ones, no white space before punctuation."""
    return F.regexp_replace(F.translate(_c(x), "–—„“”", '--"""'), rf"{WS}+([{re.escape(closers)}])", "$1")


def tight_punctuation(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), rf"{WS}+([.,;:!?)\]])", "$1")


def squash(x: Column | str) -> Column:
    """White space of any kind to one blank, none outside."""
    return F.trim(F.regexp_replace(_c(x), f"{WS}+", " "))


_FROM = "áäčďéěíľĺňóôőöŕřšťúůűüýžß"
_TO = "aacdeeillnoooorrstuuuuyzs"


def plain(x: Column | str) -> Column:
    """Lower case without accents, the section sign as ``ss``, blanks squeezed."""
    return squash(F.replace(F.translate(F.lower(_c(x)), _FROM, _TO), F.lit("§"), F.lit("ss")))


def spaced_word(word: str) -> str:
    """A pattern for a word whose letters may be printed apart."""
    return r"\s*".join(word)


def safe_filename(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r'[<>:"/\\|?*\s]+', "_")


def year_of(x: Column | str) -> Column:
    """The year prefix, 0 if there is none."""
    return F.coalesce(F.substring(_c(x), 1, 4).try_cast("int"), F.lit(0))


def spaced_number(x: Column | str) -> Column:
    return F.replace(F.format_number(F.col(x) if isinstance(x, str) else x, 0), F.lit(","), F.lit(" "))


def cut_at_blank(x: Column | str, most: int = 200) -> Column:
    """At most ``most`` characters, cut at the last blank among them."""
    t = _c(x)
    head = F.substring(t, 1, most)
    last = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.char_length(t) <= most, t).when(F.instr(head, " ") > 1, last).otherwise(head)


def header_meta(x: Column | str) -> Column:
    """struct(date_raw, case_id, ecli, court, document_type), null where nothing matches."""
    # The patterns of the members.
    t = _c(x)
    got = lambda p, g=1: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    kind = got(r"(?iu)(?<![\p{L}\p{N}_])(ROZSUDOK|UZNESENIE)(?![\p{L}\p{N}_])")
    return F.struct(
        F.replace(got(rf"(\d{{1,2}}\.{WS}*\d{{1,2}}\.{WS}*\d{{4}})"), F.lit(" ")).alias("date_raw"), got(rf"(?iu)Spisová{WS}*značka:?{WS}*([\p{{L}}\p{{N}}_/]+)").alias("case_id"), got(r"(ECLI:[A-Z0-9:.]+)").alias("ecli"),
        strip(got(rf"Súd:{WS}*([^\n]+)")).alias("court"), F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 99))).alias("document_type"),
    )


def segments(x: Column | str) -> Column:
    """struct(verdict, reasoning, instruction) by the first headings; without one all is verdict."""
    t = _c(x)
    apart = lambda w: rf"(?iu)(?:{'|'.join(w)})"
    why = apart([f"{WS}*".join(["[oó]", "d", "[oóô]", *"vodnenie"]), "odôvodnenie"])
    how = apart([f"{WS}*".join("poučenie"), "poučenie"])
    r = F.regexp_substr(t, F.lit(why))
    at = F.instr(t, r)
    rest = strip(F.substring(t, at, F.length(t)))
    i = F.regexp_substr(rest, F.lit(how))
    to = F.instr(rest, i)
    some = r.isNotNull()
    return F.struct(
        F.when(some, strip(F.substring(t, F.lit(1), at - 1))).otherwise(t).alias("verdict"),
        F.when(some & i.isNotNull(), strip(F.substring(rest, F.lit(1), to - 1))).when(some, rest).otherwise("").alias("reasoning"),
        F.when(some & i.isNotNull(), strip(F.substring(rest, to, F.length(rest)))).otherwise("").alias("instruction"),
    )


def pattern_counts(x: Column, bank: dict[str, str]) -> list[Column]:
    """A count column per named pattern."""
    return [F.regexp_count(x, F.lit(portable(p))).alias(n) for n, p in bank.items()]


def feature_bank(x: Column | str) -> list[Column]:
    return pattern_counts(plain(x), FEATURES)


def relevance_label() -> Column:
    """Five groups from the feature columns; the civil provision is tested first."""
    c = F.col
    return (
        F.when(c("has_oz_545a") > 0, "4_CIVIL_NOISE_LIKELY").when((c("has_penalty") > 0) & (c("has_301") > 0) & (c("has_moder_trig") > 0), "1_GOLD_MODERATION")
        .when((c("has_penalty") > 0) & (c("has_301") > 0), "2_STRONG_CANDIDATE").when(c("has_penalty") > 0, "3_PENALTY_NO_MODERATION").otherwise("5_IRRELEVANT")
    )


def contract_kinds(x: Column | str) -> Column:
    """All contract kinds whose trigger occurs, or the bucket of unknown ones."""
    t = plain(x)
    hits = F.filter(F.array(*[F.when(t.rlike(portable(p)), F.lit(n)) for n, p in CONTRACTS.items()]), lambda n: n.isNotNull())
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("unknown/other")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def positions(x: Column, pattern: str) -> Column:
    """Start positions (from 0) of all matches, as lengths of the text before them."""
    marked = F.regexp_replace(x, f"({portable(pattern)})", "\u0001$1")
    sizes = F.transform(F.split(marked, "\u0001"), lambda s: F.char_length(s))
    none = F.array().cast("array<int>")
    return let(sizes, lambda n: F.when(F.size(n) > 1, F.transform(F.sequence(F.lit(1), F.size(n) - 1), lambda i: F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda a, b: a + b))).otherwise(none))


def near(x: Column, a: str, b: str, within: int = 250) -> Column:
    """Whether a match of ``a`` starts within so many characters of one of ``b``. The nearest two stand side by side once all are sorted."""
    place = lambda pattern, side: F.transform(positions(x, pattern), lambda i: F.struct(i.alias("at"), F.lit(side).alias("side")))
    both = F.array_sort(F.concat(place(a, 0), place(b, 1)))
    close = lambda i, j: F.coalesce((i["side"] != j["side"]) & (j["at"] - i["at"] <= within), F.lit(False))
    return let(both, lambda m: F.exists(F.zip_with(m, F.slice(m, F.lit(2), F.greatest(F.size(m), F.lit(1))), close), lambda v: v))


def keyword_in_context(x: Column | str, pattern: str, window: int = 140) -> Column:
    """The first match between marks, with so many characters on either side; null without a match."""
    t = _c(x)
    hit = F.regexp_substr(t, F.lit(portable(pattern)))
    at = F.instr(t, hit)
    left = F.greatest(at - window, F.lit(1))
    return F.concat(F.substring(t, left, at - left), F.lit(">>>"), hit, F.lit("<<<"), F.substring(t, at + F.length(hit), F.lit(window)))


# Forms of the section, law numbers, other codes, signs of the commercial code.
_SECTION = re.compile(r"(?:§|par\.|ust\.|ustanoven\w+|paragraf\w*|odst\.|v\s+zmysle)\s*301\b", re.I)
_COMMERCIAL = re.compile(r"513\s*/\s*1991|Obchodn\w*\s+zák|obchodného\s+zákonník|ObZ\b|Obch\.?\s*zák", re.I)
_LAW_NUMBER = re.compile(r"301\s*[/.]\s*\d{3,4}")
_OTHER_CODE = re.compile(r"301[^0-9]{0,30}(CSP|C\.?\s*s\.?\s*p\.?|Civiln|Trest|Správ|Tr\.?\s*z\.?|T\.?\s*z\.?)", re.I)
_MODERATION = re.compile(r"(?:neprimeran|neúmern|znížen|znížil|moderač|primeran)[a-ž]*", re.I)
_PENALTY = re.compile(r"zmluvn[a-ž]*\s+pokut[a-z]*", re.I)


def section_status(text: str | None) -> tuple[str, str | None]:
    """(status, snippet): the section of the commercial code, else moderation words within 25 words of the penalty."""
    t = text or ""
    if len(t.strip()) < 50:
        return "SCAN_SKIPPED", None
    if _COMMERCIAL.search(t):
        for m in _SECTION.finditer(t):
            around = t[m.start() : m.end() + 40]
            if not _LAW_NUMBER.search(around) and not _OTHER_CODE.search(around):
                return "MATCH_PARAGRAF_301", t[max(0, m.start() - 120) : m.end() + 120]
    words = [m.span() for m in _MODERATION.finditer(t)]
    for a, b in (m.span() for m in _PENALTY.finditer(t)):
        for c, d in words:
            between = t[b:c] if c >= b else t[d:a] if d <= a else None
            if between is not None and len(between) < 500 and len(re.findall(r"\w+", between)) <= 25:
                return "MATCH_KEYWORDS", t[max(0, min(a, c) - 120) : max(b, d) + 120]
    return "NO_MATCH", None


def court_tier(x: Column | str) -> Column:
    n = F.lower(strip(x))
    out = F.lit("OTHER")
    for short, long in (("US", "ústavný súd"), ("MS", "mestský súd"), ("OS", "okresný súd"), ("KS", "krajský súd"), ("NS", "najvyšší súd")):
        out = F.when(n.startswith(short.lower()) | n.contains(long), short).otherwise(out)
    return out


def authority_level(x: Column | str) -> Column:
    n = F.lower(_c(x))
    return F.when(n.contains("najvy"), 3).when(n.contains("krajsk"), 2).otherwise(1)


def is_commercial(panel: Column, area: Column, case: Column) -> Column:
    low = F.lower(F.coalesce(case, F.lit("")))
    return (F.trim(F.coalesce(panel, F.lit(""))) == "2") | F.lower(F.coalesce(area, F.lit(""))).contains("obchod") | low.contains("obdo") | low.contains("obo") | low.contains("cob")


def case_variants(x: Column | str) -> Column:
    """All spellings of a docket number that occur."""
    t = F.replace(F.trim(F.col(x) if isinstance(x, str) else x), F.lit("\\"), F.lit("/"))
    p = r"^(\d+)\s*([a-zA-Z]+)\s*[/\s]*\s*(.+)$"
    s, a, r = (F.regexp_extract(t, p, i) for i in (1, 2, 3))
    forms = [F.concat(s, a, F.lit("/"), r), F.concat_ws(" ", s, a, r), F.concat_ws(" ", s, a, F.replace(r, F.lit("/"), F.lit(" "))), F.concat(s, a, F.lit(" "), r)]
    return F.array_sort(F.array_distinct(F.array(t, F.replace(t, F.lit(" ")), *[F.when(t.rlike(p), f).otherwise(t) for f in forms], F.replace(t, F.lit("/ "), F.lit("/")))))


def chunk_number(x: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(_c(x), r"_chunk_(\d+)$", 1).try_cast("int"), F.lit(-1))


def text_health(x: Column | str) -> Column:
    """empty, short (under 50 characters), garbled (under 0.4 letters and digits) or passed."""
    t = _c(x)
    n = F.char_length(strip(t))
    share = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")) / F.char_length(t)
    return F.when(n == 0, "empty").when(n < 50, "short").when(share < 0.4, "garbled").otherwise("passed")


# Fixed value: what counts as a token.
TOKEN = r"§\d+|\d{1,3}(?:\.\d{3})*(?:,\d+)?%?|\d{6,}|[a-záäčďéíľĺňóôŕšťúýžA-ZÁÄČĎÉÍĽĹŇÓÔŔŠŤÚÝŽ]+"


def tokens(x: Column | str, lemmas: Column | None = None) -> Column:
    """Legal tokens: section references and numbers verbatim, words of two letters up, without stop words.

    ``lemmas``: a map column from word to lemma; words it lacks stay as they are.
    """
    t = F.regexp_replace(F.lower(_c(x)), r"§[ \t\n\r\f]*(\d+)", "§$1")
    raw = F.regexp_extract_all(t, F.lit(f"({TOKEN})"), F.lit(1))
    stop = F.array(*map(F.lit, STOPWORDS))
    kept = F.filter(raw, lambda w: w.rlike(r"^[§\d]") | (F.char_length(w) > 1))
    if lemmas is not None:
        kept = F.transform(kept, lambda w: F.when(w.rlike(r"^[§\d]"), w).otherwise(F.coalesce(lemmas[w], w)))
    return F.filter(kept, lambda w: w.rlike(r"^[§\d]") | ~F.array_contains(stop, w))


def token_length(x: Column | str) -> Column:
    """Runs of characters that are not white space."""
    return F.regexp_count(_c(x), F.lit(f"[^{WS[1:-1]}]+"))


def rough_tokens(x: Column | str) -> Column:
    return F.floor(F.char_length(_c(x)) / 4).cast("int")


def first_tokens(x: Column | str, n: int | Column) -> Column:
    """The text's first ``n`` tokens, joined by blanks."""
    return F.array_join(F.slice(F.split(squash(x), " "), F.lit(1), n if isinstance(n, Column) else F.lit(n)), " ")


def truncated_tokens(x: Column | str, budget: int, *others: Column | str) -> Column:
    """The text's first tokens, as many as ``budget`` leaves once the other parts are in; nothing if they fill it."""
    left = F.lit(budget)
    for o in others:
        left = left - token_length(o)
    return first_tokens(x, F.greatest(left, F.lit(0)).cast("int"))


def safe_number(x: Column | str) -> Column:
    """A number, or null where there is none."""
    return (F.col(x) if isinstance(x, str) else x).try_cast("double")


def rounded(x: Column | str, digits: int = 0) -> Column:
    """Half to even."""
    return F.bround(F.col(x) if isinstance(x, str) else x, digits)


# Signs of a decision's parts, in plain letters, printed apart or not.
STRUCTURE = {
    "has_odovodnenie": spaced_word("odovodnenie"), "has_poucenie": spaced_word("poucenie"), "has_vyrok": rf"(?:takto\s*)?{spaced_word('rozhodol')}|vyrok",
}


def structure_flags(x: Column | str) -> list[Column]:
    """0 or 1 for each part of a decision that shows in the plain text."""
    t = plain(x)
    return [t.rlike(portable(p)).cast("int").alias(n) for n, p in STRUCTURE.items()]


# Letters of dockets in the trade register.
TRADE = ("cb", "cob", "cozm", "cbi", "cbs")


def is_trade_register(case: Column | str) -> Column:
    low = F.lower(_c(case))
    return F.exists(F.array(*map(F.lit, TRADE)), lambda m: F.contains(low, m))


# Official names of courts by their short ones.
COURT_NAMES = {
    "KS Banská Bystrica": "Krajský súd Banská Bystrica", "KS Bratislava": "Krajský súd Bratislava", "KS Košice": "Krajský súd Košice", "KS Nitra": "Krajský súd Nitra", "KS Prešov": "Krajský súd Prešov",
    "KS Trenčín": "Krajský súd Trenčín", "KS Trnava": "Krajský súd Trnava", "KS Žilina": "Krajský súd Žilina", "NS SR": "Najvyšší súd Slovenskej republiky", "ÚS SR": "Ústavný súd Slovenskej republiky",
}


def official_court(name: Column | str) -> Column:
    """The official name of a short one; other names stay."""
    n = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.create_map(*[F.lit(x) for kv in COURT_NAMES.items() for x in kv])[n], n)


def same_court(asked: Column, found: Column) -> Column:
    """Whether two court names agree: both of the supreme court, or the town of a regional court asked for stands in the name found."""
    a, f = F.lower(_c(asked)), F.lower(_c(found))
    top = F.lit("najvyšší")
    return (F.contains(a, top) & F.contains(f, top)) | F.contains(f, F.lower(F.replace(_c(asked), F.lit("Krajský súd "), F.lit(""))))


def docket_key(case: Column | str) -> Column:
    """A docket number without blanks and slashes, in small letters."""
    return F.lower(F.regexp_replace(_c(case), r"[ /]", ""))


def experiment_parts(name: Column | str) -> Column:
    """struct(family, k, window) of an experiment's name (``..._top7_w0``, ``..._fk8_c1p5_c2p5``); null where a part is missing."""
    n = _c(name)
    number = lambda p: F.nullif(F.regexp_extract(n, p, 1), F.lit("")).cast("int")
    family = F.regexp_replace(F.regexp_replace(n, r"_top\d+_w\d+$", ""), r"_fk\d+_c1p\d+_c2p\d+$", "")
    return F.struct(family.alias("family"), number(r"top(\d+)").alias("k"), number(r"w(\d+)").alias("window"))


# Patterns of entities.
ENTITIES = {
    "money": r"(?i)(?<![\p{L}\p{N}_])\d[\d\s.]*[.,]\d{2}\s*(eur|€|skk?|czk)?|(?<![\p{L}\p{N}_])\d[\d\s.]*\s*(eur|€|skk?|czk)(?![\p{L}\p{N}_])", "percent": r"\d+(?:[.,]\d+)?\s*%", "legal_ref": r"§\s*\d+[a-zA-Z]*",
    "invoice": r"(?i)(faktúr[ayou]?\s*č\.?\s*)?\d{6,}", "article": r"(?i)(čl\.|článo?k)\s*[IVXLC\d]+(?:\.\d+)?", "party_argument": r"(?i)(žalovan[ýá]|žalobca|žalobkyňa).{0,40}(namietal|tvrdil|uviedol|poukázal)",
    "procedural": r"(?i)(trov[yau]|odvolac[íie]|dovolan|procesn|civilný sporový poriadok|csp|pojednávan)",
}


def entity_counts(x: Column | str) -> list[Column]:
    """How often each kind of entity occurs."""
    return pattern_counts(_c(x), ENTITIES)
