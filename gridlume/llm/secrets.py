"""Secret scans in DataFrame functions alone: key patterns, and sliding-window entropy over candidate strings.

Spans come from two regular-expression passes: ``split`` gives the text between matches, ``regexp_extract_all`` the matches,
and running sums over both their lengths give the positions (code points, end exclusive). Candidate strings are runs of
base-64 characters, less what key patterns have found and less stretches that the allow-list names; each piece that is left is a
candidate of its own. Over each a window slides; its Shannon entropy follows from character counts, of which a step
changes two: of the character that leaves and of the one that enters. A window over the limit of the candidate's
character class makes the candidate a span, unless the allow-list knows it as a whole.

A fold copies its state at each step, so lists are never gathered in one: running sums and maxima are taken in blocks, and all
else is mapped over them. A text with very many matches costs its length times a constant.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlume.runtime import unused

#: The key patterns, in reporting order.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

_SPANS = "array<struct<start:int,k:int,end:int,body:string>>"


@dataclass(frozen=True)
class CharacterClass:
    """Characters of a class (a regular expression for a whole string, and the alphabet), and its limit in bits."""

    name: str
    whole: str
    alphabet: str
    bits: float


_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("hex", r"^[0-9a-fA-F]+$", _DIGITS + "abcdefABCDEF", 3.0),
    CharacterClass("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER + _LOWER.upper(), 3.5),
    CharacterClass("base64", r"^[A-Za-z0-9+/_-]+=*$", _DIGITS + _LOWER + _LOWER.upper() + "+/_-=", 3.7),
)
#: Candidates that are no secrets: UUIDs, digits and marks only, integrity hashes of their length, published sample keys.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^(sha1-[A-Za-z0-9+/]{27}|sha256-[A-Za-z0-9+/]{43}|sha384-[A-Za-z0-9+/]{64}|sha512-[A-Za-z0-9+/]{86})=?=?$",
    r"EXAMPLE(KEY)?$",
)
#: Stretches of a candidate that are none, whatever stands beside them: version or date paths, folders and words of samples.
_PARTS = r"(^|/)({path}|examples?|samples?)(/|$)|example|sample|SAMPLE|EXAMPLE[_-]|x{{4,}}|X{{4,}}"
ALLOW_PARTS = _PARTS.format(path="v?[0-9]+([-_/][0-9]+)+")
#: The same strings for the JVM's matcher, which walks a repeated group of varying length by recursion and ends the process on a long one: a mark
#: between digits is one that a digit follows, so a stretch grows by a character at a time, in a loop.
_JVM_PARTS = _PARTS.format(path="v?[0-9]+[-_/][0-9](?:(?![-_/](?![0-9]))[0-9/_-])*")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20

#: Numbers that a running total takes in one fold, and characters of a block of text.
_FOLD, _BLOCK = 64, 4096


def _none() -> Column:
    return F.array().cast(_SPANS)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, op, levels: int = 2) -> Column:
    """Running totals (by ``op``, of whole numbers from 0 on) of an array: folds over blocks, then the blocks' totals likewise."""

    def fold(a: Column) -> Column:
        return F.aggregate(a, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(op(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), v))))

    def joined(blocks: Column) -> Column:
        totals = _running(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)), op, levels - 1)
        before = F.concat(F.array(F.lit(0)), totals)
        return _let(before, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda v: op(F.get(t, i), v)))))

    def blocked(a: Column) -> Column:
        return _let(F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _FOLD).cast("int")), lambda j: fold(F.slice(a, j * _FOLD + 1, _FOLD))), joined)

    if not levels:
        return fold(values)
    return _let(values, lambda a: F.when(F.size(a) > 0, blocked(a)).otherwise(F.array().cast("array<int>")))


def _span(start: Column, k: int, end: Column, body: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(k).alias("k"), end.cast("int").alias("end"), body.alias("body"))


def _lengths(strings: Column) -> Column:
    return F.transform(strings, lambda x: F.length(x))


def _found(text: Column, pattern: str, kind: int, between: bool = False) -> Column:
    """Spans of the leftmost matches of ``pattern``; or of what is ``between`` them, before the first and after the last."""

    def spans(x: Column) -> Column:
        # where each gap ends and, but for the last one, a match begins
        ends = _running(F.zip_with(_lengths(x["gaps"]), F.concat(F.array(F.lit(0)), _lengths(x["bodies"])), lambda g, b: g + b), lambda a, b: a + b)
        if between:
            rows = F.arrays_zip(ends.alias("at"), x["gaps"].alias("gap"))
            return F.transform(rows, lambda r: _span(r["at"] - F.length(r["gap"]), kind, r["at"], r["gap"]))
        rows = F.slice(F.arrays_zip(ends.alias("at"), x["bodies"].alias("body")), 1, F.size(x["bodies"]))
        return F.transform(rows, lambda r: _span(r["at"], kind, r["at"] + F.length(r["body"]), r["body"]))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("bodies"))
    whole = F.array(_span(F.lit(0), kind, F.length(text), text)) if between else _none()
    return F.when(F.rlike(text, F.lit(pattern)), _let(parts, spans)).otherwise(whole).cast(_SPANS)


def _outside(base: Column, candidates: Column) -> Column:
    """The pieces of ``candidates`` (which do not overlap each other) outside ``base``, of at least a window.

    In order of starts, each span ends a piece of the candidate before it; a piece begins where that candidate does, or where
    the key patterns' spans before end, if that is later.
    """
    most = lambda a, b: F.greatest(a, b)

    def pieces(x: Column) -> Column:
        items = x["items"]

        def piece(i: Column) -> Column:
            own = F.get(items, F.get(x["last"], i) - 1)
            at = F.greatest(own["start"], F.get(x["covered"], i))
            cut = F.get(items, i + 1)
            upto = F.when(cut["k"] < 3, F.least(own["end"], cut["start"])).otherwise(own["end"])
            fits = own.isNotNull() & (upto - at >= WINDOW)
            return F.when(fits, _span(at, 3, upto, F.substring(own["body"], at - own["start"] + 1, upto - at)))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(items) - 1), piece), lambda p: p.isNotNull())

    def walked(items: Column) -> Column:
        covered = _running(F.transform(items, lambda s: F.when(s["k"] < 3, s["end"]).otherwise(0)), most)
        last = _running(F.transform(items, lambda s, i: F.when(s["k"] == 3, i + 1).otherwise(0)), most)
        return _let(F.struct(items.alias("items"), covered.alias("covered"), last.alias("last")), pieces)

    return F.when(F.size(candidates) > 0, _let(F.array_sort(F.concat(base, candidates)), walked)).otherwise(_none()).cast(_SPANS)


def _plogp(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def most_entropy(string: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits a character) of any ``window`` (up to 60) neighbouring characters; shorter strings: null.

    The fold's state holds the counts of the window by character, the sum of n * log2(n) over them and the least such
    sum so far; entropy is log2(window) - sum / window. Counts are a string with one character for each of the alphabet's, of
    which a step overlays two.
    """
    chars = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(alphabet), c))
    codes = F.filter(chars, lambda c: c > 0)
    zero = ord("@")
    start = F.struct(F.lit("@" * len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"), F.lit(0).alias("n"))

    def count(counts: Column, c: Column) -> Column:
        return F.ascii(F.substring(counts, c, F.lit(1))) - zero

    def changed(counts: Column, c: Column, by: int) -> Column:
        return F.overlay(counts, F.char(count(counts, c) + zero + by), c, F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        full = acc["n"] >= window
        n = count(acc["counts"], x["leave"])
        left = F.struct(
            F.when(full, changed(acc["counts"], x["leave"], -1)).otherwise(acc["counts"]).alias("counts"),
            F.when(full, acc["sum"] + _plogp(n - 1) - _plogp(n)).otherwise(acc["sum"]).alias("sum"),
            acc["least"].alias("least"),
            (acc["n"] + 1).alias("n"),
        )
        return _let(left, lambda a: entered(a, x["enter"]))

    def entered(acc: Column, c: Column) -> Column:
        n = count(acc["counts"], c)
        total = acc["sum"] + _plogp(n + 1) - _plogp(n)
        least = F.when(acc["n"] >= window, F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(changed(acc["counts"], c, 1).alias("counts"), total.alias("sum"), least.alias("least"), acc["n"].alias("n"))

    leaving = F.concat(F.array_repeat(F.lit(1), window), F.slice(codes, 1, F.greatest(F.size(codes) - window, F.lit(0))))
    pairs = F.filter(F.arrays_zip(codes.alias("enter"), leaving.alias("leave")), lambda p: p["enter"].isNotNull())
    least = F.aggregate(pairs, start, step, lambda acc: acc["least"])
    return F.when(F.length(string) >= window, F.log2(F.lit(float(window))) - least / window)


def _is_secret(body: Column) -> Column:
    mixed = F.rlike(body, F.lit("[0-9]")) & F.rlike(body, F.lit("[A-Za-z]"))
    allowed = F.lit(False)
    for p in ALLOW:
        allowed = allowed | F.rlike(body, F.lit(p))
    over = F.lit(False)
    for c in reversed(CLASSES):
        over = F.when(F.rlike(body, F.lit(c.whole)), most_entropy(body, c.alphabet) >= c.bits - 1e-9).otherwise(over)
    return F.when(mixed & ~allowed, over).otherwise(F.lit(False))


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row; spans: array of (start, kind, end, body), by start, then kind as in KINDS.

    A null or empty text has no spans. Repeated ids and null ids are rows like any other. Other columns are not read.
    Everything is one projection over the scan: no shuffle, no state beyond a row.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base, candidates, spans = _expressions(docs.sparkSession.sparkContext.applicationId)
    return docs.select("doc_id", base.alias("base"), candidates.alias("candidates")).select("doc_id", spans.alias("spans"))


@cache
def _expressions(application: str) -> tuple[Column, Column, Column]:
    """Spans of key patterns and candidates in ``text``, and all spans from ``base`` and ``candidates``; built once an application, as building them takes seconds."""
    t = F.col("text")
    assign = F.filter(_found(t, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["body"], ASSIGN, 2)) >= 12)
    base = F.concat(assign, _found(t, ACCESS, 1), _found(t, HEX, 2))

    def allowed_cut(c: Column) -> Column:
        parts = F.filter(_found(c["body"], _JVM_PARTS, 3, between=True), lambda p: p["end"] - p["start"] >= WINDOW)
        return F.transform(parts, lambda p: F.struct((c["start"] + p["start"]).alias("start"), p["k"].alias("k"), (c["start"] + p["end"]).alias("end"), p["body"].alias("body")))

    pieces = F.flatten(F.transform(_outside(F.col("base"), F.col("candidates")), allowed_cut))
    added = F.when(F.size("candidates") > 0, F.filter(pieces, lambda c: _is_secret(c["body"]))).otherwise(_none())
    spans = F.transform(F.array_sort(F.concat("base", added)), lambda s: F.struct(s["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1).alias("kind"), s["end"].alias("end"), s["body"].alias("body")))
    return base, _found(t, CANDIDATE, 3), spans


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each secret in the text replaced by ``[SECRET]``; overlapping spans are one. Columns stay as they are.

    Rows without secrets, null texts among them, are returned unchanged. ``n_chars`` is counted anew where there is one.
    """
    found, mark, fresh = (unused(docs, c) for c in ("_secret_spans", "_secret_dirty", "_secret_text"))
    text, list_ = F.col(f"`{text_col}`"), F.col(found)
    spans = secret_spans(docs.select(F.struct("*").alias("row"), text.alias("text")), id_col="row").select("doc_id.*", F.col("spans").alias(found))

    def between(blocks: Column, a: Column, b: Column) -> Column:
        # substring walks its string from the beginning, so it is given blocks only
        i, j = F.floor(a / _BLOCK).cast("int"), F.floor(b / _BLOCK).cast("int")
        inner = F.array_join(F.slice(blocks, i + 2, j - i - 1), "")
        far = F.concat(F.substring(F.get(blocks, i), a % _BLOCK + 1, F.lit(_BLOCK)), inner, F.coalesce(F.substring(F.get(blocks, j), F.lit(1), b % _BLOCK), F.lit("")))
        return F.when(b <= a, "").when(i == j, F.substring(F.get(blocks, i), a % _BLOCK + 1, b - a)).otherwise(far)

    def cleaned(x: Column) -> Column:
        # a span that starts inside those before it only moves their end
        ends = F.concat(F.array(F.lit(0)), _running(F.transform(list_, lambda s: s["end"]), lambda a, b: F.greatest(a, b)))

        def joined(at: Column) -> Column:
            pieces = F.transform(list_, lambda s, i: F.when(s["start"] >= F.get(at, i), F.concat(between(x, F.get(at, i), s["start"]), F.lit("[SECRET]"))).otherwise(""))
            return F.concat(F.array_join(pieces, ""), between(x, F.get(at, F.size(at) - 1), F.length(text)))

        return _let(ends, joined)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    clean = _let(blocks, cleaned)
    dirty = F.size(list_) > 0
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = spans.select(*own, dirty.alias(mark), F.when(dirty, clean).otherwise(text).alias(fresh))
    new, changed = F.col(fresh), F.col(mark)

    def column(name: str) -> Column:
        if name == text_col:
            return new.alias(name)
        if name == "n_chars":
            return F.when(changed, F.length(new).cast(docs.schema[name].dataType)).otherwise(F.col(name)).alias(name)
        return F.col(f"`{name}`")

    return rows.select(*map(column, docs.columns))
