"""Benchmark decontamination on templates.

Words become template codes: numbers, units after a number and names inside a sentence are typed placeholders, runs of
equal placeholders are one; other words keep their lower-case form. In a second reading words in capitals that open a sentence are names
too; an item counts in whichever reading more of it is found. Windows of ``window`` codes of the benchmark are
hash-joined with those of the documents. A matched window counts only if the fillers of its slots fit the others of that
occurrence of the item: one filler of the item always stands for one filler of the document. Questions with other
numbers and names are caught that way, several variants in one document too, and chance fits of unrelated slots are not.

Both sides of the join are tables. A bitmap of the benchmark's window hashes, of bounded size, goes to all tasks and turns
nearly all windows of the documents away before they are rows; it decides nothing, as the join follows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm import textops as T
from gridlume.llm.scratch import Scratch
from gridlume.runtime import unused

#: Words that are units when a number stands before them.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent degree degrees usd eur gbp dollar dollars euro euros cent cents w kw v a hz khz mhz ghz kb mb gb tb bytes meter meters metre metres"
).split()
NUMBER, UNIT, NAME = 1, 2, 3

#: Everything but letters, digits and bytes beyond ASCII divides words.
_DIVIDES = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?:;\n\r\"()[]"])


def _unit_hashes() -> np.ndarray:
    part = next(T.slices(pa.array([" ".join(UNITS)])))
    return np.unique(T.words(part, True, _DIVIDES).hash)


_UNITS = _unit_hashes()
_SLOT = T.mix(np.arange(1, 4, dtype=T.U64) * T.U64(0xD6E8FEB86659FD93))


class Templates:
    """Template codes of a slice: ``codes``, slot kinds and fillers of the words that remain, in ``words``' layout."""

    def __init__(self, part: T.Slice, w: T.Words, kind: np.ndarray, inner: np.ndarray):
        n = len(w.start)
        stay = np.ones(n, bool)
        # a name that opens a sentence does not go on with one that ends the sentence before
        stay[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1]) | (w.doc[1:] != w.doc[:-1]) | ((kind[1:] == NAME) & ~inner[1:])
        group = np.cumsum(stay) - 1
        keep = np.flatnonzero(stay)
        filler = np.zeros(len(keep), T.U64)
        np.add.at(filler, group, w.hash * T._SHINGLE[np.minimum(np.arange(n) - keep[group], 40)])
        self.kind, self.filler = kind[keep], T.mix(filler)
        self.codes = np.where(self.kind > 0, _SLOT[np.maximum(self.kind, 1) - 1], w.hash[keep])
        self.words = T.Words(w.start[keep], w.end[keep], w.doc[keep], self.codes, np.searchsorted(w.doc[keep], np.arange(len(part) + 1)))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return T.shingles(self.words, n, self.codes)


def templates(part: T.Slice) -> tuple[Templates, Templates]:
    """Two readings of a slice: names inside sentences are slots; and words in capitals that open a sentence are, too.

    Whether a word is a slot follows from the word and the mark before it alone, so a copy reads alike in any document.
    """
    buf = part.buf
    divides = _DIVIDES[buf]
    if len(buf) > 2:
        point = ((buf == ord(".")) | (buf == ord(",")))[1:-1] & _DIGIT[buf[:-2]] & _DIGIT[buf[2:]]
        divides[1:-1] &= ~point
    # the word finder takes a table of separators; what divides by context is masked to a space first
    masked = np.where(divides, np.uint8(0x20), np.where(_DIVIDES[buf], np.uint8(0x30), buf))
    w = T.words(T.Slice(part.row, masked, part.offsets), True, _DIVIDES)
    n = len(w.start)
    kind, inner, capital = np.zeros(n, np.int8), np.zeros(n, bool), np.zeros(n, bool)
    if n:
        kind[_DIGIT[buf[w.start]]] = NUMBER
        after = np.zeros(n, bool)
        after[1:] = (kind[:-1] == NUMBER) & (w.doc[1:] == w.doc[:-1])
        place = np.minimum(np.searchsorted(_UNITS, w.hash), len(_UNITS) - 1)
        kind[after & (kind == 0) & (_UNITS[place] == w.hash)] = UNIT
        stops = np.concatenate([[0], np.cumsum(_STOP[buf] & divides)])
        inner[1:] = (stops[w.start[1:]] == stops[w.end[:-1]]) & (w.doc[1:] == w.doc[:-1])
        capital = (kind == 0) & _UPPER[buf[w.start]]
    return tuple(Templates(part, w, np.where(own, NAME, kind).astype(np.int8), inner) for own in (capital & inner, capital))


def _slots(t: Templates, at: np.ndarray, n: int) -> pa.ListArray:
    """The fillers of the slots in each window of ``n`` codes that begins at ``at``."""
    place = at[:, None] + np.arange(n)
    slot = t.kind[place] > 0
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(slot.sum(axis=1))).astype(np.int32), pa.array(t.filler[place][slot].view(np.int64)))


def _windows(part: T.Slice, batch: pa.RecordBatch, sizes: list[int], keep) -> pa.RecordBatch | None:
    """``doc_id, text_key, reading, n, at, key, fillers``: windows of both readings that ``keep(reading, n, hashes, document, codes of it)`` marks."""
    out = []
    for reading, t in enumerate(templates(part)):
        size = np.diff(t.words.first)
        for n in sizes:
            value, at = t.windows(n)
            doc = t.words.doc[at]
            own = np.flatnonzero(keep(n, value, size[doc]))
            if len(own):
                value, at, doc = value[own], at[own], doc[own]
                row = pa.array(doc)
                same = lambda x, of=len(own): pa.array(np.full(of, x, np.int32))
                out.append(pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), same(reading), same(n), pa.array((at - t.words.first[doc]).astype(np.int64)), pa.array(value.view(np.int64)), _slots(t, at, n)], _NAMES))
    if not out:
        return None
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0]


_NAMES = ["doc_id", "text_key", "reading", "n", "at", "key", "fillers"]
_SCHEMA = "doc_id long, text_key long, reading int, n int, at long, key long, fillers array<long>"


def _benchmark_windows(items: DataFrame, window: int, least: int) -> DataFrame:
    """Windows of each item (``doc_id, text_key, text``) in both readings. An item of fewer codes is one window as a whole, from ``least`` codes on."""
    return T.map_slices(items, lambda part, batch: _windows(part, batch, list(range(least, window + 1)), lambda n, value, size: (size == n) | (n == window)), _SCHEMA)


def _bitmap(keys: DataFrame, most_bits: int = 27) -> tuple[np.ndarray, int]:
    """Bits set at two places of each key; at most 2 ** ``most_bits`` of them, whatever the benchmark."""
    bits = int(min(most_bits, max(22, np.ceil(np.log2(keys.count() * 64 + 1)))))
    places = keys.select(F.explode(F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND((1 << bits) - 1))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return out.view(T.U64), bits


def _consistent(hits: list) -> set[int]:
    """Item windows (by position) whose slot fillers agree with the commonest reading of each of the item's fillers.

    A hit is an item window's position, the document's, and pairs of the fillers of both.
    """
    votes = defaultdict(Counter)
    for _, _, slots in hits:
        for f, g in slots:
            votes[f][g] += 1
    best = {f: max(c.items(), key=lambda x: (x[1], -x[0]))[0] for f, c in votes.items()}
    return {pos for pos, _, slots in hits if all(best[f] == g for f, g in slots)}


def _occurrences(hits: list) -> list[list]:
    """Hits that may be one copy of the item: those of equal shift, those that run forward through item and document, and all.

    A copy has one shift unless words were put in or left out; its windows still follow one another then.
    """
    shifts, runs, last = defaultdict(list), [], None
    by_place = defaultdict(list)
    for h in hits:
        shifts[h[1] - h[0]].append(h)
        by_place[h[1]].append(h)
    for _, here in sorted(by_place.items()):
        here.sort(key=lambda h: h[0])
        on = next((h for h in here if last is not None and h[0] > last), None)
        if on is None:
            runs.append([])
        runs[-1].append(on or here[0])
        last = runs[-1][-1][0]
    return [hits] if len(shifts) == 1 else [*shifts.values(), *runs, hits]


def _paired(groups: list) -> list:
    """Hits of an item and a document from their equal windows: per window its places with fillers in the item, and in the document.

    A window that only one side repeats makes a hit of each repetition. Where both repeat it, the document's k-th occurrence is
    held against the item's k-th, again and again through the copies, counted from the front and from the back; and at each shift that the
    other windows speak for, the best ones first, in a number that the document's length over the item's bounds. So hits
    are in proportion to both lengths together, however often words repeat.
    """
    hits, repeated, places = [], [], []
    for g in groups:
        here, there = (sorted(((w["at"], w["fillers"]) for w in g[side]), key=lambda w: w[0]) for side in ("here", "there"))
        places.append((here[-1][0], there[0][0], there[-1][0]))
        if len(here) > 1 and len(there) > 1:
            repeated.append((here, there))
        else:
            hits += [(p, a, list(zip(own, other))) for p, own in here for a, other in there if len(own) == len(other)]  # noqa: B905
    if not repeated:
        return hits
    length, span = 1 + max(p[0] for p in places), 1 + max(p[2] for p in places) - min(p[1] for p in places)
    shifts = [s for s, _ in Counter(a - p for p, a, _ in hits).most_common(8 * (span // length + 1))]
    for here, there in repeated:
        m, d = len(here), len(there)
        pairs = {(t % m, t) for t in range(d)} | {(m - 1 - t % m, d - 1 - t) for t in range(d)}
        at = {a: t for t, (a, _) in enumerate(there)}
        pairs |= {(i, at[p + s]) for s in shifts for i, (p, _) in enumerate(here) if p + s in at}
        hits += [(here[i][0], there[t][0], list(zip(here[i][1], there[t][1]))) for i, t in pairs if len(here[i][1]) == len(there[t][1])]  # noqa: B905
    return hits


def _most_consistent(hits: list) -> int:
    """Consistent windows of the item's best occurrence."""
    most = 0
    for own in _occurrences(hits):
        if len(own) > most:
            most = max(most, len(_consistent(own)))
    return most


def _judged(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``good``, the consistent windows of each row's groups of equal windows."""

    def run(batches):
        for batch in batches:
            good = [_most_consistent(_paired(groups.as_py())) for groups in batch.column(batch.schema.get_field_index("groups"))]
            keep = [c for c in batch.schema.names if c != "groups"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(good, pa.int64())], [*keep, "good"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name != "groups")
    return pairs.mapInArrow(run, f"{fields}, good long")


def _hits(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, least: int, percent: int, found_only: bool, most_broadcast: int) -> DataFrame:
    """``doc_id, text_key, item_id, n_windows, n_matched, n_consistent`` of ``docs`` (``doc_id, text``); ``found_only``: of those pairs that can count."""
    scratch = Scratch(docs.sparkSession, "decontam")
    items = benchmark.where(f"`{item_col}` is not null").select(F.col(item_col).cast("long").alias("doc_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    keys = scratch.save(_benchmark_windows(items.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), window, least), "keys")
    bitmap, bits = _bitmap(keys)
    sizes = sorted(r["n"] for r in keys.select("n").distinct().collect())

    def is_set(place: np.ndarray) -> np.ndarray:
        return (bitmap[(place >> T.U64(6)).astype(np.int64)] >> (place & T.U64(63)) & T.U64(1)).astype(bool)

    def known(n: int, value: np.ndarray, size: np.ndarray) -> np.ndarray:
        return is_set(value >> T.U64(64 - bits)) & is_set(value & T.U64((1 << bits) - 1))

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    seen = T.map_slices(texts, lambda part, batch: _windows(part, batch, sizes, known), _SCHEMA)
    item, window_ = ["item_id", "item_key", "reading"], ["reading", "n", "key"]
    keys = keys.select(F.col("doc_id").alias("item_id"), F.col("text_key").alias("item_key"), *window_, "at", "fillers")
    total = keys.groupBy(*item).agg(F.count("*").alias("total"))
    # equal windows of one text are a row: rows that meet are no more than windows of either side, whatever repeats
    keys = keys.groupBy(*item, "n", "key").agg(F.collect_list(F.struct("at", "fillers")).alias("here")).join(total, item)
    if keys.limit(most_broadcast + 1).count() <= most_broadcast:
        keys = F.broadcast(keys)
    # rows that repeat id and text are one document: what is collected is a set
    seen = seen.groupBy("doc_id", "text_key", *window_).agg(F.collect_set(F.struct("at", "fillers")).alias("there"))
    pairs = seen.join(keys, window_).groupBy("doc_id", "text_key", *item, "total").agg(F.collect_list(F.struct("here", "there")).alias("groups"), F.sum(F.size("here")).cast("long").alias("matched"))
    if found_only:
        pairs = pairs.where(F.col("matched") * 100 >= F.col("total") * percent)
    best = F.max_by(F.struct("total", "matched", "good"), F.struct(F.col("good") / F.col("total"), -F.col("reading")))
    out = _judged(pairs).groupBy("doc_id", "text_key", "item_id", "item_key").agg(best.alias("b"))
    return out.select("doc_id", "text_key", "item_id", F.col("b.total").alias("n_windows"), F.col("b.matched").alias("n_matched"), F.col("b.good").alias("n_consistent"))


#: Rows (of benchmark windows, or of documents to drop) up to which they go to all tasks; their number is counted first.
MOST_BROADCAST = 200_000


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, least: int = 4, percent: int = 50, found_only: bool = False, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``doc_id, text_key, item_id, n_windows, n_matched, n_consistent, contaminated`` for every document and item that share a window.

    Each distinct text of an item id is an item of its own, with rows of its own under that id; a document is its id and its text
    (text_key, the text's xxhash64), so rows that repeat an id with another text are judged by themselves and equal rows are one.

    contaminated: at least ``percent`` of the item's windows are found with consistent slots in one occurrence (or, where
    its parts lie scattered, in the whole document); n_consistent are those of the best one. Items of under ``least``
    codes, null texts and null item ids match nothing. ``found_only`` leaves out pairs that share too few windows to count. The
    benchmark's windows go to all tasks if there are no more than ``most_broadcast``, else both sides are shuffled by
    window. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hits = _hits(docs, benchmark, item_col, item_text_col, window, least, percent, found_only, most_broadcast)
    return hits.withColumn("contaminated", F.col("n_consistent") * 100 >= F.col("n_windows") * percent)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST, **options) -> DataFrame:
    """``docs`` less the rows that hold an item (see ``contamination``); columns stay.

    Rows go by id and text, null ids too. Rows are matched in place if no more than ``most_broadcast`` are to go, else by shuffle.
    """
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col, found_only=True, most_broadcast=most_broadcast, **options).where("contaminated")
    bad_id, bad_key = unused(docs, "_bad_id"), unused(docs, "_bad_key")
    bad = Scratch(docs.sparkSession, "decontam-rows").save(bad.select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct(), "bad")
    if bad.limit(most_broadcast + 1).count() <= most_broadcast:
        bad = F.broadcast(bad)
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(bad_key))
    return docs.join(bad, same, "left_anti")


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_items, item_ids, n_consistent, contaminated`` for every distinct non-null document id."""
    hits = contamination(docs, benchmark, found_only=True, **options)
    bad = hits.where("contaminated").groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item_id")).cast("array<string>"), ",").alias("item_ids"), F.max("n_consistent").alias("n_consistent"))
    ids = docs.select(F.col(options.get("id_col", "doc_id")).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.join(bad, "doc_id", "left").select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.coalesce("n_consistent", F.lit(0)).cast("long").alias("n_consistent"), F.col("n_items").isNotNull().alias("contaminated"))
