"""Repeated strings removed by prefix-free parsing.

A rolling hash over ``GRAM`` bytes triggers where it is least among the grams of a ``length``-byte window, so a trigger
depends on nothing but the window's bytes and every window has one. Windows that share a trigger form a phrase: the
bytes from the first window's start to the last one's end. Neighbouring phrases overlap, and no phrase begins another of
the same trigger and place. The corpus becomes a dictionary of distinct phrases and the parse, the phrases' occurrences.

The parse, in order of its phrases and of the corpus, gives each phrase its first occurrence; an occurrence that is not
the first repeats all of its windows. The dictionary's suffix arrays give the rest: phrases of a trigger are sorted by
their suffixes from the trigger on, and by their beginnings up to it read backwards, and the longest common prefixes
of neighbours in both orders tell which windows (suffixes of ``length`` bytes or more, cut to that) are the same string: those
that agree before the trigger as far back, and after it as far on, as the window reaches. Both orders and the places of
first occurrences combine into the runs of equal windows in corpus order. A window never leaves its phrase, so the parse is
needed to the depth of one phrase only. All of this compares bytes; a hash only decides what is compared.

Triggers seen once end the work for their windows, which is nearly all of them in ordinary text; text that repeats much is a
small dictionary. Phrases are sorted in groups of bounded size. A trigger with more phrases than a group takes is
dealt to several; what each leaves is then compared across them by the windows' bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlume.llm import textops as T
from gridlume.llm.scratch import Scratch

GRAM = 32
#: Windows that are parsed in one go, and dictionary phrases that a group sorts.
STEP, GROUP_ROWS = 1 << 20, 1 << 14
_POS_BITS = T.U64(28)
_NO_ID = -(1 << 63)


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the ``gram`` bytes at every position that has them."""
    n = max(0, len(buf) - gram + 1)
    out = np.empty(n, T.U64)
    for at in range(0, n, T.BLOCK):
        p = T.prefix(buf[at : at + T.BLOCK + gram - 1])
        m = len(p) - gram
        out[at : at + m] = (p[gram:] - p[:m]) * T.INV[:m]
    return T.mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def phrases(part: T.Slice, length: int, gram: int = GRAM, step: int = STEP, bits: int = 64) -> tuple[np.ndarray, ...]:
    """Row, trigger hash, phrase hash and check, start of the first window (in the slice), number of windows and trigger offset of each phrase.

    A long text is taken ``step`` windows at a time. A phrase that a step's end cuts in two is two phrases of one trigger, whose
    windows are compared like those of any others.
    """
    found = [tuple(np.zeros(0, t) for t in (np.int64, T.U64, T.U64, np.int32, np.int64, np.int64, np.int64))]
    for a in range(0, max(0, len(part.buf) - length + 1), step):
        buf = part.buf[a : a + step + length - 1]
        start = np.arange(len(buf) - length + 1)
        row = np.searchsorted(part.offsets, start + a, "right") - 1
        inside = start + a + length <= part.offsets[row + 1]
        start, row = start[inside], row[inside]
        if not len(start):
            continue
        grams = gram_hashes(buf, gram) >> T.U64(64 - bits)
        # ties go to the first gram of a window, which depends on its bytes alone
        ordered = T.mix(grams) >> _POS_BITS << _POS_BITS
        least = _sliding_min(ordered | np.arange(len(grams), dtype=T.U64), length - gram + 1)
        trigger = (least[start] & ((T.U64(1) << _POS_BITS) - T.U64(1))).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(start)))
        lo, trig = start[at], trigger[at]
        end = lo + count + length - 1
        body = T.hash_spans(buf, lo, end)
        sums = np.concatenate([np.zeros(1, T.U64), np.cumsum(T.mix(grams + T.U64(1)))])
        check = ((sums[end - gram + 1] - sums[lo]) >> T.U64(32)).astype(np.uint32).view(np.int32)
        found.append((row[at], grams[trig], T.mix(body + (trig - lo).astype(T.U64) * T._SHINGLE[7]), check, lo + a, count, trig - lo))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _again(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which entries repeat an earlier (row, value); entries of a row are in order of their position."""
    order = np.lexsort((np.arange(len(row)), value, row))
    out = np.zeros(len(row), bool)
    same = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    out[order[1:][same]] = True
    return out


#: place: start of the first window, trigger offset (8 bits), number of windows minus one (8).
def _place(lo: np.ndarray, toff: np.ndarray | int, count: np.ndarray) -> np.ndarray:
    return lo.astype(np.int64) << 16 | toff << 8 | (count - 1)


def _parse(docs: DataFrame, length: int, step: int, bits: int) -> DataFrame:
    """Every phrase occurrence; one that repeats a phrase of its own document has no trigger (it is a repeat for certain)."""

    def run(part: T.Slice, batch: pa.RecordBatch) -> pa.RecordBatch:
        row, trigger, phrase, check, lo, count, toff = phrases(part, length, step=step, bits=bits)
        place = _place(lo - part.offsets[row], toff, count)
        own = _again(row, phrase + (check.view(np.uint32).astype(T.U64) << T.U64(32)))
        rows = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(trigger.view(np.int64), mask=own), pa.array(phrase.view(np.int64), mask=own), pa.array(check, mask=own), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place)],
            ["trigger", "phrase", "check", "doc_id", "tag", "place"],
        )

    return T.map_slices(docs, run, "trigger long, phrase long, check int, doc_id long, tag long, place long")


def _bodies(rows: DataFrame, length: int) -> DataFrame:
    """``group, dealt, doc_id, tag, place, body``: the bytes of the phrases listed for a document (``doc_id, tag, text, items``)."""

    def run(part: T.Slice, batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(3)
        items = lists.flatten()
        row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
        place = items.field(0).to_numpy()
        lo = (place >> 16) + part.offsets[row]
        size = (place & 255) + length
        ends = np.cumsum(size)
        flat = part.buf[np.repeat(lo - (ends - size), size) + np.arange(int(size.sum()))]
        body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append([0], ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
        rows = pa.array(row)
        return pa.RecordBatch.from_arrays([items.field(1), items.field(2), batch.column(0).take(rows), batch.column(1).take(rows), items.field(0), body], ["group", "dealt", "doc_id", "tag", "place", "body"])

    return T.map_slices(rows, run, "group int, dealt boolean, doc_id long, tag long, place long, body binary")


def _sorted_prefixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows (byte strings of one length), and what each has in common with the row before it."""
    n, width = x.shape
    order = np.argsort(np.ascontiguousarray(x).view(f"S{width}").ravel(), kind="stable")
    common = np.zeros(n, np.int64)
    for a in range(1, n, 4096):
        differ = x[order[a : a + 4096]] != x[order[a - 1 : a - 1 + len(order[a : a + 4096])]]
        common[a : a + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def equal_windows(body: np.ndarray, start: np.ndarray, toff: np.ndarray, count: np.ndarray, doc: np.ndarray, tag: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, window in it) of those windows that a phrase before it has too; phrases are in corpus order (doc, tag, place).

    ``body[start[i]:start[i + 1]]`` is phrase i. A phrase of the same doc with another tag is no phrase before it.
    """
    n, side = len(toff), length - gram
    last = len(body) - 1

    def context(at: np.ndarray, inside) -> np.ndarray:
        return np.where(inside(at), body[np.clip(at, 0, last)], 0).astype(np.uint8)

    trigger = (start[:-1] + toff)[:, None]
    onward, common_on = _sorted_prefixes(context(trigger + np.arange(length), lambda at: at < start[1:, None]))
    back, common_back = _sorted_prefixes(context(trigger - 1 - np.arange(max(side, 1)), lambda at: at >= start[:-1, None]))
    on, before = np.empty(n, np.int64), np.empty(n, np.int64)
    rows, windows = [], []
    for t in range(side + 1):  # the trigger's place in the window
        own = np.flatnonzero((t <= toff) & (toff - t < count))
        if len(own) < 2:
            continue
        on[onward], before[back] = np.cumsum(common_on < length - t), np.cumsum(common_back < t)
        run = on[own] * (n + 1) + before[own]
        order = np.argsort(run, kind="stable")
        run, at = run[order], own[order]
        same = np.append([False], run[1:] == run[:-1])
        if not same.any():
            continue
        first = at[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]
        previous = np.append(at[:1], at[:-1])
        known = same & ((doc[at] > doc[first]) | ((doc[at] == doc[previous]) & (tag[at] == tag[previous])))
        rows.append(at[known]), windows.append(toff[at[known]] - t)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(windows)


_RUNS = "doc_id long, tag long, place long, window binary"


def _runs(bodies: DataFrame, length: int) -> DataFrame:
    """Repeated windows of each group as places of neighbours (``window`` null); of dealt phrases, one row for each other window."""

    def run(table: pa.Table) -> pa.Table:
        place = table["place"].to_numpy()
        doc, tag = table["doc_id"].to_numpy(), table["tag"].to_numpy()
        order = np.lexsort(((place >> 16) + (place >> 8 & 255), tag, doc))
        table = table.take(pa.array(order)).combine_chunks()
        doc, tag, place = doc[order], tag[order], place[order]
        text = table["body"].combine_chunks()
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        body = np.frombuffer(text.buffers()[2], np.uint8)
        lo, toff, count = place >> 16, place >> 8 & 255, (place & 255) + 1
        row, window = equal_windows(body, offsets, toff, count, doc, tag, length)
        order = np.lexsort((window, row))
        row, window = row[order], window[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(row)))
        head = row[at]
        out = [(doc[head], tag[head], _place(lo[head] + window[at], 0, size), pa.nulls(len(at), pa.binary()))]
        dealt = np.flatnonzero(table["dealt"].to_numpy())
        if len(dealt):
            many = count[dealt]
            r = np.repeat(dealt, many)
            w = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            fresh = ~np.isin(r << 8 | w, row << 8 | window)
            r, w = r[fresh], w[fresh]
            bytes_ = body[(offsets[r] + w)[:, None] + np.arange(length)]
            out.append((doc[r], tag[r], _place(lo[r] + w, 0, np.ones(len(r), np.int64)), pa.array([x.tobytes() for x in bytes_], pa.binary())))
        return pa.concat_tables([pa.table([pa.array(d), pa.array(g), pa.array(p), b], ["doc_id", "tag", "place", "window"]) for d, g, p, b in out])

    return bodies.groupBy("group").applyInArrow(run, _RUNS)


def _across(rest: DataFrame) -> DataFrame:
    """Of the windows that the groups of one trigger left, those that a smaller id, or their own document before, has too.

    A group leaves a window once (or once for each version of its least document), so a window's rows are as few as its groups.
    """
    same = Window.partitionBy("window")
    ranked = rest.select("*", F.min("doc_id").over(same).alias("least"), F.row_number().over(Window.partitionBy("window", "doc_id", "tag").orderBy("place")).alias("k"))
    return ranked.where("doc_id > least or k > 1").select("doc_id", "tag", "place")


def _apply(rows: DataFrame, length: int) -> DataFrame:
    def run(part: T.Slice, batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        n_removed, n_spans, digest, spans = [], [], [], []
        for i in range(len(part)):
            own = lists[i].values
            own = np.zeros(0, np.int64) if own is None else np.sort(own.to_numpy())
            lo = own >> 16
            hi = np.maximum.accumulate(lo + (own & 255) + length) if len(own) else lo
            cut = np.flatnonzero(lo[1:] > hi[:-1]) + 1
            a, b = lo[np.append([0], cut)] if len(lo) else lo, hi[np.append(cut - 1, len(hi) - 1)] if len(lo) else lo
            text = part.text(i)
            kept = hashlib.sha256()
            at = 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                kept.update(text[at:x])
                at = y
            kept.update(text[at:])
            n_removed.append(int((b - a).sum())), n_spans.append(len(a)), digest.append(kept.hexdigest())
            spans.append(np.stack([a, b], 1).ravel().tolist())
        size = np.diff(part.offsets).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest), pa.array(spans, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return T.map_slices(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def _free_least(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """``docs`` with the least number free of ids, as null ids stand for it: where it is one, it and the ids right above it move up by
    one into the first gap (returned)."""
    if docs.where(F.col("doc_id") == _NO_ID).limit(1).count() == 0:
        return docs, None
    ids = docs.select("doc_id").distinct().where("doc_id is not null")
    after = ids.where(F.col("doc_id") < (1 << 63) - 1).select((F.col("doc_id") + 1).alias("doc_id"))
    gap = after.join(ids, "doc_id", "left_anti").agg(F.min("doc_id")).first()[0]
    return docs.withColumn("doc_id", F.when(F.col("doc_id") < gap, F.col("doc_id") + 1).otherwise(F.col("doc_id"))), gap


def repeated_strings(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS, step: int = STEP, trigger_bits: int = 64) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row; spans: from, to, from, to, ... in bytes.

    Removed is each byte inside a ``length``-byte string (of the UTF-8 text) that also starts earlier: in a document of smaller
    id, or earlier in the same one. A null text is empty; texts under ``length`` bytes keep all. A null id stands before all
    others. Rows that repeat an id are versions of one document: each is held against other documents and itself, not against
    the others of its id; equal rows get equal results. Other columns are not read. ``length`` is 33 to 255.
    Occurrences of one phrase are told by 96 bits of hash beside its trigger's, windows of different phrases by their bytes.
    ``group_rows`` phrases are sorted together, ``step`` windows parsed together; fewer ``trigger_bits`` make more phrases share
    a trigger. None of the three changes a result.
    """
    scratch = Scratch(docs.sparkSession, "phrasedup")
    docs, gap = _free_least(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")))
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    rows, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    # where ids repeat, a document is its id and its text
    tagged = rows != ids
    docs = docs.select("doc_id", (F.xxhash64("text") if tagged else F.lit(0).cast("long")).alias("tag"), "text")
    parse = scratch.save(_parse(docs, length, step, trigger_bits), "parse")
    shared = parse.groupBy("trigger").agg(F.count("*").alias("n")).where("n > 1 and trigger is not null").select("trigger")
    cand = parse.join(shared, "trigger", "left_semi").union(parse.where("trigger is null"))
    cand = scratch.save(cand.distinct() if tagged else cand, "shared")
    scratch.drop("parse")
    # a phrase is once in a document, so its least document holds its first occurrence
    phrase = ["trigger", "phrase", "check"]
    dictionary = scratch.save(cand.where("trigger is not null").groupBy(*phrase).agg(F.min("doc_id").alias("first")), "dictionary")
    several = scratch.save(dictionary.groupBy("trigger").agg(F.count("*").alias("n")).where("n > 1"), "several")
    groups = max(1, -(-(several.agg(F.sum("n")).first()[0] or 0) // group_rows))
    later = F.col("doc_id") > F.col("first")
    shares = F.ceil(F.col("n") / group_rows)
    group = F.pmod(F.xxhash64("trigger", F.pmod(F.xxhash64("phrase", "check"), shares)), F.lit(groups)).cast("int")
    graded = cand.where("trigger is not null").join(dictionary, phrase).join(several, "trigger", "left").where(later | F.col("n").isNotNull())
    graded = graded.select("doc_id", "tag", "place", F.when(~later, group).alias("group"), F.when(~later, shares > 1).alias("dealt"))
    none = cand.where("trigger is null").select("doc_id", "tag", "place", F.lit(None).cast("int").alias("group"), F.lit(None).cast("boolean").alias("dealt"))
    graded = scratch.save(graded.union(none), "graded")
    scratch.drop("shared", "dictionary", "several")

    open_ = graded.where("group is not null").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "group", "dealt")).alias("items"))
    # one row of each document that is there several times
    texts = docs.join(open_, ["doc_id", "tag"])
    texts = texts.groupBy("doc_id", "tag").agg(F.first("text").alias("text"), F.first("items").alias("items")) if tagged else texts
    bodies = scratch.save(_bodies(texts.select("doc_id", "tag", "text", "items"), length), "bodies")
    found = scratch.save(_runs(bodies, length), "found")
    scratch.drop("bodies")

    places = graded.where("group is null").select("doc_id", "tag", "place").union(found.where("window is null").select("doc_id", "tag", "place")).union(_across(found.where("window is not null")))
    removed = scratch.save(places.groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places")), "removed")
    scratch.drop("graded", "found")
    out = _apply(docs.join(removed, ["doc_id", "tag"], "left").select("doc_id", "text", "places"), length)
    own = F.nullif("doc_id", F.lit(_NO_ID))
    return out.withColumn("doc_id", own if gap is None else F.when(own <= gap, own - 1).otherwise(own))
