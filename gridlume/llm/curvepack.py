"""Packing along a space-filling curve: documents that are alike become neighbours, in one sequence or the next.

1. A document's token ids are counted in hashed buckets (square roots of counts, so the vector's length is the root of the
   number of ids), and the vector of length one is projected to a few dimensions by fixed random signs.
2. Each dimension is centred and scaled by its mean and deviation over all documents, squeezed to whole numbers, and the place of
   that point on a Hilbert curve is the document's key.
3. Documents are range-partitioned and sorted by key; running sums within ranges and the ranges' totals give each document its
   first position in one endless row of tokens, which is cut at every multiple of the sequence length. All sequences are
   full; what is left at the very end is cut at powers of two, so there is no padding at all.

Only keys and lengths are sorted. The ids, two bytes each where the vocabulary allows it, are written once and meet their position
in a join on a row's own number, so equal documents, however many, are spread evenly everywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm import textops as T
from gridlume.llm.scratch import Scratch
from gridlume.llm.tokens import UnitTokenizer

BUCKETS, DIMS, BITS = 1024, 6, 10
#: A projected vector of length one as whole numbers, so that sums over documents are exact.
UNIT = 1024
_DOCS = 1024


def _signs(dims: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(4242))
    return rng.integers(0, 2, (BUCKETS, dims)).astype(np.float32) * 2 - 1


def projected(ids: np.ndarray, bounds: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Each document's hashed vector, projected: (documents, dims) whole numbers; an empty document is the origin."""
    bucket = (T.mix(ids.astype(T.U64) + T.U64(1)) & T.U64(BUCKETS - 1)).astype(np.int64)
    out = np.zeros((len(bounds) - 1, signs.shape[1]), np.int32)
    for a in range(0, len(out), _DOCS):
        b = min(a + _DOCS, len(out))
        size = np.diff(bounds[a : b + 1])
        cell = np.repeat(np.arange(b - a) * BUCKETS, size) + bucket[bounds[a] : bounds[b]]
        vector = np.sqrt(np.bincount(cell, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)).astype(np.float32)
        out[a:b] = np.rint(UNIT * (vector @ signs) / np.sqrt(np.maximum(size, 1))[:, None])
    return out


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of ``points`` (rows of numbers below 2 ** ``bits``) on the Hilbert curve through the cube; dims * bits up to 63.

    Published method of 2004: the axes are turned level by level until plain Gray code runs along the curve, then their
    bits are interleaved.
    """
    x = np.array(points.T, np.int64)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(len(x)):
            inside = (x[axis] >> level & 1).astype(bool)
            swap = np.where(inside, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(inside, low, swap)
            if axis:
                x[axis] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis >> level & 1)
    return key


def _coded(docs: DataFrame, tokenizer: str, end_id: int, dims: int) -> DataFrame:
    """``doc_id, n, ids, point``: each document's ids with ``end_id``, as bytes, and its projected vector."""
    state: dict[str, UnitTokenizer] = {}
    signs = _signs(dims)

    def run(part: T.Slice, batch: pa.RecordBatch) -> pa.RecordBatch:
        tok = state.get("t") or state.setdefault("t", UnitTokenizer(tokenizer))
        ids, bounds = tok.ids(part)
        ended = np.insert(ids, bounds[1:], end_id)
        wide = "<u4" if max(len(tok.ends) - 1, end_id) >= 1 << 16 else "<u2"
        upto = (bounds + np.arange(len(bounds))) * np.dtype(wide).itemsize
        blob = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(ended.astype(wide))])
        points = pa.FixedSizeListArray.from_arrays(pa.array(projected(ids, bounds, signs).ravel()), dims).cast(pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds) + 1), pa.array(np.full(len(part), np.dtype(wide).itemsize, np.int32)), blob, points], ["doc_id", "n", "wide", "ids", "point"])

    return T.map_slices(docs, run, "doc_id long, n long, wide int, ids binary, point array<int>")


def _keyed(coded: DataFrame, dims: int, bits: int) -> DataFrame:
    """``nr, doc_id, n, key`` of every row: mean and deviation of all documents lay the curve's cube around them."""
    at = [F.col("point")[i].cast("long") for i in range(dims)]
    stats = coded.agg(F.count("*"), *(F.sum(x) for x in at), *(F.sum(x * x) for x in at)).first()
    n, total, square = stats[0], np.array([x or 0 for x in stats[1 : dims + 1]], object), np.array([x or 0 for x in stats[dims + 1 :]], object)
    mean = (total / max(n, 1)).astype(float)
    spread = np.sqrt(np.maximum((square / max(n, 1)).astype(float) - mean**2, 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point = batch.column(3).flatten().to_numpy().reshape(-1, dims)
            share = 1 / (1 + np.exp(-1.702 * (point - mean) / spread))  # near the normal distribution's
            key = hilbert_keys(np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(key)], ["nr", "doc_id", "n", "key"])

    return coded.select("nr", "doc_id", "n", "point").mapInArrow(run, "nr long, doc_id long, n long, key long")


def _placed(keyed: DataFrame) -> DataFrame:
    """``nr, part, at, n, key``: the range of each row along the curve, and the tokens of that range before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column(1).to_numpy()
            upto = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(upto - n), batch.column(1), batch.column(2)], ["nr", "part", "at", "n", "key"])
            before = int(upto[-1]) if len(n) else before

    order = ["key", "doc_id", "nr"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("nr", "n", "key").mapInArrow(run, "nr long, part long, at long, n long, key long")


def sequence_cuts(tokens: int, size: int) -> tuple[int, np.ndarray]:
    """Where full sequences end in a row of so many tokens, and where those of the rest begin (powers of two, and its end)."""
    rest = tokens % size
    lengths = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return tokens - rest, tokens - rest + np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def pack_along_curve(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key`` for every piece of every document.

    A document is its ids (tokenizer file ``tokenizer``, no special tokens added) and ``end_id``; a null or empty text is ``end_id``
    alone. Documents follow one another by their key on the curve, equal keys by id, in sequences of ``size`` ids; what
    is left at the end fills sequences whose lengths are powers of two. sequence_id ascends along the curve, so
    neighbours of a sequence are neighbours in content. Rows with a null or repeated id are packed like any other. Other columns
    are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "curvepack")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # written, so that a row's number is fixed
    coded = scratch.save(_coded(docs, tokenizer, end_id, dims).withColumn("nr", F.monotonically_increasing_id()), "coded")
    placed = scratch.save(_placed(_keyed(coded, dims, bits)), "placed")
    totals = placed.groupBy("part").agg(F.sum("n").alias("n")).collect()  # a row a range
    first = np.zeros(1 + max((r["part"] for r in totals), default=-1), np.int64)
    for r in totals:
        first[r["part"]] = r["n"]
    tokens = int(first.sum())
    first = np.cumsum(first) - first
    full, rest = sequence_cuts(tokens, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, at, wide = (batch.column(c).to_numpy() for c in range(2, 5))
            row, start, length, crc, total, seq, offset = [], [], [], [], [], [], []
            for d, (blob, p) in enumerate(zip(batch.column(1), (first[part] + at).tolist(), strict=True)):
                ids = np.frombuffer(blob.as_buffer(), f"<u{wide[d]}").astype("<u4")
                n = len(ids)
                cuts = [p, *range((p // size + 1) * size, min(p + n, full), size), *(c for c in rest.tolist() if p < c < p + n), p + n]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    tail = int(np.searchsorted(rest, a, "right")) - 1
                    begins = a // size * size if tail < 0 else int(rest[tail])
                    row.append(d), start.append(a - p), length.append(b - a), crc.append(zlib.crc32(ids[a - p : b - p])), total.append(n)
                    seq.append(a // size if tail < 0 else full // size + tail), offset.append(a - begins)
            longs = (pa.array(x, pa.int64()) for x in (start, length, crc, total, seq, offset))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *longs, batch.column(5).take(pa.array(row, pa.int64()))], _OUT)

    rows = coded.select("nr", "doc_id", "wide", "ids").join(placed.drop("n"), "nr")
    return rows.select("doc_id", "ids", "part", "at", "wide", "key").mapInArrow(run, ", ".join(f"{c} long" for c in _OUT))


_OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"]
