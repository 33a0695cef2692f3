"""Vectorised work on Arrow text columns: words, rolling hashes and shingles of many documents at once.

Texts stay in their UTF-8 buffers. A batch is walked in slices of a few MB, so that memory does not
follow the batch; a slice never cuts a document. Hashes are 64-bit polynomial prefix hashes over random
byte values with a final mixer; they are the same in every process.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from gridlume.runtime import ship

U64 = np.uint64
SLICE_BYTES = 1 << 20
#: Bytes hashed in one go, and the longest string that the prefix hash covers (longer ones: xxhash).
BLOCK, LONG = 1 << 17, 1024
BASE = 0x9E3779B97F4A7C15 | 1

_rng = np.random.Generator(np.random.PCG64(20240607))
TABLE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


POW = _powers(BASE, BLOCK + LONG + 1)
INV = _powers(pow(BASE, -1, 1 << 64), BLOCK + LONG + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix hashes of at most BLOCK + LONG bytes; substring i..j hashes to (p[j] - p[i]) * INV[i]."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(TABLE[buf] * POW[: len(buf)], out=out[1:])
    return out


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings buf[start:end]; start ascends."""
    out = np.empty(len(start), U64)
    cuts = np.searchsorted(start, np.arange(0, len(buf) + BLOCK, BLOCK))
    for k in range(len(cuts) - 1):
        i, j = cuts[k], cuts[k + 1]
        if i < j:
            at = k * BLOCK
            p = prefix(buf[at : at + BLOCK + LONG])
            s, e = start[i:j] - at, np.minimum(end[i:j] - at, len(p) - 1)
            out[i:j] = (p[e] - p[s]) * INV[s]
    for i in np.flatnonzero(end - start > LONG):
        out[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]].tobytes())
    return mix(out + (end - start).astype(U64))


@dataclass
class Slice:
    """Some rows of a batch: their bytes one after another, and where each begins."""

    row: int
    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The rows of a string column, nulls as empty texts, in slices of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def map_slices(df: DataFrame, fn: Callable[[Slice, pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """Apply ``fn(slice, its rows)`` to every slice of ``df``'s text column; Arrow in and out, no rows held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(batch.schema.get_field_index(text))):
                out = fn(part, batch.slice(part.row, len(part)))
                if out is not None and out.num_rows:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def filter_slices(df: DataFrame, keep: Callable[[Slice], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text ``keep`` marks true; columns stay as they are, and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.string())
            marks = [np.asarray(keep(part), bool) for part in slices(column)]
            if marks:
                yield batch.filter(pa.array(np.concatenate(marks)))

    ship(df.sparkSession)
    return df.mapInArrow(run, df.schema)


@dataclass
class Words:
    """Words of a slice: byte range, document, hash; ``first[d]:first[d + 1]`` are those of document d."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(part: Slice, lower: bool = True, space: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that ``space`` does not hold, hashed (in lower case if asked for)."""
    buf = LOWER[part.buf] if lower else part.buf
    inside = ~space[buf]
    begins, ends = inside.copy(), inside.copy()
    if len(buf):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = part.offsets[:-1][part.offsets[:-1] < len(buf)]
        begins[edge] = inside[edge]
        edge = part.offsets[1:][part.offsets[1:] > 0] - 1
        ends[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, part.offsets)
    doc = np.repeat(np.arange(len(part)), np.diff(first))
    return Words(start, end, doc, hash_spans(buf, start, end), first)


_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def shingles(w: Words, k: int, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one document, and the index of the word each begins with."""
    codes = w.hash if codes is None else codes
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    for i in range(k):
        total += codes[i : i + n] * _SHINGLE[i]
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    return mix(total[at]), at


def shingle_sets(part: Slice, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles; one for the whole of a shorter text."""
    w = words(part, lower)
    value, at = shingles(w, k)
    cut = np.searchsorted(at, w.first)
    for d in range(len(part)):
        n = w.first[d + 1] - w.first[d]
        if n >= k:
            yield np.unique(value[cut[d] : cut[d + 1]])
        elif n:
            own = w.hash[w.first[d] : w.first[d + 1]]
            yield mix((own * _SHINGLE[:n]).sum(dtype=U64, keepdims=True) + _SHINGLE[63 - n : 64 - n])
        else:
            yield np.zeros(0, U64)
