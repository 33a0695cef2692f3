"""Best-fit packing of tokenised documents, certified by dual-feasible lower bounds.

Documents are cut only where they are longer than a sequence. Pieces are dealt by hash into partitions of about
``bins_per_partition`` sequences; each packs its pieces by best-fit decreasing and compares its bin count with a lower
bound from dual feasible functions. Partitions at their bound are done, but for sequences that are far from full. All others
exchange their pieces under a new hash and pack again, into fewer partitions. A round that saves no sequence is dropped and
tried under another hash. Rounds end when the count reaches the bound of all pieces together (which follows
from the numbers of pieces by length), when what was exchanged is as full as it can be, or after some rounds without gain. Every
row carries its partition's bin count and bound, so what is not certified can be seen.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm import textops as T
from gridlume.llm.scratch import Scratch
from gridlume.llm.tokens import UnitTokenizer


def token_pieces(docs: DataFrame, tokenizer: str, max_len: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut into at most ``max_len``."""
    state: dict[str, UnitTokenizer] = {}
    end = end_id.to_bytes(4, "little")

    def run(part: T.Slice, batch: pa.RecordBatch) -> pa.RecordBatch:
        tok = state.get("t") or state.setdefault("t", UnitTokenizer(tokenizer))
        row, piece, start, length, crc = [], [], [], [], []
        ids, bounds = tok.ids(part)
        for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            n = b - a + 1
            for p, at in enumerate(range(0, n, max_len)):
                size = min(max_len, n - at)
                last = at + size == n
                value = zlib.crc32(ids[a + at : a + at + size - last])
                row.append(d), piece.append(p), start.append(at), length.append(size), crc.append(zlib.crc32(end, value) if last else value)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return T.map_slices(docs, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing of ``lengths`` needs at least."""
    return bound_of(*np.unique(lengths, return_counts=True), size)


def bound_of(lengths: np.ndarray, number: np.ndarray, size: int) -> int:
    """The same of ``number`` items of each of the ``lengths``: the best of three families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.zeros(size + 1, object)  # whole numbers of any size: a corpus has very many pieces
    count[lengths] = number
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // size)
    # over a threshold t: items above size - t fill a bin, items under t cost nothing
    upto, total = np.cumsum(count), np.cumsum(count * x)
    t = np.arange(1, size // 2 + 1)
    best = max(best, int((-(-((upto[-1] - upto[size - t]) * size + total[size - t] - total[t - 1]) // size)).max()))
    for k in range(1, 33):
        # rounded to k-ths of a bin; exact multiples of 1 / (k + 1) keep their size
        whole = ((k + 1) * x) % size == 0
        weight = np.where(whole, x * k, ((k + 1) * x // size) * size)
        best = max(best, -(-int((count * weight).sum()) // (size * k)))
    half = size // 2
    for t in (size // 3, size // 4, size // 5, size // 6):
        if t:
            # counted in units of t: large items by what they leave, half-size ones once
            most = size // t
            weight = np.where(x > half, 2 * (most - (size - x) // t), np.where((2 * x == size), most, 2 * (x // t)))
            best = max(best, -(-int((count * weight).sum()) // (2 * most)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins; among bins with room, the fullest takes the item."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]
    open_, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_ ^= 1 << left
        else:
            left, b, used = size, used, used + 1
        bins[i], offsets[i] = b, size - left
        if left > n:
            room[left - n].append(b)
            open_ |= 1 << (left - n)
    return bins, offsets, used


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, load long, part_bins long, part_bound long"
#: Pieces that meet in one task at most, on average.
PIECES_PER_PARTITION = 500_000
#: Texts that are handed to the tokenizer's worker at once: both sides of the pipe hold a batch.
TEXTS_PER_BATCH = 1000


def _pack(pieces: DataFrame, parts: int, salt: int, size: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, size)
        load = np.bincount(bins, lengths, used).astype(np.int64)[bins]
        same = np.ones(len(lengths), np.int64)
        for name, own in (("bin", bins), ("offset", offsets), ("load", load), ("part_bins", same * used), ("part_bound", same * lower_bound(lengths, size))):
            table = table.append_column(name, pa.array(own, pa.int64()))
        return table

    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("doc_id", "piece", "nr", F.lit(salt)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInArrow(run, _PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, bins_per_partition: int = 2048, rounds: int = 16, patience: int = 2) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound`` for every piece of every document.

    A document is its ids (tokenizer file ``tokenizer``, no special tokens added) and ``end_id``; a null or empty text is
    ``end_id`` alone. Only longer documents are cut, into pieces of ``size`` ids. Rows with a null id or a repeated id
    are packed like any other. part_bins are the sequences of the piece's last partition, part_bound those that any packing of
    its pieces needs. At most ``rounds`` exchanges are made, and ``patience`` more after one that saves nothing. Other columns are not read;
    an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # written, so a piece's number is fixed; it deals rows that share id and piece apart
    pieces = scratch.save(token_pieces(docs, tokenizer, size, end_id).withColumn("nr", F.monotonically_increasing_id()), "pieces", batch_rows=TEXTS_PER_BATCH)
    by_length = pieces.groupBy("length").count().toArrow()  # at most ``size`` rows
    lengths, number = by_length["length"].to_numpy(), by_length["count"].to_numpy()
    n, tokens, bound = int(number.sum()), int((lengths * number).sum()), bound_of(lengths, number, size)
    parts = max(1, -(-tokens // (size * bins_per_partition)), -(-n // PIECES_PER_PARTITION))
    now = scratch.save(_pack(pieces, parts, 0, size), "round-0")
    done, used, failed = [now.withColumn("round", F.lit(0))], _bins(now), 0
    for k in range(1, rounds + 1):
        if used <= bound or failed > patience:
            break
        loose = (F.col("part_bins") > F.col("part_bound")) | (F.col("load") * 4 <= size * 3)
        moved = now.where(loose)
        before, parts, tokens, n = moved.groupBy("part", "bin").agg(F.max("load").alias("load"), F.count("*").alias("n")).agg(F.count("*"), F.countDistinct("part"), F.coalesce(F.sum("load"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if before <= -(-tokens // size):
            break
        fewer = max(1, -(-n // PIECES_PER_PARTITION), min(parts // 2, -(-tokens // (size * bins_per_partition)) * 2))
        again = scratch.save(_pack(moved.withColumn("nr", F.xxhash64("part", "bin", "offset")), fewer, k, size), f"round-{k}")
        after = _bins(again)
        if after >= before:
            failed += 1
            scratch.drop(f"round-{k}")
            continue
        failed, used = 0, used - before + after
        done[-1] = done[-1].where(~loose)
        done.append(again.withColumn("round", F.lit(k)))
        now = again
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", ((F.col("round").cast("long") * (1 << 24) + F.col("part")) * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset", "part_bins", "part_bound")


def _bins(packed: DataFrame) -> int:
    return packed.groupBy("part").agg(F.max("part_bins").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
