"""Cross-entropy difference between a target and a background n-gram model.

Both are interpolated bigram models over one vocabulary: every distinct word and every distinct pair of neighbours of the
corpus, named by a 63-bit hash and counted exactly, however many there are. The background counts every document and is
then scaled to the target's size. A document's score is the mean over its tokens of target loss less background loss, in
bits; low scores look like the target.

Counts never meet in one place. Documents are taken in chunks of some MB. A chunk sends its distinct n-grams, each once with
its own counts, to the task that holds that range of hashes; the range adds them up and answers every chunk with the
totals of what it asked for, in the order asked. The chunk's words travel along as indexes into its own word list.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm import textops as T
from gridlume.llm.membership import mark_members
from gridlume.runtime import ship

#: Megabytes of text in a chunk, and those that a range of hashes answers for.
CHUNK_MB, RANGE_MB = 12, 12

_HEAD = struct.Struct("<cqq")
_ROWS = "chunk long, part long, body binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string, each compressed with its bytes of like weight side by side."""
    out, codec = [], pa.Codec("zstd", compression_level=1)
    for x in arrays:
        planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
        body = codec.compress(planes, asbytes=True)
        out += [_HEAD.pack(x.dtype.char.encode(), len(x), len(body)), body]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at, codec = [], 0, pa.Codec("zstd")
    while at < len(data):
        char, n, size = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        kind = np.dtype(char.decode())
        planes = codec.decompress(data[at : at + size], n * kind.itemsize, asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return out


def _ngrams(hash_: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words, of the pair each ends, and which words end one; a word's key is even, a pair's odd."""
    inner = np.zeros(len(hash_), bool)
    inner[1:] = doc[1:] == doc[:-1]
    at = np.flatnonzero(inner)
    pair = T.mix(hash_[at - 1] * T._SHINGLE[0] + hash_[at] * T._SHINGLE[1])
    return hash_ & ~T.U64(1), pair | T.U64(1), inner


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of hashes begins in the ascending ``keys``, and the end."""
    return np.searchsorted(keys, np.array([min((i << 64) // parts, 2**64 - 1) for i in range(parts)], T.U64)).tolist() + [len(keys)]


def _requests(rows: DataFrame, parts: int, chunk_mb: int, documents: bool) -> DataFrame:
    """``chunk, part, body``: each chunk's distinct n-grams by range; under part -1 its documents, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            flags = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            for part in T.slices(batch.column(1), chunk_mb << 20):
                w = T.words(part)
                own = flags[part.row : part.row + len(part)][w.doc]
                words, pairs, inner = _ngrams(w.hash, w.doc)
                keys, n = np.unique(np.concatenate([words, pairs]), return_counts=True)
                n = n.astype(np.int32)  # a chunk's counts are far below 2**31
                of_target, m = np.unique(np.concatenate([words[own], pairs[own[inner]]]), return_counts=True)
                target = np.zeros(len(keys), np.int32)
                target[np.searchsorted(keys, of_target)] = m
                cuts = _ranges(keys, parts)
                out = [(p, _pack(np.diff(keys[a:b], prepend=T.U64(0)), n[a:b], target[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                if documents:
                    known, index = np.unique(w.hash, return_inverse=True)
                    ids = batch.column(0).slice(part.row, len(part))
                    valid = ids.is_valid().to_numpy(zero_copy_only=False)
                    out.append((-1, _pack(np.diff(known, prepend=T.U64(0)), index.astype(np.uint32), np.diff(w.first), ids.fill_null(0).to_numpy(), valid)))
                number, body = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(out), pa.int64()), pa.array(number, pa.int64()), pa.array(body, pa.binary())], ["chunk", "part", "body"])
                chunk += 1

    ship(rows.sparkSession)
    return rows.select("doc_id", "text", "target").mapInArrow(run, _ROWS)


def _totals(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one range: chunk bounds, each request's place among the distinct keys, those keys and their two counts."""
    asked = [_unpack(x.as_py()) for x in table["body"]]
    cuts = np.cumsum([0] + [len(x[0]) for x in asked]).tolist()
    keys, place = np.unique(np.concatenate([np.cumsum(x[0], dtype=T.U64) for x in asked]), return_inverse=True)
    count = []
    for k in (1, 2):
        total = np.zeros(len(keys), np.int64)
        for x, a, b in zip(asked, cuts, cuts[1:], strict=False):
            total[place[a:b]] += x[k]  # a request names a key once
        count.append(total)
    return cuts, place, keys, *count


def _answers(table: pa.Table) -> pa.Table:
    """Totals for every chunk that asked, and the range's share of the vocabulary and of all counts."""
    if table["part"][0].as_py() < 0:
        return table.select(["chunk", "part", "body"])
    cuts, place, keys, background, target = _totals(table)
    word = (keys & T.U64(1)) == 0
    whole = np.array([word.sum(), background[word].sum(), target[word].sum(), background.sum(), target.sum()], np.int64)
    body = [_pack(background[place[a:b]], target[place[a:b]], whole) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table([table["chunk"].combine_chunks(), table["part"].combine_chunks(), pa.array(body, pa.binary())], ["chunk", "part", "body"])


def ngram_counts(rows: DataFrame, parts: int, chunk_mb: int = CHUNK_MB) -> DataFrame:
    """``key, n_background, n_target``: one row for each distinct word (even key) and pair (odd key) of ``rows``."""

    def run(table: pa.Table) -> pa.Table:
        _, _, keys, background, target = _totals(table)
        return pa.table([pa.array(keys.view(np.int64)), pa.array(background), pa.array(target)], ["key", "n_background", "n_target"])

    asked = _requests(rows.select(F.lit(None).cast("long").alias("doc_id"), "text", "target"), parts, chunk_mb, False)
    return asked.groupBy("part").applyInArrow(run, "key long, n_background long, n_target long")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, *, strength: float = 8.0, id_col: str = "doc_id", text_col: str = "text", chunk_mb: int = CHUNK_MB, range_mb: int = RANGE_MB) -> DataFrame:
    """``doc_id, n_tokens, target_bits, background_bits, difference`` for every row.

    ``target_ids`` (one column) names the target documents. p(w | v) = (count(v, w) + strength * p(w)) / (count(v) +
    strength), p(w) add-one smoothed over the distinct words of the corpus. Null and empty texts have no tokens and a null
    score. Null and repeated ids are rows like any other. The texts' bytes are counted first and give the number of hash
    ranges, so a task holds about ``range_mb`` of text's n-grams at any input size; nothing goes to the driver or to all tasks.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (range_mb << 20)))

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        if table["part"].to_pylist() != list(range(-1, parts)):
            raise ValueError("a chunk's documents or answers are not whole; the input changed between attempts of a task")
        known, index, n, ids, valid = _unpack(table["body"][0].as_py())
        hash_ = np.cumsum(known, dtype=T.U64)[index]
        doc = np.repeat(np.arange(len(n)), n)
        words, pairs, inner = _ngrams(hash_, doc)
        keys = np.unique(np.concatenate([words, pairs]))
        one, two = np.searchsorted(keys, words), np.searchsorted(keys, pairs)
        answers = [_unpack(x.as_py()) for x in table["body"].slice(1)]
        vocabulary, *whole = np.sum([x[2] for x in answers], axis=0).tolist()
        losses = []
        for k, scale in ((0, whole[3] / whole[2] if whole[3] else 1.0), (1, 1.0)):  # the models are matched in size, so unseen words cost both the same
            count = np.concatenate([x[k] for x in answers]) * scale
            p = (count[one] + 1.0) / (whole[k] * scale + vocabulary)
            p[inner] = (count[two] + strength * p[inner]) / (count[one[np.flatnonzero(inner) - 1]] + strength)
            losses.append(np.bincount(doc, -np.log2(p), len(n)))
        some = n > 0
        each = [np.divide(x, n, out=np.zeros(len(n)), where=some) for x in losses]
        cols = [pa.array(x, mask=~some) for x in (each[1], each[0], each[1] - each[0])]
        return pa.table([pa.array(ids, mask=~valid), pa.array(n.astype(np.int64)), *cols], ["doc_id", "n_tokens", "target_bits", "background_bits", "difference"])

    asked = _requests(mark_members(texts, target_ids), parts, chunk_mb, True)
    # documents pass the first exchange as groups of their own
    group = F.when(F.col("part") < 0, -1 - F.col("chunk")).otherwise(F.col("part"))
    answers = asked.groupBy(group.alias("group")).applyInArrow(_answers, _ROWS)
    return answers.groupBy("chunk").applyInArrow(score, "doc_id long, n_tokens long, target_bits double, background_bits double, difference double")
