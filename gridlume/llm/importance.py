"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and word pairs are hashed into ``buckets``; both models are smoothed bucket frequencies. A document's log
weight is the sum of log(target / raw) over its n-grams. Adding standard Gumbel noise and taking the k largest draws k documents
without replacement in proportion to their weights. The noise is a hash of the id, so results repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm import textops as T
from gridlume.llm.membership import mark_members
from gridlume.llm.scratch import Scratch
from gridlume.runtime import ship


def _buckets(part: T.Slice, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word and word pair."""
    w = T.words(part)
    pairs, at = T.shingles(w, 2)
    return np.concatenate([w.doc, w.doc[at]]), (np.concatenate([w.hash, pairs]) % T.U64(buckets)).astype(np.int64)


def bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n_raw, n_target`` over all of ``rows`` (``text``, ``target`` boolean); one row a bucket at most."""

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            flags = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for part in T.slices(batch.column(0)):
                doc, code = _buckets(part, buckets)
                total[0] += np.bincount(code, minlength=buckets)
                total[1] += np.bincount(code[flags[part.row : part.row + len(part)][doc]], minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "n_raw", "n_target"])

    ship(rows.sparkSession)
    counts = rows.select("text", "target").mapInArrow(run, "bucket long, n_raw long, n_target long")
    return counts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def top_k_threshold(scored: DataFrame, k: int, bins: int = 2048, few: int = 4096) -> tuple[float, int] | None:
    """(key, tie) of the k-th row by key descending, then tie ascending; null if there are no more than k rows.

    Counts by key range narrow the place down; only rows of the last range (at most ``few``, or equal keys' ties in
    ranges of ``tie``) reach the driver.
    """
    n, lo, hi = scored.agg(F.count("key"), F.min("key"), F.max("key")).first()
    if n <= k:
        return None
    above = 0
    while n > few and lo < hi:
        width = (hi - lo) / bins
        if lo + width <= lo:
            break
        own = scored.where(F.col("key").between(lo, hi)).select("key", F.least(F.lit(bins - 1), F.floor((F.col("key") - lo) / width)).alias("bin"))
        table = own.groupBy("bin").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("bin")).collect()
        for r in table:
            if above + r["n"] >= k:
                n, lo, hi = r["n"], r["lo"], r["hi"]
                break
            above += r["n"]
        if len(table) == 1:
            break
    rows = scored.where(F.col("key").between(lo, hi)).select("key", "tie").orderBy(F.desc("key"), "tie").limit(k - above).collect()
    return rows[-1]["key"], rows[-1]["tie"]


def importance_resample(docs: DataFrame, target_ids: DataFrame, *, fraction: float = 0.8, k: int | None = None, buckets: int = 1 << 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, log_weight, gumbel_key, kept`` for every row with an id; kept: among the k largest keys.

    ``target_ids`` (one column of ids) names the target documents; k defaults to ``fraction`` of the rows. Both models count
    all documents. Null texts have weight 0; rows without an id are left out. Equal keys go by id; rows that repeat id and text are
    drawn together, so more than k rows stay where the last place falls on such rows. Without target documents all weights are alike.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = mark_members(texts, target_ids)
    model = bucket_counts(marked, buckets).toPandas()  # at most one row a bucket
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[model["bucket"]] += model["n_raw"]
    target[model["bucket"]] += model["n_target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if len(model) and model["n_target"].sum() else np.zeros(buckets)

    def run(part: T.Slice, batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, code = _buckets(part, buckets)
        weight = np.bincount(doc, ratio[code], len(part))
        ids = batch.column(0).to_numpy()
        u = (T.mix(ids.astype(np.int64).view(T.U64) * T.U64(0x9E3779B97F4A7C15) + T.U64(seed + 1)) >> T.U64(11)).astype(np.float64)
        noise = -np.log(-np.log((u + 0.5) / 2.0**53))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(weight + noise)], ["doc_id", "log_weight", "gumbel_key"])

    scored = scratch.save(T.map_slices(texts, run, "doc_id long, log_weight double, gumbel_key double"), "scored")
    k = int(round(scored.count() * fraction)) if k is None else k
    edge = top_k_threshold(scored.select(F.col("gumbel_key").alias("key"), F.col("doc_id").alias("tie")), k) if k > 0 else (float("inf"), 0)
    kept = F.lit(True) if edge is None else (F.col("gumbel_key") > edge[0]) | ((F.col("gumbel_key") == edge[0]) & (F.col("doc_id") <= edge[1]))
    return scored.withColumn("kept", kept)
