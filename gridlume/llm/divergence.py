"""Divergence of sources within a language, counted by Arrow's own kernels.

1. Inside ``mapInArrow`` a slice of texts goes through ``ascii_lower``, ``split_pattern_regex`` and ``dictionary_encode``; hash
   ``group_by`` then counts each term's occurrences and documents. A task merges its slices' counts by another ``group_by`` and
   hands them on when there are too many, so it holds a bounded table whatever it reads.
2. Spark adds the partial counts up by language, source and term, and keeps terms of enough documents in the language.
3. The counts are cut into shards by term. A shard of a language meets the sizes of that language's sources, spreads its
   counts to columns (source x term, a block of terms at a time) and sums the divergence of every two sources over its terms;
   and it picks its own best terms of each source. Sums of shards are added, best terms of shards are ranked again.

A very common term is a row a task at most before it is shuffled, a large source is spread over all shards, and no text
is shuffled at all. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlume.llm import textops as T
from gridlume.llm.scratch import Scratch
from gridlume.runtime import ship

#: What stands between terms: all of ASCII but its letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Bytes of text a slice; rows and bytes of counts that a task holds before it hands them on.
_SLICE, _ROWS, _BYTES = 4 << 20, 300_000, 64 << 20
#: Rows of counts in a shard, on average; cells of a block of columns.
SHARD_ROWS, _CELLS = 200_000, 1 << 21

_COUNTS = ["lang", "source", "term", "n", "df"]


def _slice_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table | None:
    """``lang, source, term, n, df`` of some documents; each document is here as a whole."""
    words = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    doc, term = pc.list_parent_indices(words), pc.list_flatten(words)
    some = pc.greater(pc.binary_length(term), 0)
    doc, term = doc.filter(some), term.filter(some)
    if not len(term):
        return None
    coded = term.dictionary_encode()
    in_doc = pa.table({"doc": doc, "code": coded.indices}).group_by(["doc", "code"]).aggregate([([], "count_all")])
    at = in_doc["doc"]
    names = pa.table({"lang": lang.take(at.combine_chunks()), "source": source.take(at.combine_chunks()), "code": in_doc["code"], "n": in_doc["count_all"]})
    out = names.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    term = coded.dictionary.take(out["code"].combine_chunks())
    return pa.table([out["lang"], out["source"], term, out["n_sum"], out["n_count"]], _COUNTS)


def _merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(_COUNTS[:3]).aggregate([("n", "sum"), ("df", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "df_sum"]).rename_columns(_COUNTS)


def partial_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df`` of ``docs`` (``lang, source, text``, no nulls), several rows a key: those of tasks."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            lang, source, text = (batch.column(c).cast(pa.large_string()) for c in range(3))
            for part in T.slices(text, _SLICE):
                own = (c.slice(part.row, len(part)) for c in (lang, source, text))
                found = _slice_counts(*own)
                if found is None:
                    continue
                held.append(found)
                if sum(t.num_rows for t in held) > 2 * _ROWS or sum(t.nbytes for t in held) > _BYTES:
                    held = [_merged(held)]
                    if held[0].num_rows > _ROWS or held[0].nbytes > _BYTES // 2:
                        yield from held.pop().cast(schema).to_batches(_ROWS // 10)
        if held:
            yield from _merged(held).cast(schema).to_batches(_ROWS // 10)

    ship(docs.sparkSession)
    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, df long")


def _share(count: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / size), on numbers of any size."""
    if count.size and int(count.max()) + 2 > (2**63 - 1) // SCALE:
        return (1 + SCALE * (count.astype(object) + 2) // size).astype(np.int64)
    return 1 + SCALE * (count + 2) // size


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _shard(counts: pa.Table, sizes: pa.Table, smoothing: int, best: int) -> tuple[np.ndarray, list[tuple[int, str, int]]]:
    """Sums of the divergences of every two sources (rows of ``sizes``) over the terms of a shard, and each source's best terms.

    ``counts``: source, term, n, total; ``sizes``: source, size, lang_size, terms.
    """
    sources, size = sizes["source"].combine_chunks(), sizes["size"].to_numpy()
    n_sources = len(sources)
    sums, top = np.zeros((n_sources, n_sources), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n_sources
    if not counts.num_rows:
        return sums, []
    floor = smoothing * int(sizes["terms"][0].as_py())
    lang_size = int(sizes["lang_size"][0].as_py()) + floor
    counts = counts.sort_by("term")  # by bytes, so that places order terms
    term = counts["term"].combine_chunks().dictionary_encode()
    place, row = term.indices.to_numpy(), pc.index_in(counts["source"].combine_chunks(), sources).to_numpy()
    n, total = counts["n"].to_numpy(), counts["total"].to_numpy()
    width = max(1, _CELLS // n_sources)
    for a in range(0, len(term.dictionary), width):
        b = min(a + width, len(term.dictionary))
        lo, hi = np.searchsorted(place, [a, b])
        count, all_ = np.zeros((n_sources, b - a), np.int64), np.zeros(b - a, np.int64)
        count[row[lo:hi], place[lo:hi] - a] = n[lo:hi]
        all_[place[lo:hi] - a] = total[lo:hi]
        p, q = _share(count, (size + floor)[:, None]), _share(all_, lang_size)
        for i in range(n_sources - 1):
            sums[i, i + 1 :] += _apart(p[i], p[i + 1 :]).sum(axis=1)
        for i in range(n_sources):
            own = np.flatnonzero((count[i] > 0) & (p[i] > q))
            value = np.concatenate([top[i][0], _apart(p[i, own], q[own])])
            at = np.concatenate([top[i][1], own + a])
            order = np.lexsort((at, -value))[:best]
            top[i] = value[order], at[order]
    return sums + sums.T, [(i, term.dictionary[int(t)].as_py(), int(v)) for i in range(n_sources) for v, t in zip(*top[i], strict=True)]


def source_divergence(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, best: int = 10, smoothing: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from the others, and by which terms.

    Terms are runs of letters and of characters beyond ASCII, A-Z lowered. A language keeps the terms of at least
    ``least_docs`` of its documents. A source gives each of them the share p = 1 + floor(10**9 * (count + ``smoothing``) / (size + ``smoothing`` *
    terms)); two shares are floor((p - q)**2 / (p + q)) apart. Part ``pair``: the sum over all terms kept, for every
    other source of the language; part ``term``: the ``best`` terms that the source has in a larger share than the language. Ranks
    begin at 1, by value descending, then item by UTF-8 bytes.

    Null texts, languages and sources are empty strings. A source without terms has smoothed shares; a language without kept terms
    has pairs of value 0; one with a single source has none. Rows are documents whether or not their ids repeat; ids and other
    columns are not read. An empty table gives no rows. Values assume that a language keeps under 9e9 terms.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    docs = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    key = ["lang", "source"]
    counts = scratch.save(partial_counts(docs).groupBy(*key, "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    kept = scratch.save(counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= least_docs).drop("df"), "kept")
    rows = scratch.save(counts.join(kept, ["lang", "term"]).select(*key, "term", "n", "total"), "rows")
    scratch.drop("counts")
    sizes = docs.select(*key).distinct().join(rows.groupBy(*key).agg(F.sum("n").alias("size")), key, "left")
    sizes = sizes.join(kept.groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count("*").alias("terms")), "lang", "left").fillna(0, ["size", "lang_size", "terms"])
    shards = max(1, -(-rows.count() // shard_rows))

    def run(key: tuple, counts: pa.Table, sizes: pa.Table) -> pa.Table:
        sizes = sizes.sort_by("source")
        sums, terms = _shard(counts, sizes, smoothing, best)
        source = sizes["source"].combine_chunks()
        i, j = (x.ravel() for x in np.indices(sums.shape))
        i, j = i[i != j], j[i != j]
        at = pa.array(np.concatenate([i, np.array([t[0] for t in terms], np.int64)]))
        item = pa.concat_arrays([source.take(pa.array(j)), pa.array([t[1] for t in terms], source.type)])
        value = np.concatenate([sums[i, j], np.array([t[2] for t in terms], np.int64)])
        part = pa.array(["pair"] * len(i) + ["term"] * len(terms), pa.string())
        return pa.table([pa.repeat(key[0], len(at)).cast(pa.string()), source.take(at), part, item, pa.array(value)], ["lang", "source", "part", "item", "value"])

    left = rows.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards))).groupBy("lang", "shard")
    right = sizes.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).groupBy("lang", "shard")
    found = scratch.save(left.cogroup(right).applyInArrow(run, "lang string, source string, part string, item string, value long"), "found")
    pairs = found.where("part = 'pair'").groupBy(*key, "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= best)
    return pairs.withColumn("rank", rank).unionByName(terms).select(*key, "part", "item", "value", "rank")
