"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds the hashes of its distinct k-word shingles. Two collections of ``side`` short keys, each key
made of ``rows`` minhashes, give ``side * side`` tables: table (i, j) is keyed by key i of the first collection with key
j of the second, so 2 * side * rows minhashes do the work of side * side * 2 * rows. With the defaults (17 and 3: 102
minhashes, 289 tables of 6) a pair of similarity 0.8 is missed with probability 1e-5, one of 0.9 with 3e-10.

1. Equal sets are one class; only its least document goes on (pre-aggregated, so a huge group of copies is one row).
2. Keys of the first collection that only one class has cannot lead to a pair; only the others are combined with the
   second collection. The pair tables that remain are grouped by key.
3. Each class is held against the least class of each of its tables, on full sets. Components of these links are formed.
4. Documents of tables that still hold several components are compared across components by an exact prefix join: with
   shingles in order of rising frequency, two similar sets share one of their first few, at places and sizes that leave
   room for the overlap. A document with many shingles of its own has nothing to join on. The join also compares bitmaps
   of the sets: their differing bits are no more than the elements that only one set has, so what the bitmaps turn away
   is never a link. What remains is verified on full sets. A group of k near copies costs about k verifications, and of a
   family of k texts from one template, all below the similarity, only pairs that come close to it leave the join.

Classes are numbered when their table is written; ids come back only at the end. Rows that share an id but not the text
are therefore told apart, and ids may be any 64-bit numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlume.llm import textops as T
from gridlume.llm.components import connected_components
from gridlume.llm.scratch import Scratch
from gridlume.runtime import unused

SIDE, ROWS = 17, 3
#: Bits of the bitmaps that the exact join compares, as words of 64.
MAP_WORDS = 4
_MAP = [f"m{i}" for i in range(MAP_WORDS)]


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(977))
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def _minhashes(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (sets >> T.U64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        v = a[:, None] * x[None, i : i + 512]
        v += b[:, None]
        v ^= v >> np.uint32(15)
        np.minimum(least, v.min(axis=1), out=least)
    return least


def _bitmap(sets: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of the set's elements fall on it: two sets differ in no fewer elements than bits."""
    odd = np.bincount((sets >> T.U64(20)).astype(np.int64) % (64 * MAP_WORDS), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(docs: DataFrame, k: int, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """``doc_id, text_key, n_shingles, fp, a, b, sig, m0...``: the row, its set's size, fingerprint, key collections, low bytes of
    the minhashes, and bitmap."""
    a, b = _permutations(2 * side * rows)

    def run(part: T.Slice, batch: pa.RecordBatch) -> pa.RecordBatch:
        size, fp, keys, sig, bitmap = [], [], [], [], []
        for s in T.shingle_sets(part, k):
            size.append(len(s)), bitmap.append(_bitmap(s))
            if not len(s):
                fp.append(None), keys.append(np.zeros((2 * side,), np.int64)), sig.append(b"")
                continue
            fp.append(xxhash.xxh3_128_digest(s.tobytes()))
            m = _minhashes(s, a, b)
            mixed = T.mix((m.reshape(2 * side, rows).astype(T.U64) * T._SHINGLE[:rows]).sum(axis=1, dtype=T.U64) + T._SHINGLE[20] * np.arange(1, 2 * side + 1, dtype=T.U64))
            keys.append(mixed.view(np.int64))
            sig.append((m >> np.uint32(11)).astype(np.uint8).tobytes())
        both = np.stack(keys)
        lists = [pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * side, pa.array(np.ascontiguousarray(x).ravel())) for x in (both[:, :side], both[:, side:])]
        maps = [pa.array(np.ascontiguousarray(x)) for x in np.stack(bitmap).T]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(fp, pa.binary()), *lists, pa.array(sig, pa.binary()), *maps], ["doc_id", "text_key", "n_shingles", "fp", "a", "b", "sig", *_MAP])

    return T.map_slices(docs.select("doc_id", "text_key", "text"), run, "doc_id long, text_key long, n_shingles long, fp binary, a array<long>, b array<long>, sig binary, " + ", ".join(f"{m} long" for m in _MAP))


def _similar_sizes(x: str, y: str, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _agree(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures do not rule the similarity out (five standard deviations below it; of true pairs at 0.8 a share of 2.4e-6 goes)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            n, p = x.shape[1], percent / 100
            keep = (x == y).sum(axis=1) >= n * p - 5 * (n * p * (1 - p)) ** 0.5
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in (0, 1)], ["x", "y"])

    return pairs.select("x", "y", "xs", "ys").mapInArrow(run, "x long, y long")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (x, y) whose full shingle sets reach the similarity; ``docs``: rep, text."""
    left = docs.select(F.col("rep").alias("x"), F.col("text").alias("tx"))
    right = docs.select(F.col("rep").alias("y"), F.col("text").alias("ty"))

    def sets(column: pa.Array) -> list[np.ndarray]:
        return [s for part in T.slices(column) for s in T.shingle_sets(part, k)]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                ok = []
                for p, q in zip(sets(b.column(2)), sets(b.column(3)), strict=True):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(bool(both) and 100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in (0, 1)], ["x", "y"])

    return pairs.join(left, "x").join(right, "y").select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def _prefix_pairs(open_: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (x, y) of classes of different components that can reach the similarity (``open_``: rep, comp, bitmap; ``docs``: rep, text).

    With shingles ordered by frequency, the first one that two similar sets share stands at places px, py with
    min(nx - px, ny - py) >= percent / (100 + percent) * (nx + ny). The smaller set shows a short beginning under its size's
    bucket; the larger one asks, for each shingle of its own beginning, only for the sizes that its place there allows.
    Two sets whose bitmaps differ in more bits than the similarity leaves elements to differ in are no pair.
    """

    def run(part: T.Slice, batch: pa.RecordBatch) -> pa.RecordBatch:
        own = list(T.shingle_sets(part, k))
        n = np.array([len(x) for x in own])
        row = pa.array(np.repeat(np.arange(len(own)), n))
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(np.repeat(n, n)), pa.array(np.concatenate(own).view(np.int64))], ["rep", "n", "shingle"])

    rows = T.map_slices(docs.join(open_.select("rep"), "rep").select("rep", "text"), run, "rep long, n long, shingle long")
    often = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    # places by a sort that spills, so that a text of any length needs no row that holds all its shingles
    ranked = rows.join(often, "shingle").withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle")) - 1)
    n, place = F.col("n"), F.col("place")
    begin = ranked.where((place < n - F.ceil(n * percent / 100) + 1) & (F.col("df") > 1)).select("rep", "n", "shingle", "place").join(open_, "rep")

    def bucket(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.03))).cast("int")

    small = begin.where(place <= n - F.ceil(n * 2 * percent / (100 + percent))).select("shingle", bucket(n).alias("bucket"), F.col("rep").alias("x"), F.col("comp").alias("xc"), n.alias("xn"), place.alias("xp"), *(F.col(m).alias(f"x{m}") for m in _MAP))
    least, most = F.ceil(n * percent / 100), F.least(n, F.floor((n - place) * (100 + percent) / percent - n + 1e-6))
    large = begin.where(least <= most).select("shingle", F.explode(F.sequence(bucket(least), bucket(most))).alias("bucket"), F.col("rep").alias("y"), F.col("comp").alias("yc"), n.alias("yn"), place.alias("yp"), *(F.col(m).alias(f"y{m}") for m in _MAP))
    both = F.col("xn") + F.col("yn")
    room = F.least(F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp")) * (100 + percent) >= both * percent
    bits = sum((F.bit_count(F.col(f"x{m}").bitwiseXOR(F.col(f"y{m}"))) for m in _MAP[1:]), F.bit_count(F.col(f"x{_MAP[0]}").bitwiseXOR(F.col(f"y{_MAP[0]}"))))
    fits = (F.col("xc") != F.col("yc")) & (F.col("xn") <= F.col("yn")) & (F.col("xn") * 100 >= F.col("yn") * percent) & room & (bits * (100 + percent) <= both * (100 - percent))
    found = small.join(large, (small["shingle"] == large["shingle"]) & (small["bucket"] == large["bucket"]) & fits)
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key`` for every row of ``docs`` (ids are integers of up to 64 bits).

    Words are runs of non-space bytes with A-Z lowered; documents with 100 * intersection >= percent * union of their
    k-word shingle sets are linked, and component_id is the least id reachable. Null and empty texts have no shingles
    and are linked with nothing. Texts of under ``shingle`` words count as one shingle. A row without an id is its own
    component (null) and kept. Rows that share an id but not the text are documents of their own, each in the component of its
    text; if one component holds several texts of its least id, the rows of one of them are kept. Rows that
    repeat id and text get equal results. text_key is the text's xxhash64 (null for a null text), to tell such rows apart.
    Other columns of ``docs`` are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    sigs = scratch.save(signatures(docs, shingle, side, rows), "sigs")
    lead = F.min_by(F.struct("n_shingles", "a", "b", "sig", *_MAP), F.struct("doc_id", "text_key"))
    classes = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), lead.alias("s")).select("fp", "at.*", "s.*")
    # a class's number is fixed by writing it
    classes = scratch.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    first = classes.select("rep", F.explode("a").alias("key"))
    crowded = first.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    hot = first.join(crowded, "key", "left_semi")
    paired = hot.join(classes.select("rep", "b"), "rep").select("rep", "key", F.explode("b").alias("second")).select("rep", F.xxhash64("key", "second").alias("key"))
    paired = scratch.save(paired, "paired")
    lead = paired.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    tables = scratch.save(paired.join(lead, "key"), "tables")
    scratch.drop("paired")

    # one row of each class that a table names: rows that repeat id and text are one
    named = classes.join(tables.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "text_key")
    near = docs.join(named, ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.first("rep").alias("rep"), F.first("text").alias("text")).select("rep", "text")
    near = scratch.save(near, "near")
    known = classes.select("rep", "n_shingles", "sig")
    x, y = (known.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"{c}n"), F.col("sig").alias(f"{c}s")) for c in "xy")
    stars = tables.where("rep <> lead").select(F.col("lead").alias("x"), F.col("rep").alias("y")).distinct()
    stars = _agree(stars.join(x, "x").join(y, "y").where(_similar_sizes("xn", "yn", percent)), percent)
    links = scratch.save(_verified(stars, near, shingle, percent), "links-star")
    comp = scratch.save(connected_components(links, scratch, "cc-star"), "comp-star")

    labelled = tables.select("key", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    open_ = labelled.join(mixed, "key", "left_semi").select("rep", "comp").distinct()
    open_ = scratch.save(open_.join(classes.select("rep", *_MAP), "rep"), "open")
    more = scratch.save(_verified(_prefix_pairs(open_, near, shingle, percent), near, shingle, percent), "links-cross")
    scratch.drop("tables", "open", "near")
    final = scratch.save(connected_components(links.union(more), scratch, "cc-final"), "comp")

    # a component's own row: its least id, and of that id's texts one
    own = F.struct("doc_id", "fp")
    linked = classes.join(final, F.col("rep") == F.col("node")).select("rep", own.alias("own"), "component")
    linked = linked.join(linked.groupBy("component").agg(F.min("own").alias("least")), "component").select("rep", "least")
    by_class = classes.select("rep", "fp", own.alias("own")).join(linked, "rep", "left").select("fp", F.coalesce("least", "own").alias("least"))
    by_class = by_class.select("fp", F.col("least.doc_id").alias("component"), F.col("least.fp").alias("least_fp"))
    out = sigs.select("doc_id", "text_key", "n_shingles", "fp").join(by_class, "fp", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce((own == F.col("doc_id")) & (F.col("least_fp").isNull() | (F.col("least_fp") == F.col("fp"))), F.lit(True))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), kept.alias("kept"), "text_key")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 1_000_000, **options) -> DataFrame:
    """``docs`` with one row left of each group of near duplicates; columns stay.

    The row left is the one of the least id. Rows that repeat id and text are one document, too: the least by the other
    columns (as JSON) stays. Rows without an id or without words stay as they are, each of them. Only ids and text hashes decide, never the
    id alone: other texts under a dropped row's id stay. Rows are matched in place if no more than ``most_broadcast``
    rows are affected (counted first), else by shuffle.
    """
    scratch = Scratch(docs.sparkSession, "neardup-rows")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("doc_id is not null and n_shingles > 0")
    # one row a distinct (id, text); a row that is fine as it is needs no mark
    marks = found.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    mid, mkey, mkept = (unused(docs, c) for c in ("_nd_id", "_nd_key", "_nd_kept"))
    marks = scratch.save(marks.select(F.col("doc_id").alias(mid), F.col("text_key").alias(mkey), F.col("kept").alias(mkept)), "marks")
    repeated = marks.where(mkept).limit(1).count() > 0
    if marks.limit(most_broadcast + 1).count() <= most_broadcast:
        marks = F.broadcast(marks)
    key = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    marked = docs.join(marks, (F.col(f"`{id_col}`").cast("long") == F.col(mid)) & (key == F.col(mkey)), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rest = marked.where(F.col(mid).isNull()).select(*own)
    if not repeated:
        return rest
    # the others that stay are rows that repeat id and text; as text they can be ordered whatever their types
    row = F.struct(*own)
    again = marked.where(mkept).groupBy(mid, mkey).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return rest.unionByName(again)
