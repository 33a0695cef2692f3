"""Toxicity by a classifier chain.

Categories are predicted one after another. Each link is a logistic model over word and word-beginning features plus the
probabilities of the links before it; while it is trained those come from out-of-fold predictions, so that
a link never learns from answers its predecessors have seen. Features are chosen per link by their likelihood ratio.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlume.llm import textops as T
from gridlume.llm.scratch import Scratch

#: Letters of a word's beginning that make a feature besides the whole word.
BEGINNINGS = (4, 5, 6)
BITS = 22
#: Probability of the last category from which a document is rejected; the classes lie far apart on both sides.
THRESHOLD = 0.05
#: Everything but letters, digits and bytes beyond ASCII divides words.
_DIVIDES = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
_MARKS = b"#*$%&|<>!"


def features(part: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs of a slice, some of them twice: words, their beginnings, and odd marks."""
    w = T.words(part, True, _DIVIDES)
    buf = T.LOWER[part.buf]
    doc, code = [w.doc], [w.hash]
    for n in BEGINNINGS:
        at = np.flatnonzero(w.end - w.start > n)
        doc.append(w.doc[at])
        code.append(T.hash_spans(buf, w.start[at], w.start[at] + n) + T.U64(n))
    for c in _MARKS:
        at = np.flatnonzero(buf == c)
        doc.append(np.searchsorted(part.offsets, at, "right") - 1)
        code.append(np.full(len(at), T.mix(np.array([c + 1000], T.U64))[0]))
    return np.concatenate(doc), (np.concatenate(code) >> T.U64(64 - BITS)).astype(np.int32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps; classes weigh alike up to a factor of 4."""
    x = np.hstack([x, np.ones((len(x), 1))])
    pos = max(y.mean(), 1e-6)
    weight = np.where(y > 0, min(4.0, max(1.0, (1 - pos) / pos)), 1.0)
    beta = np.zeros(x.shape[1])
    penalty = np.full(len(beta), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return beta


@dataclass
class Link:
    """One model of the chain: chosen features (ascending), their weights, those of earlier links, the intercept."""

    name: str
    chosen: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def scores(self, doc: np.ndarray, code: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        z = np.full(n, self.bias) + (before @ self.chain if len(self.chain) else 0)
        if len(self.chosen) and len(code):
            place = np.minimum(np.searchsorted(self.chosen, code), len(self.chosen) - 1)
            hit = np.flatnonzero(self.chosen[place] == code)
            pairs = np.unique(doc[hit].astype(np.int64) * len(self.chosen) + place[hit])
            z += np.bincount(pairs // len(self.chosen), self.weights[pairs % len(self.chosen)], n)
        return _sigmoid(z)


def _choose(doc: np.ndarray, code: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The features with the largest likelihood-ratio statistic against the class; pairs are distinct."""
    pos, n = y.sum(), len(y)
    seen = np.bincount(code, minlength=1 << BITS)
    names = np.flatnonzero(seen >= 2).astype(np.int32)
    both = np.bincount(code[(y > 0)[doc]], minlength=1 << BITS)[names].astype(float)
    seen = seen[names].astype(float)

    def part(a, of):
        return a * np.log(np.maximum(a, 1e-9) / np.maximum(of, 1e-9))

    g = part(both, seen * pos / n) + part(seen - both, seen * (n - pos) / n) + part(pos - both, (n - seen) * pos / n) + part(n - pos - seen + both, (n - seen) * (n - pos) / n)
    best = np.argsort(-g, kind="stable")[:most]
    return np.sort(names[best[g[best] > 3]])


def _fit_link(name: str, doc: np.ndarray, code: np.ndarray, y: np.ndarray, before: np.ndarray, most: int, ridge: float) -> Link:
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        rate = float(y.mean()) if len(y) else 0.0
        return Link(name, np.zeros(0, np.int32), np.zeros(0), np.zeros(before.shape[1]), float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    chosen = _choose(doc, code, y, most)
    x = np.zeros((len(y), len(chosen)))
    if len(chosen):
        place = np.minimum(np.searchsorted(chosen, code), len(chosen) - 1)
        hit = chosen[place] == code
        x[doc[hit], place[hit]] = 1
    beta = _logistic(np.hstack([x, before]), y, ridge)
    k = len(chosen)
    return Link(name, chosen, beta[:k], beta[k:-1], float(beta[-1]))


def fit_chain(doc: np.ndarray, code: np.ndarray, labels: dict[str, np.ndarray], *, folds: int = 5, most: int = 600, ridge: float = 0.1) -> list[Link]:
    """Links in the order of ``labels`` (0/1 arrays) from distinct (document, feature) pairs of the training documents."""
    n = len(next(iter(labels.values())))
    fold = np.arange(n) % folds
    out_of_fold, chain = np.zeros((n, 0)), []
    for name, y in labels.items():
        y = y.astype(float)
        own = np.zeros(n)
        for f in range(folds):
            train, rest = fold != f, np.flatnonzero(fold == f)
            number = (np.cumsum(train) - 1).astype(np.int32)
            pick = train[doc]
            link = _fit_link(name, number[doc[pick]], code[pick], y[train], out_of_fold[train], most, ridge)
            held = ~pick
            back = np.full(n, -1, np.int32)
            back[rest] = np.arange(len(rest))
            own[rest] = link.scores(back[doc[held]], code[held], len(rest), out_of_fold[rest])
        chain.append(_fit_link(name, doc, code, y, out_of_fold, most, ridge))
        out_of_fold = np.hstack([out_of_fold, own[:, None]])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 6000, max_pairs: int = 20_000_000) -> list[Link]:
    """The chain from labelled documents. ``categories``: name -> SQL condition on ``labels`` that marks its members.

    At most ``max_labelled`` labelled ids, chosen by hash, are used, one text of each (the least by hash, if rows repeat the id), and
    of those as many, in that order, as have ``max_pairs`` distinct features together; that bounds the rows and the bytes
    that reach the driver. Ids that are null are not used, those with several labels once (the largest condition wins).
    """
    conditions = [F.max(F.coalesce(F.expr(c).cast("int"), F.lit(0))).alias(name) for name, c in categories.items()]
    own = labels.where(f"`{id_col}` is not null").groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*conditions)
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(own), "doc_id")  # bounded by max_labelled
    one = rows.groupBy("doc_id", *(F.col(c) for c in categories)).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(part: T.Slice, batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, code = features(part)
        pairs = np.unique(doc.astype(np.int64) << BITS | code)
        cut = np.searchsorted(pairs >> BITS, np.arange(len(part) + 1))
        codes = pa.ListArray.from_arrays(cut.astype(np.int32), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), codes, *(batch.column(i) for i in range(2, batch.num_columns))], ["doc_id", "codes", *categories])

    found = T.map_slices(one.select("doc_id", "text", *categories), run, "doc_id long, codes array<int>, " + ", ".join(f"`{c}` int" for c in categories))
    found = Scratch(docs.sparkSession, "toxicity").save(found, "features")
    # one window over at most max_labelled numbers
    upto = F.sum(F.size("codes")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    some = found.select("doc_id", upto.alias("upto")).where(F.col("upto") <= max_pairs).select("doc_id")
    table = found.join(F.broadcast(some), "doc_id", "left_semi").toArrow()
    table = table.sort_by("doc_id").combine_chunks()
    if not len(table):
        return [Link(c, np.zeros(0, np.int32), np.zeros(0), np.zeros(k), -14.0) for k, c in enumerate(categories)]
    lists = table["codes"].combine_chunks()
    code = lists.flatten().to_numpy()
    doc = np.repeat(np.arange(len(table), dtype=np.int32), lists.value_lengths().to_numpy())
    return fit_chain(doc, code, {c: table[c].to_numpy() for c in categories})


def _probabilities(part: T.Slice, chain: list[Link]) -> np.ndarray:
    """One column a link."""
    doc, code = features(part)
    before = np.zeros((len(part), 0))
    for link in chain:
        before = np.hstack([before, link.scores(doc, code, len(part), before)[:, None]])
    return before


def score(docs: DataFrame, chain: list[Link], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, p_<category>..., toxic`` for every row; toxic: the last category's probability reaches ``threshold``.

    Null and empty texts get the chain's base rate (and so are not toxic). Rows that repeat an id are scored one by one.
    Other columns are not read. The models are a few thousand numbers, whatever the corpus.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(part: T.Slice, batch: pa.RecordBatch) -> pa.RecordBatch:
        p = _probabilities(part, chain)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(chain))), pa.array(p[:, -1] >= threshold)], ["doc_id", *(f"p_{x.name}" for x in chain), "toxic"])

    return T.map_slices(texts, run, "doc_id long, " + ", ".join(f"`p_{x.name}` double" for x in chain) + ", toxic boolean")


def without_toxic(docs: DataFrame, chain: list[Link], *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` less the rows that ``score`` calls toxic; columns stay, and no row moves."""
    return T.filter_slices(docs, lambda part: _probabilities(part, chain)[:, -1] < threshold, text_col)


#: The label table's categories in chain order: poor quality first, toxicity on top of it.
CATEGORIES = {"poor": "quality = 0", "toxic": "toxic = 1"}


def toxicity(docs: DataFrame, labels: DataFrame, *, categories: dict[str, str] | None = None, max_labelled: int = 6000, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train the chain on the labelled part of ``docs`` and score all of it; see ``train`` and ``score``."""
    chain = train(docs, labels, categories or CATEGORIES, id_col=id_col, text_col=text_col, max_labelled=max_labelled)
    return score(docs, chain, id_col=id_col, text_col=text_col, threshold=threshold)
