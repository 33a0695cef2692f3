"""Quality rules as a short-circuit cascade.

Every rule needs some measures of a text, and measures share steps (words, lines). On a bounded sample the seconds of each step
and the texts that each rule rejects are measured. Rules are then ordered greedily: next comes the rule that rejects most
of the sampled texts still there per second of steps that nothing before it has paid for. A document is measured only until a
rule rejects it. Measures are taken over many documents at once.
"""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm import textops as T
from gridlume.runtime import ship

_MARKS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_NEWLINE = np.arange(256) == 10
#: Bytes that begin a character which is no white space.
_CHARACTERS = np.array([c & 0xC0 != 0x80 and not T.SPACE[c] for c in range(256)])


class Measures:
    """Measures of a slice's documents, each made for the documents that somebody asks about, once."""

    def __init__(self, part: T.Slice):
        self.part, self._values, self._steps = part, {}, {}

    def step(self, name: str) -> T.Words:
        """Words, or lines that hold a word."""
        if name not in self._steps:
            self._steps[name] = STEPS[name](self.part)
        return self._steps[name]

    def take(self, name: str, docs: np.ndarray) -> np.ndarray:
        known = self._values.setdefault(name, np.full(len(self.part), -1, np.int64))
        new = docs[known[docs] < 0]
        if len(new):
            known[new] = MEASURES[name](self, new)
        return known[docs]

    def of(self, docs: np.ndarray) -> View:
        return View(self, docs)


@dataclass(frozen=True)
class View:
    """What a rule sees: measures (arrays) of some documents by name."""

    measures: Measures
    docs: np.ndarray

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.measures.take(name, self.docs)


def _lines(part: T.Slice) -> T.Words:
    lines = T.words(part, False, _NEWLINE)
    inked = np.append(0, np.cumsum(~T.SPACE[part.buf]))
    own = np.flatnonzero(inked[lines.end] > inked[lines.start])
    return T.Words(lines.start[own], lines.end[own], lines.doc[own], lines.hash[own], np.searchsorted(lines.doc[own], np.arange(len(part) + 1)))


STEPS: dict[str, Callable[[T.Slice], T.Words]] = {"words": lambda part: T.words(part, False), "lines": _lines}


def _count_bytes(kind: np.ndarray) -> Callable[[Measures, np.ndarray], np.ndarray]:
    def count(m: Measures, docs: np.ndarray) -> np.ndarray:
        at = m.part.offsets
        if len(docs) < len(m.part):
            return np.array([np.count_nonzero(kind[m.part.buf[at[d] : at[d + 1]]]) for d in docs], np.int64)
        total = np.append(0, np.cumsum(kind[m.part.buf]))
        return total[at[1:]] - total[at[:-1]]

    return count


def _repeated(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries share their (document, value) with another, and which with one before them."""
    order = np.lexsort((value, doc))  # a stable sort
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
    some, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    some[order], later[order] = same[1:] | same[:-1], same[:-1]
    return some, later


def _dup_lines(m: Measures, docs: np.ndarray) -> np.ndarray:
    lines = m.step("lines")
    own = np.isin(lines.doc, docs)
    doc = lines.doc[own]
    return np.bincount(doc[_repeated(doc, lines.hash[own])[1]], minlength=len(m.part))[docs]


def _repeat_words(m: Measures, docs: np.ndarray) -> np.ndarray:
    w = m.step("words")
    own = np.isin(w.doc, docs)
    w = T.Words(w.start[own], w.end[own], w.doc[own], w.hash[own], w.first)
    value, at = T.shingles(w, 3)
    at = at[_repeated(w.doc[at], value)[0]]
    covered = np.zeros(len(w.doc), bool)
    for k in range(3):
        covered[at + k] = True
    return np.bincount(w.doc[covered], minlength=len(m.part))[docs]


MEASURES: dict[str, Callable[[Measures, np.ndarray], np.ndarray]] = {
    "n_words": lambda m, docs: np.diff(m.step("words").first)[docs],
    "word_chars": _count_bytes(_CHARACTERS),
    "n_symbols": _count_bytes(_MARKS),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_lines": lambda m, docs: np.diff(m.step("lines").first)[docs],
}
#: The step that a measure shares with others.
SHARED = {"n_words": "words", "n_repeat_words": "words", "n_lines": "lines", "n_dup_lines": "lines"}


@dataclass(frozen=True)
class Rule:
    """Documents fail where ``fails(view)`` is true; ``needs`` names what it looks at, ``sql`` says the same in SQL."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[View], np.ndarray]
    sql: str


#: n_words < 50 and 3-word repeats over a half are the base; the others are usual published web-text limits in whole numbers.
RULES = (
    Rule("too_short", ("n_words",), lambda m: m["n_words"] < 50, "n_words < 50"),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] > 3 * m["n_words"], "10 * n_symbols > 3 * n_words"),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda m: 10 * m["n_dup_lines"] > 7 * m["n_lines"], "10 * n_dup_lines > 7 * n_lines"),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] > 12 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"]), "word_chars > 12 * n_words or word_chars < 2 * n_words"),
)
BASE_RULES = ("too_short", "repeats")


def measured(texts: list[str], rules: tuple[Rule, ...]) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """Seconds of every step, measure and rule on the sample, shared steps apart; and the texts that each rule rejects."""
    cost: dict[str, float] = {}
    rejected = {r.name: [] for r in rules}

    def timed(name: str, work: Callable[[], object]) -> object:
        began = time.perf_counter()
        out = work()
        cost[name] = cost.get(name, 0.0) + time.perf_counter() - began
        return out

    for part in T.slices(pa.array(texts, pa.string())):
        m, docs = Measures(part), np.arange(len(part))
        for name in sorted({SHARED[x] for r in rules for x in r.needs if x in SHARED}):
            timed(name, lambda name=name: m.step(name))
        for name in sorted({x for r in rules for x in r.needs}):
            timed(name, lambda name=name: m.take(name, docs))
        for r in rules:
            rejected[r.name].append(timed(f"rule {r.name}", lambda r=r: np.broadcast_to(r.fails(m.of(docs)), len(docs))))
    return cost, {k: np.concatenate(v) if v else np.zeros(0, bool) for k, v in rejected.items()}


def order_rules(texts: list[str], rules: tuple[Rule, ...] = RULES, paid: tuple[str, ...] = ()) -> list[Rule]:
    """Rules by rejections per second of what is not paid for yet (``paid``: measures that are made anyway), best first.

    Ties and an empty sample keep the given order.
    """
    cost, rejected = measured(texts, rules)
    done = {*paid, *(SHARED[x] for x in paid if x in SHARED)}
    left, out, there = list(rules), [], np.ones(len(texts), bool)
    while left:

        def worth(r: Rule) -> float:
            steps = {*r.needs, *(SHARED[x] for x in r.needs if x in SHARED), f"rule {r.name}"} - done
            return float((rejected[r.name] & there).sum()) / max(sum(cost.get(x, 0.0) for x in steps), 1e-9)

        best = max(left, key=worth)
        left.remove(best)
        out.append(best)
        there &= ~rejected[best.name]
        done |= {*best.needs, *(SHARED[x] for x in best.needs if x in SHARED)}
    return out


def sample_texts(texts: DataFrame, rows: int, chars: int, seed: int = 0) -> list[str]:
    """About ``rows`` texts of at most ``chars`` characters, some from each of as many partitions, chosen at random.

    A partition gives texts of its first batch only, so a sample of a large table reads a little of many files.
    """
    parts = texts.select(F.spark_partition_id().alias("part")).agg(F.countDistinct("part")).first()[0]  # reads no column
    if not parts:
        return []
    share, each = min(1.0, rows / parts), -(-rows // min(parts, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if zlib.crc32(f"{seed} {part}".encode()) >= share * 2**32:
            return
        for batch in batches:
            batch = batch.filter(pc.less_equal(pc.utf8_length(batch.column(0)), chars))
            if batch.num_rows:
                own = random.Random(f"{seed} {part}").sample(range(batch.num_rows), min(each, batch.num_rows))
                yield batch.take(pa.array(sorted(own)))
                return

    ship(texts.sparkSession)
    return [r[0] for r in texts.select("text").where("text is not null").mapInArrow(run, "text string").take(rows)]


def quality_rules(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE_RULES, report: tuple[str, ...] = (), order: tuple[str, ...] = (), sample_rows: int = 256, sample_chars: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, <report measures>, base_failed, failed_rule, kept`` for every row.

    The order of the rules comes from at most ``sample_rows`` texts of at most ``sample_chars`` characters (what the driver
    holds is bounded by their product), or is ``order`` (all names of ``rules``) if given; it changes how much is measured,
    never a verdict. ``failed_rule`` is the rule that rejected the document, null if kept; as seconds vary, it is sure to be
    the same in two runs only under a given ``order``. Measures in ``report`` and those of ``base`` rules are made for every document,
    the others only while no rule has rejected it. A null text has no words. Null or repeated ids
    are rows like any other; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    always = tuple(dict.fromkeys([*report, *(x for r in rules if r.name in base for x in r.needs)]))
    by_name = {r.name: r for r in rules}
    ordered = [by_name[x] for x in order] if order else order_rules(sample_texts(texts, sample_rows, sample_chars), rules, always)

    def run(part: T.Slice, batch: pa.RecordBatch) -> pa.RecordBatch:
        m, all_ = Measures(part), np.arange(len(part))
        columns = [pa.array(m.take(x, all_)) for x in report]
        base_failed = np.zeros(len(part), bool)
        for r in rules:
            if r.name in base:
                base_failed |= r.fails(m.of(all_))
        there, failed = all_, np.full(len(part), -1)
        for k, r in enumerate(ordered):
            if len(there):
                out = np.broadcast_to(r.fails(m.of(there)), len(there))
                failed[there[out]] = k
                there = there[~out]
        names = pa.array([r.name for r in ordered], pa.string()).take(pa.array(failed, mask=failed < 0))
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(base_failed), names, pa.array(failed < 0)], ["doc_id", *report, "base_failed", "failed_rule", "kept"])

    return T.map_slices(texts, run, "doc_id long, " + "".join(f"{x} long, " for x in report) + "base_failed boolean, failed_rule string, kept boolean")
