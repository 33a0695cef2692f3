"""Alignment of two tokenizers: which tokens cover the same bytes, and which lie between the same two common ends.

Both tokenizers cut a text's bytes (with a space before it) into tokens, so each gives a token-byte incidence matrix A and B.
In compressed sparse rows, Gustavson's row product A * B^T links tokens that share bytes (the entry is their number); where
tokens of both end, a group ends, and the product of the token-group incidences links tokens of one group.

Neither tokenizer joins across a space that follows something else, nor letters, digits, marks and line ends with each other
(``spaced_units`` has the exact rule), so a text falls into units there, and tokens, links and groups of a unit depend on it alone. Units repeat a great deal: a task encodes and multiplies each once, knows it by a hash, and
gathers what texts need. (U+2581, which the second tokenizer writes for a space, is never given back, so texts that hold it have no
tokens, in units or whole.) Two passes: the first counts the links of every pair of ids over the corpus (a task adds its units'
occurrences up before it multiplies them out), the second sums the counts over each text's links. The table of counted pairs
goes to all tasks if it has at most ``most_broadcast`` rows (it is counted first); else texts' own pairs are joined with it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm import textops as T
from gridlume.llm.scratch import Scratch
from gridlume.llm.tokens import UnitTokenizer
from gridlume.runtime import ship

#: Units that a worker remembers; entries of a product that are spread out at a time.
MOST_UNITS, _ENTRIES = 900_000, 1 << 20
_LOW = (1 << 32) - 1


@dataclass
class Csr:
    """A sparse matrix of zeros and ones: row i has ones in the columns ``indices[indptr[i]:indptr[i + 1]]``."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    def transpose(self) -> Csr:
        row = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        return Csr(np.append(0, np.cumsum(np.bincount(self.indices, minlength=self.columns))), row[order], len(self.indptr) - 1)

    def product(self, other: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entries (row, column, value) of ``self * other`` by Gustavson's method, in blocks of rows.

        Row i of the product is the sum of the rows of ``other`` that row i names. A block spreads about ``_ENTRIES`` of
        them; a single row may need more.
        """
        width = np.diff(other.indptr)
        work = np.append(0, np.cumsum(width[self.indices]))[self.indptr]
        a, rows = 0, len(self.indptr) - 1
        while a < rows:
            b = max(a + 1, int(np.searchsorted(work, work[a] + _ENTRIES, "right")) - 1)
            named = self.indices[self.indptr[a] : self.indptr[b]]
            size = width[named]
            row = np.repeat(np.repeat(np.arange(a, b), np.diff(self.indptr[a : b + 1])), size)
            cell, value = np.unique(row * other.columns + other.indices[_ranges(other.indptr[named], size)], return_counts=True)
            yield cell // other.columns, cell % other.columns, value
            a = b


def token_bytes(ends: np.ndarray) -> Csr:
    """Token-byte incidence of tokens that end at ``ends``, one after another from byte 0 on."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.append(0, ends), np.arange(n), n)


def token_groups(ends: np.ndarray, common: np.ndarray) -> Csr:
    """Token-group incidence: each token lies in the group that ends at or after it first."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(common, ends), len(common))


@dataclass
class Aligned:
    """Tokens of both kinds of some strings, one after another: ids, ends, and where each string's begin (one more at the end)."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray

    def __post_init__(self) -> None:
        self.common = np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)

    def overlap(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, bytes that they share), by A token."""
        return token_bytes(self.a_ends).product(token_bytes(self.b_ends).transpose())

    def shared_group(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, 1) of every two tokens in one group, by A token."""
        return token_groups(self.a_ends, self.common).product(token_groups(self.b_ends, self.common).transpose())


_LETTER, _MARK, _DIGIT, _LINE, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
for _c in range(33, 127):
    _KIND[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _MARK
_KIND[ord("'")], _KIND[0x0A] = _OTHER, _LINE


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of many ranges, one range after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Strings:
    """Many byte strings in one buffer."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, at: np.ndarray) -> np.ndarray:
        return self.pool[_ranges(self.start[at], self.size[at])]


class Both:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        byte, vocab = _byte_level(), self.a.get_vocab()
        a_bytes = [b""] * (1 + max(vocab.values(), default=-1))
        for w, i in vocab.items():
            a_bytes[i] = bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode()
        piece = self.b.id_to_piece
        b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_bytes, self.b_bytes = Strings(a_bytes), Strings(b_bytes)
        self.space = self.b.piece_to_id("▁")

    def encode(self, units: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by both, unit by unit. The second tokenizer puts a space before its texts: it is the unit's own, or it goes before a line end that is
        taken away again."""
        own = [e.ids for e in self.a.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
        other = self.b.encode([u[1:].decode() if u[0] == 0x20 else "\n" + u.decode() for u in units], num_threads=1)
        return own, [[self.space] if u == b" " else x if u[0] == 0x20 else x[2:] for u, x in zip(units, other, strict=True)]

    def one_by_one(self, units: list[bytes]) -> tuple[Aligned, np.ndarray]:
        """The tokens of ``units``, and which of them both tokenizers give back byte for byte; others have no tokens."""
        own, other = self.encode(units)
        good = np.zeros(len(units), bool)
        for k, (u, x, y) in enumerate(zip(units, own, other, strict=True)):
            good[k] = self.a_bytes.joined(np.array(x, np.int64)).tobytes() == u and self.b_bytes.joined(np.array(y, np.int64)).tobytes() == u
            if not good[k]:
                own[k], other[k] = [], []
        return self._aligned(*((np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)) for ids in (own, other))), good

    def _aligned(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> Aligned:
        return Aligned(a[0], b[0], np.cumsum(self.a_bytes.size[a[0]]), np.cumsum(self.b_bytes.size[b[0]]), np.append(0, np.cumsum(a[1])), np.append(0, np.cumsum(b[1])))

    def aligned(self, units: list[bytes]) -> tuple[list[int], Aligned, np.ndarray]:
        """The same of many units, in an order of its own (returned first).

        Most go through both tokenizers as one text: units that begin with a space one after another, others behind line
        ends of their own. If that text isn't given back, or not cut at all units, they go one by one.
        """
        spaced, plain, odd = [], [], []
        for k, u in enumerate(units):
            (odd if not _ends_plainly(u) else spaced if u[0] == 0x20 else plain if _begins_plainly(u) else odd).append(k)
        order = spaced + plain
        size = np.array([len(units[k]) for k in order], np.int64)
        start = np.cumsum(size) - size + 2 + np.concatenate([np.zeros(len(spaced), np.int64), np.arange(1, len(plain) + 1)])
        text = b"".join([b" x", *(units[k] for k in spaced), *(b"\n" + units[k] for k in plain)])
        found = self._cut(text, start, start + size) if order else None
        if found is None:
            order, odd = [], [*range(len(units))]
        if odd:
            x, good = self.one_by_one([units[k] for k in odd])
            rest = ((x.a, np.diff(x.a_first)), (x.b, np.diff(x.b_first)))
            found = rest if found is None else tuple((np.concatenate([p[0], q[0]]), np.concatenate([p[1], q[1]])) for p, q in zip(found, rest, strict=True))
        good = np.concatenate([np.ones(len(order), bool), good]) if odd else np.ones(len(order), bool)
        return order + odd, self._aligned(*found), good

    def _cut(self, text: bytes, start: np.ndarray, end: np.ndarray) -> tuple | None:
        """(ids, number of them a unit) of both kinds inside the places of units; none if text or places are not kept."""
        raw, out = np.frombuffer(text, np.uint8), []
        both = (self.a.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.b.encode(text[1:].decode()))
        for ids, table in zip(both, (self.a_bytes, self.b_bytes), strict=True):
            ids = np.array(ids, np.int64)
            if not np.array_equal(table.joined(ids), raw):
                return None
            ends = np.append(0, np.cumsum(table.size[ids]))
            first, last = np.searchsorted(ends, start), np.searchsorted(ends, end)
            if (ends[first] != start).any() or (ends[last] != end).any():
                return None
            out.append((ids[_ranges(first, last - first)], last - first))
        return tuple(out)


def _begins_plainly(unit: bytes) -> bool:
    return _KIND[unit[0]] < _LINE or unit[0] == 0xC3 and unit[1] not in (0x97, 0xB7)


def _ends_plainly(unit: bytes) -> bool:
    return _KIND[unit[-1]] < _LINE or len(unit) > 1 and unit[-2] == 0xC3 and unit[-1] not in (0x97, 0xB7)


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def spaced_units(part: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a slice's texts with a space before each, and where each unit starts and ends; first[d]:first[d + 1] are those of text d.

    A unit begins at each text; at each space behind what is no white space; between letters, digits and marks of different
    kinds (ASCII and the letters from U+00C0 to U+00FF; the apostrophe, which makes contractions, is none of them); at a line end behind one
    of these; and behind a line end that stands alone between two of them. Both tokenizers cut at all these places, whatever else
    the text holds. Bytes that may end white space beyond ASCII count as such, which only makes a unit longer.
    """
    n = len(part)
    sizes = np.diff(part.offsets)
    buf = np.full(len(part.buf) + n, 0x20, np.uint8)
    buf[np.arange(len(part.buf)) + np.repeat(np.arange(1, n + 1), sizes)] = part.buf
    offsets = part.offsets + np.arange(n + 1)
    cut = np.zeros(len(buf) + 1, bool)
    two, three = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.uint8)
    two[1:], three[2:] = buf[:-1], buf[:-2]
    white = (buf <= 0x20) | (two == 0xC2) & ((buf == 0x85) | (buf == 0xA0)) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
    kind = _KIND[buf]
    lead = np.zeros(len(buf), bool)  # of a letter of two bytes; its second byte is never read as the lead of another
    lead[:-1] = (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    kind[lead] = _LETTER
    kind[1:][lead[:-1]] = _LETTER
    a, b = kind[:-1], kind[1:]
    plain = a < _LINE
    line = b == _LINE
    cut[1:-1] = (buf[1:] == 0x20) & ~white[:-1] | plain & (b < _LINE) & (a != b) | plain & line
    cut[2:-1] |= (plain[:-1] & line[:-1]) & (kind[2:] < _LINE)
    cut[offsets] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    return buf, start, end, np.searchsorted(start, offsets)


#: What is known of a unit, besides its links.
_FACTS = ("good", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum")


class UnitTable(UnitTokenizer):
    """Facts of all units seen (columns of ``facts``), their links or their groups' text, until there are too many."""

    def __init__(self, a: str, b: str, counts: tuple[np.ndarray, ...] | None, texts: bool):
        self.both, self.counts, self.texts = Both(a, b), counts, texts
        self._reset()

    def _reset(self, least: int = 0) -> None:
        super()._reset(least)
        self.facts = np.zeros((1 << 16, len(_FACTS)), np.int64)
        self.text = np.zeros(1 << 20, np.uint8)  # of the groups of all units, each with ``;`` behind it
        self.text_end = np.zeros(1 << 16, np.int64)
        self.links: list[np.ndarray] = []  # of the units learned at one go: their codes
        self.linked: list[np.ndarray] = []  # and how many each has

    def full(self, more: int) -> bool:
        return self.n > 0 and self.n + more > MOST_UNITS

    def find(self, key: np.ndarray, strings: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """The units of ``key``; ``strings(places)`` gives the bytes of new ones."""
        unit = self._find(key)
        new = np.flatnonzero(unit < 0)
        if len(new):
            once = new[np.sort(np.unique(key[new], return_index=True)[1])]
            for i in range(0, len(once), 20_000):
                own = once[i : i + 20_000]
                self._learn_units(key[own], strings(own))
            unit[new] = self._find(key[new])
        return unit

    def missing(self, key: np.ndarray) -> int:
        return len(np.unique(key[self._find(key) < 0]))

    def _learn_units(self, key: np.ndarray, units: list[bytes]) -> None:
        order, x, good = self.both.aligned(units)
        key = key[order]
        facts = np.zeros((len(units), len(_FACTS)), np.int64)
        facts[:, 0], facts[:, 1], facts[:, 2] = good, np.diff(x.a_first), np.diff(x.b_first)
        unit_a = np.repeat(np.arange(len(units)), facts[:, 1])
        group_a, group_b = np.searchsorted(x.common, x.a_ends), np.searchsorted(x.common, x.b_ends)
        in_a, in_b = np.bincount(group_a, minlength=len(x.common)), np.bincount(group_b, minlength=len(x.common))
        last = np.cumsum(in_a) - 1  # the A token that ends each group
        np.add.at(facts[:, 3], unit_a[last], 1)
        np.add.at(facts[:, 5], unit_a[last], in_a * in_b)
        codes, owner = [], []
        for i, j, _ in x.overlap():
            codes.append(x.a[i] << 32 | x.b[j]), owner.append(unit_a[i])
        codes, owner = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (codes, owner))
        facts[:, 4] = np.bincount(owner, minlength=len(units))
        if self.counts is not None:
            known, count, most = self.counts
            at = np.searchsorted(known, codes)
            np.add.at(facts[:, 6], owner, most[at])
            np.add.at(facts[:, 7], owner, count[at])
        else:
            self.links.append(codes), self.linked.append(facts[:, 4])
        if self.texts:
            self._add_texts(*_group_texts(x, group_a, group_b), facts[:, 3])
        while self.n + len(units) > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        self.facts[self.n : self.n + len(units)] = facts
        self._store(key, np.arange(self.n, self.n + len(units), dtype=np.int32))
        self.n += len(units)

    def _add_texts(self, text: np.ndarray, group_size: np.ndarray, n_groups: np.ndarray) -> None:
        used = int(self.text_end[self.n - 1]) if self.n else 0
        while used + len(text) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while self.n + len(n_groups) > len(self.text_end):
            self.text_end = np.concatenate([self.text_end, np.zeros_like(self.text_end)])
        self.text[used : used + len(text)] = text
        upto = np.append(0, np.cumsum(group_size))
        self.text_end[self.n : self.n + len(n_groups)] = used + upto[np.cumsum(n_groups)]

    def digests(self, part: Part) -> list[str]:
        """SHA-256 of each text's groups; nothing for texts without tokens."""
        end = self.text_end[part.unit]
        start = np.where(part.unit > 0, self.text_end[np.maximum(part.unit, 1) - 1], 0)
        upto, out, a = np.append(0, np.cumsum(end - start)), [], 0
        while a < len(part.good):
            # some MB at a time
            b = max(a + 1, int(np.searchsorted(upto[part.first], upto[part.first[a]] + (4 << 20), "right")) - 1)
            i, j = part.first[a], part.first[b]
            raw = memoryview(self.text[_ranges(start[i:j], (end - start)[i:j])].tobytes())
            at = (upto[part.first[a : b + 1]] - upto[i]).tolist()
            out += [hashlib.sha256(raw[p : q - 1]).hexdigest() if good else "" for p, q, good in zip(at[:-1], at[1:], part.good[a:b].tolist(), strict=True)]
            a = b
        return out

    def pairs(self, occurs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (A id << 32 | B id) of all links of units that occur so often, and how often each is linked."""
        if not self.links:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.concatenate(self.links)
        weight = np.repeat(occurs, np.concatenate(self.linked))
        code, place = np.unique(codes, return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, place, weight)
        return code[total > 0], total[total > 0]


_DECIMAL: list[Strings] = []


def _group_texts(x: Aligned, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups as ``a1,a2|b1;a3|b2,b3;``, all in one buffer, and how long each is.

    Tokens of both kinds are put in order of group and kind; each is its number and the mark behind it.
    """
    most = max(int(x.a.max(initial=0)), int(x.b.max(initial=0)))
    if not _DECIMAL or len(_DECIMAL[0].size) <= most:
        _DECIMAL[:] = [Strings([str(i).encode() + b"," for i in range(most + 1 + 60_000)])]
    group, ids = np.concatenate([group_a, group_b]), np.concatenate([x.a, x.b])
    kind = np.repeat([0, 1], [len(group_a), len(group_b)])
    order = np.argsort(2 * group + kind, kind="stable")
    group, kind, size = group[order], kind[order], _DECIMAL[0].size[ids[order]]
    text = _DECIMAL[0].joined(ids[order]).copy()
    last = np.cumsum(size) - 1
    ends = np.append((2 * group + kind)[1:] != (2 * group + kind)[:-1], True) if len(group) else np.zeros(0, bool)
    text[last[ends]] = np.where(kind[ends] == 0, ord("|"), ord(";"))
    return text, np.bincount(group, size, len(x.common)).astype(np.int64)


@dataclass
class Part:
    """Units of some texts of a slice by their number in the table; first[d]:first[d + 1] are those of text d. good: texts that both tokenizers give back."""

    row: int
    unit: np.ndarray
    first: np.ndarray
    good: np.ndarray

    def sums(self, facts: np.ndarray) -> np.ndarray:
        upto = np.concatenate([np.zeros((1, facts.shape[1]), np.int64), np.cumsum(facts[self.unit], axis=0)])
        return np.where(self.good[:, None], upto[self.first[1:]] - upto[self.first[:-1]], 0)


def _parts(table: UnitTable, part: T.Slice, before_reset: Callable[[], None]) -> Part:
    buf, start, end, first = spaced_units(part)
    key = T.hash_spans(buf, start, end) | T.U64(1)
    more = table.missing(key)
    if table.full(more) or 10 * (table.n + more) > 7 * table.slots:
        before_reset()
        table._reset(len(np.unique(key)))
    unit = table.find(key, lambda places: [buf[a:b].tobytes() for a, b in zip(start[places].tolist(), end[places].tolist(), strict=True)])
    bad = np.append(0, np.cumsum(table.facts[unit, 0] == 0))
    return Part(part.row, unit, first, (np.diff(part.offsets) > 0) & (bad[first[1:]] == bad[first[:-1]]))


def pair_counts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, n``: how many overlap links of ``docs`` (``text``) hold each pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, occurs, out = UnitTable(a, b, None, False), np.zeros(1 << 16, np.int64), []

        def flush() -> None:
            out.append(table.pairs(occurs[: table.n]))
            occurs[:] = 0

        def ready() -> Iterator[pa.RecordBatch]:
            while out:
                code, n = out.pop()
                for i in range(0, len(code), 100_000):
                    own = code[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(own >> 32), pa.array(own & _LOW), pa.array(n[i : i + 100_000])], ["a", "b", "n"])

        for batch in batches:
            for part in T.slices(batch.column(0)):
                p = _parts(table, part, flush)
                while table.n > len(occurs):
                    occurs = np.concatenate([occurs, np.zeros(len(occurs), np.int64)])
                size = np.diff(p.first)
                occurs[: table.n] += np.bincount(p.unit[np.repeat(p.good, size)], minlength=table.n)
            yield from ready()
        flush()
        yield from ready()

    ship(docs.sparkSession)
    rows = docs.select("text").mapInArrow(run, "a long, b long, n long")
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))


_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum"]


def _document_sums(docs: DataFrame, a: str, b: str, counts: tuple[np.ndarray, ...] | None) -> DataFrame:
    """``doc_id``, the sums and ``groups_sha256`` of every row; without ``counts``, its pairs of ids instead of the last two sums."""
    own = "array<struct<a:long,b:long,n:long>>"
    struct = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = UnitTable(a, b, counts, True)
        for batch in batches:
            for part in T.slices(batch.column(1)):
                p = _parts(table, part, lambda: None)
                sums = p.sums(table.facts)[:, 1:]
                columns = [batch.column(0).slice(p.row, len(part)), *(pa.array(c) for c in sums.T), pa.array(table.digests(p), pa.string())]
                if counts is None:
                    columns.append(_own_pairs(table, p, struct))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_SUMS, "groups_sha256", *["pairs"] * (counts is None)])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _SUMS) + ", groups_sha256 string" + (f", pairs {own}" if counts is None else ""))


def _own_pairs(table: UnitTable, p: Part, struct: pa.DataType) -> pa.ListArray:
    """Each text's distinct pairs of ids and their number."""
    codes, size = np.concatenate(table.links), np.concatenate(table.linked)
    at = np.append(0, np.cumsum(size))
    found, n = [], []
    for d in range(len(p.good)):
        unit = p.unit[p.first[d] : p.first[d + 1]] if p.good[d] else p.unit[:0]
        code, count = np.unique(codes[_ranges(at[unit], size[unit])], return_counts=True)
        found.append(code), n.append(count)
    code, count = np.concatenate(found), np.concatenate(n)
    rows = pa.StructArray.from_arrays([pa.array(code >> 32), pa.array(code & _LOW), pa.array(count)], fields=list(struct))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in found])), pa.int32()), rows)


def align_tokenizers(docs: DataFrame, a: str, b: str, *, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 4_000_000) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256`` for every row.

    ``a``: file of a byte-level vocabulary, which encodes a space and the text; ``b``: file of a sentencepiece model, which adds the
    space itself. Strings of special tokens are plain text. n_links: pairs of tokens that share bytes; n_shared: pairs in one
    group; count_sum: over the links, how many links of the corpus hold the same two ids; n_best: links whose count is the highest of
    their B id, ties included. groups_sha256 hashes ``a1,a2|b1;a3|b2,b3``: the ids of each group, in order.

    A null or empty text, and one that either tokenizer doesn't give back byte for byte, has no tokens: zeros and an empty hash. Rows
    with null or repeated ids are rows like any other, and all count. Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "align")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pairs = scratch.save(pair_counts(docs, a, b), "pairs")
    best = pairs.groupBy("b").agg(F.max("n").alias("most"))  # a row a B id
    counted = pairs.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    if pairs.limit(most_broadcast + 1).count() <= most_broadcast:
        table = counted.select(F.expr("shiftleft(a, 32) | b").alias("code"), "n", "best").toArrow()
        code = table["code"].to_numpy()
        order = np.argsort(code)
        counts = (code[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order].astype(np.int64))
        return _document_sums(docs, a, b, counts)
    # written, so that a row's number is fixed
    rows = scratch.save(_document_sums(docs, a, b, None).withColumn("nr", F.monotonically_increasing_id()), "rows")
    own = rows.select("nr", F.explode("pairs").alias("p")).select("nr", "p.a", "p.b", F.col("p.n").alias("times")).join(counted, ["a", "b"])
    sums = own.groupBy("nr").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("x"), F.sum(F.col("times") * F.col("n")).alias("y"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.join(sums, "nr", "left").select("doc_id", *_SUMS[:5], zero("x").alias("n_best"), zero("y").alias("count_sum"), "groups_sha256")


def alignment_links(docs: DataFrame, a: str, b: str, *, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, a_index, b_index, a, b, value`` of every link of every text: the tokens' places and ids.

    ``kind``: ``overlap`` (value: bytes that both cover) or ``group`` (value 1). Rows come text by text in blocks of the
    product, so a text of any length streams. Texts without tokens have no links.
    """
    state: dict[str, Both] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = state.setdefault("t", state.get("t") or Both(a, b))
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                x, _ = both.one_by_one([b" " + text.encode()])
                for i, j, value in x.overlap() if kind == "overlap" else x.shared_group():
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(i), pa.int64()), *(pa.array(c) for c in (i, j, x.a[i], x.b[j], value))], _LINKS)

    ship(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in _LINKS))


_LINKS = ["doc_id", "a_index", "b_index", "a", "b", "value"]
