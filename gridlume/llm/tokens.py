"""Token ids of many texts at once, each distinct unit encoded once.

The vocabulary splits texts into runs of letters, single digits and runs of other characters before it looks for tokens, never
joins across white space, and lowers letters. So a text can be cut at ASCII white space, and between an ASCII letter or digit
and an ASCII mark (the apostrophe, which makes contractions, and all bytes beyond ASCII are left alone), and ASCII letters
can be lowered first. The units between cuts repeat a great deal: their hashes are looked up in one table, only new units
go to the tokenizer, and the ids of a slice are gathered in one go.
"""

from __future__ import annotations

import os

import numpy as np

from gridlume.llm import textops as T

#: Units that a worker remembers (about 40 bytes each); slots of their table.
MOST_UNITS, SLOTS = 1_200_000, 1 << 21

_SPACE, _WORD, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
for _c in range(33, 127):
    _CLASS[_c] = _WORD if chr(_c).isalnum() else _MARK
_CLASS[ord("'")] = _OTHER
for _c in (0x20, *range(0x09, 0x0E)):
    _CLASS[_c] = _SPACE
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])


def units(part: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, and where each unit starts and ends; first[d]:first[d + 1] are those of document d."""
    buf = T.LOWER[part.buf]
    kind = _CLASS[buf]
    inside = kind != _SPACE
    cut = np.ones(len(buf) + 1, bool)
    a, b = kind[:-1], kind[1:]
    cut[1:-1] = (a == _SPACE) | (b == _SPACE) | ((a == _WORD) & (b == _MARK)) | ((a == _MARK) & (b == _WORD))
    cut[part.offsets] = True
    start = np.flatnonzero(cut[:-1] & inside)
    end = np.flatnonzero(cut[1:] & inside) + 1
    return buf, start, end, np.searchsorted(start, part.offsets)


class UnitTokenizer:
    """Ids of slices by a tokenizer file; keeps the ids of all units seen, until there are too many."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        #: Strings that the tokenizer takes out of a text before all else; texts that hold one go to it whole.
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._reset()

    def _reset(self, least: int = 0) -> None:
        """Forget all units; room for at least so many."""
        self.slots = max(SLOTS, 1 << int(2 * least).bit_length())
        self.shift = T.U64(64 - self.slots.bit_length() + 1)
        self.keys = np.zeros(self.slots, T.U64)  # 0: free
        self.unit = np.zeros(self.slots, np.int32)
        self.pool = np.zeros(1 << 20, "<u4")
        self.offset = np.zeros(1 << 18, np.int64)  # of unit u in the pool: offset[u]:offset[u + 1]
        self.n = 0

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The unit of each key, -1 for new ones."""
        out = np.full(len(key), -1, np.int32)
        slot = (key >> self.shift).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            there = self.keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.unit[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _store(self, key: np.ndarray, unit: np.ndarray) -> None:
        slot = (key >> self.shift).astype(np.int64)
        while len(key):
            free = self.keys[slot] == 0
            first = np.zeros(len(key), bool)
            first[np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.unit[slot[put]] = key[put], unit[put]
            key, unit, slot = key[~put], unit[~put], (slot[~put] + 1) & (self.slots - 1)

    def _append(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Put the ids of new units into the pool; their numbers."""
        used = int(self.offset[self.n])
        while used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), "<u4")])
        while self.n + len(length) + 1 > len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros(len(self.offset), np.int64)])
        self.pool[used : used + len(ids)] = ids
        self.offset[self.n + 1 : self.n + 1 + len(length)] = used + np.cumsum(length)
        out = np.arange(self.n, self.n + len(length), dtype=np.int32)
        self.n += len(length)
        return out

    def _learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> None:
        """Encode new units. Those that are one run for certain go as one text, cut at end-of-word tokens."""
        kind = np.concatenate([[0], np.cumsum((_CLASS[buf] == _OTHER) | _DIGIT[buf])])
        plain = kind[end] == kind[start]
        rest = np.flatnonzero(~plain)
        texts = [buf[a:b].tobytes().decode() for a, b in zip(start[rest], end[rest], strict=True)]
        lone = np.array([t.isalpha() and t.islower() for t in texts], bool)
        if lone.any():
            plain[rest[lone]] = True
            texts, rest = [t for t, x in zip(texts, lone, strict=True) if not x], rest[~lone]
        at = np.flatnonzero(plain)
        if len(at):
            size = end[at] - start[at] + 1  # and a space
            total = int(size.sum())
            origin = np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(total)
            joined = buf[np.minimum(origin, len(buf) - 1)]
            joined[np.cumsum(size) - 1] = 0x20
            ids = np.array(self.model.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            assert len(stops) == len(at)
            self._store(key[at], self._append(ids, np.diff(stops, prepend=0)))
        if len(rest):
            own = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
            length = np.array([len(x) for x in own], np.int64)
            self._store(key[rest], self._append(np.array([i for x in own for i in x], "<u4"), length))

    def ids(self, part: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and where each document's begin (one more at the end)."""
        if self.n > MOST_UNITS or self.slots > SLOTS and self.n:
            self._reset()
        buf, start, end, first = units(part)
        key = T.hash_spans(buf, start, end) | T.U64(1)
        unit = self._find(key)
        new = np.flatnonzero(unit < 0)
        if len(new):
            once = new[np.sort(np.unique(key[new], return_index=True)[1])]
            if 10 * (self.n + len(once)) > 7 * self.slots:  # one very long text; the table must never fill up
                self._reset(len(np.unique(key)))
                return self.ids(part)
            self._learn(buf, start[once], end[once], key[once])
            unit[new] = self._find(key[new])
        length = self.offset[unit + 1] - self.offset[unit]
        upto = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(self.offset[unit] - upto[:-1], length) + np.arange(int(upto[-1]))
        return self._whole(part, self.pool[at], upto[first])

    def _whole(self, part: T.Slice, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with those of texts that hold special strings encoded as they are."""
        raw = part.buf.tobytes()
        if not any(s in raw for s in self.special):
            return ids, bounds
        own = [ids[bounds[d] : bounds[d + 1]] for d in range(len(part))]
        for d in range(len(part)):
            text = part.text(d)
            if any(s in text for s in self.special):
                own[d] = np.array(self.model.encode(text.decode(), add_special_tokens=False).ids, "<u4")
        return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
