"""Token ids of whole batches: the pre-tokenizer's splits found with numpy, each distinct piece encoded once."""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import regex

from hotspan.llm import textarrays as ta

END = 0  # id after the last token of a document
#: Characters below this are split here; a text with a later one goes to the tokenizer as a whole.
KNOWN = 0x3000
#: Distinct pieces kept per process before the memory of them starts afresh.
REMEMBERED = 1 << 19
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)


@cache
def _classes() -> np.ndarray:
    table = np.full(KNOWN, _OTHER, np.uint8)
    every = "".join(map(chr, range(KNOWN)))
    for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE)):
        table[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return table


@cache
def _values() -> np.ndarray:
    return ta.mixed(np.arange(1, KNOWN + 1, dtype=np.uint64), 0xABCDEF)


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def splits(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts given as code points below KNOWN.

    The rule is that of byte-level BPE: contractions after an apostrophe, runs of letters, of numbers and of other
    characters, each with one blank before it, and white space, whose last character stands alone or is that blank.
    """
    n = len(points)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= edge[:-1]
    begin = change.copy()
    space = kind == _SPACE
    # the last character of white space before something else begins a piece, and what follows a blank doesn't
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    begin |= last
    blank = last & (points == 0x20)
    follows = np.flatnonzero(blank) + 1
    begin[follows] = False
    # contractions: an apostrophe alone between pieces, then one of s t m d, or re ve ll
    quote = np.flatnonzero((points == 0x27) & begin)
    if len(quote):
        at = lambda i: np.where(i < n, points[np.minimum(i, n - 1)], 0)
        same = lambda i: (i < n) & ~edge[np.minimum(i, n)]
        one, two = at(quote + 1), at(quote + 2)
        short = same(quote + 1) & np.isin(one, [ord(c) for c in "stmd"])
        long = same(quote + 1) & same(quote + 2) & (
            ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for found, size in ((quote[short], 2), (quote[long & ~short], 3)):
            begin[found + 1] = False
            rest = found + size
            inside = rest[(rest < n)]
            begin[inside] |= kind[inside] == _LETTER
    return np.flatnonzero(begin)


class Encoder:
    """Ids of many texts at once. Pieces are found by a 64-bit hash in an open-addressing table and then compared."""

    def __init__(self, path: str | None = None):
        self.tokenizer = tokenizer(path or default_path())
        self._forget()

    def _forget(self) -> None:
        self.slots = 2 * REMEMBERED
        self.keys, self.numbers = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.starts, self.lengths = np.zeros(REMEMBERED + 1, np.int64), np.zeros(REMEMBERED + 1, np.int32)
        self.arena, self.used, self.known = np.zeros(2 * REMEMBERED, np.uint16), 0, 0
        self.letters, self.spelt = np.zeros(8 * REMEMBERED, np.uint16), 0
        self.letter_starts, self.letter_lengths = np.zeros(REMEMBERED + 1, np.int64), np.zeros(REMEMBERED + 1, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 if unknown."""
        out = np.full(len(keys), -1, np.int32)
        slot = (keys >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.numbers[slot[hit]]
            go_on = ~hit & (found != 0)
            open_, slot = open_[go_on], (slot[go_on] + 1) & (self.slots - 1)
        return out

    def _add(self, keys: np.ndarray, ids: list[list[int]], letters: np.ndarray, sizes: np.ndarray) -> None:
        """Remember distinct, unknown keys with their pieces: all code points one after another, and how many each has."""
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint16, int(lengths.sum()))
        while self.used + len(flat) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(len(self.arena), np.uint16)])
        numbers = np.arange(self.known, self.known + len(keys))
        self.arena[self.used:self.used + len(flat)] = flat
        self.starts[numbers], self.lengths[numbers] = self.used + np.cumsum(lengths) - lengths, lengths
        while self.spelt + len(letters) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros(len(self.letters), np.uint16)])
        self.letters[self.spelt:self.spelt + len(letters)] = letters
        self.letter_starts[numbers], self.letter_lengths[numbers] = self.spelt + np.cumsum(sizes) - sizes, sizes
        self.used, self.known, self.spelt = self.used + len(flat), self.known + len(keys), self.spelt + len(letters)
        slot = (keys >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]  # of several for one slot the last stays
            stays = self.keys[slot] == keys[todo]
            self.numbers[slot[stays]] = numbers[todo[stays]]
            todo, slot = todo[~stays], (slot[~stays] + 1) & (self.slots - 1)

    def encode(self, texts: ta.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after another (uint16 or wider), and n + 1 offsets."""
        decoded = bytes(texts.data).decode("utf-8", "replace")
        points = np.frombuffer(decoded.encode("utf-32-le"), np.uint32)
        before = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum((texts.data & 0xC0) != 0x80, out=before[1:])
        offsets = before[texts.offsets]
        if len(points) and points.max() >= KNOWN:
            return self._mixed(decoded, points, offsets)
        return self._known(decoded, points, offsets)

    def _mixed(self, decoded: str, points: np.ndarray, offsets: np.ndarray):
        parts = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b > a and points[a:b].max() >= KNOWN:
                parts.append(np.array(self.tokenizer.encode(decoded[a:b], add_special_tokens=False).ids, np.uint16))
            else:
                parts.append(self._known(decoded[a:b], points[a:b], np.array([0, b - a]))[0])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint16)), np.concatenate([[0], np.cumsum(sizes)])

    def _known(self, decoded: str, points: np.ndarray, offsets: np.ndarray):
        if not len(points):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        begins = splits(points, offsets)
        ends = np.append(begins[1:], len(points))
        keys = self._keys(points, begins, ends)
        keys[keys == 0] = 1
        found = [self._block(decoded, points, begins[a:a + REMEMBERED], ends[a:a + REMEMBERED], keys[a:a + REMEMBERED])
                 for a in range(0, len(keys), REMEMBERED)]
        ids, lengths = (np.concatenate(x) for x in zip(*found))
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.searchsorted(begins, offsets)]

    @staticmethod
    def _keys(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return ta.run_hashes(_values()[points], begins, ends)

    def _block(self, decoded: str, points: np.ndarray, begins: np.ndarray, ends: np.ndarray, keys: np.ndarray):
        """Ids of at most REMEMBERED pieces in a row, so that all of them can be known at once, and how many each has."""
        numbers, sizes = self._find(keys), ends - begins
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            if self.known + len(new) > REMEMBERED:
                self._forget()
                missing = np.arange(len(keys))
                new, first = np.unique(keys, return_index=True)
            where = missing[first]
            self._add(new, self._encoded(decoded, begins[where], ends[where]), points[ta.ragged(begins[where], sizes[where])], sizes[where])
            numbers[missing] = self._find(keys[missing])
        starts, lengths = self.starts[numbers], self.lengths[numbers].astype(np.int64)
        arena, other = self.arena, self._others(points, begins, sizes, numbers)
        if len(other):  # pieces that share a key with another one
            ids = self._encoded(decoded, begins[other], ends[other])
            lengths[other] = [len(x) for x in ids]
            starts[other] = self.used + np.cumsum(lengths[other]) - lengths[other]
            arena = np.concatenate([arena[:self.used], np.array([i for x in ids for i in x], np.uint16)])
        return arena[ta.ragged(starts, lengths)], lengths

    def _encoded(self, decoded: str, begins: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        pieces = [decoded[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _others(self, points: np.ndarray, begins: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Which pieces aren't the remembered ones of their numbers, code point by code point."""
        same = self.letter_lengths[numbers] == sizes
        which = np.flatnonzero(same)
        sizes = sizes[which]
        if len(which) == len(same):
            here = points[begins[0]:begins[-1] + sizes[-1]]  # pieces in a row
        else:
            here = points[ta.ragged(begins[which], sizes)]
        differ = here != self.letters[ta.ragged(self.letter_starts[numbers[which]], sizes)]
        if differ.any():
            same[np.repeat(which, sizes)[differ]] = False
        return np.flatnonzero(~same)


@cache
def encoder(path: str | None = None) -> Encoder:
    """One encoder per process and vocabulary, so that pieces stay known from one batch to the next."""
    return Encoder(path)


def documents_of(texts: ta.Texts, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every text with END after each, as little-endian unsigned 32-bit values, and n + 1 offsets."""
    ids, offsets = encoder(path).encode(texts)
    lengths = np.diff(offsets)
    ends = np.cumsum(lengths + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, END, "<u4")
    out[ta.ragged(ends - lengths - 1, lengths)] = ids
    return out, np.concatenate([[0], ends]).astype(np.int64)
