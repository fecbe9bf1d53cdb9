"""Words of whole blocks of texts as arrays: where they start and end, their bytes in lanes of eight, and a 64-bit hash of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The bytes of a lane that belong to a word of which so many are left.
_MASK = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, ends: np.ndarray, solid: np.ndarray | None = None, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``.

    A word is a run of ``solid`` bytes (by default, of all but ASCII white space); a new one also begins at each of ``ends`` (ends of
    texts) and where ``cuts`` is set.
    """
    if solid is None:
        solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = ends[(ends > 0) & (ends < len(data))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    if cuts is not None:
        first |= cuts
        last[:-1] |= cuts[1:] & solid[:-1]
    return np.nonzero(first)[0], np.nonzero(last)[0] + 1


class Lanes:
    """The words' bytes, eight to a lane and zeros beyond their end; with their lengths these tell any two words apart."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        self.lengths = stops - starts
        self.counts = (self.lengths + 7) >> 3
        self.first = np.cumsum(self.counts) - self.counts
        self.number = np.arange(int(self.counts.sum())) - np.repeat(self.first, self.counts)
        at = np.repeat(starts, self.counts) + 8 * self.number
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        self.values = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at] & _MASK[np.minimum(np.repeat(stops, self.counts) - at, 8)]

    def hashes(self) -> np.ndarray:
        """Lanes are mixed with their place by a bijection that isn't linear, so no pattern of bytes cancels out."""
        if not len(self.lengths):
            return np.zeros(0, np.uint64)
        mixed = mix(self.values ^ mix((self.number + 1).astype(np.uint64) * _STEP))
        return mix(np.add.reduceat(mixed, self.first) + self.lengths.astype(np.uint64) * _STEP)

    def equal(self, mine: np.ndarray, values: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether these words have the same bytes as those of other lanes, each given by its first lane and length."""
        same = self.lengths[mine] == lengths
        at = np.nonzero(same)[0]
        counts = self.counts[mine[at]]
        if len(at):
            begin = np.cumsum(counts) - counts
            inside = np.arange(int(counts.sum())) - np.repeat(begin, counts)
            differ = self.values[np.repeat(self.first[mine[at]], counts) + inside] != values[np.repeat(first[at], counts) + inside]
            same[at] = np.add.reduceat(differ.astype(np.int64), begin) == 0
        return same


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words that ASCII white space and ends of texts part."""
    starts, stops = spans(data, ends)
    return starts, stops, Lanes(data, starts, stops).hashes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes, of one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` entries."""
    return a if n <= len(a) else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))


class WordTable:
    """Open addressing in arrays: a word, told by hash and then byte for byte, to its ids; found for whole blocks at once."""

    def __init__(self, bits: int = 21):
        self.bits, self.most = bits, (1 << bits) * 6 // 10
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.first, self.bytes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.lanes = np.zeros(1 << 18, np.uint64)
        self.words = self.ids = self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        mask = (1 << self.bits) - 1
        while len(left):
            k = self.keys[slot]
            hit = k == hashes[left]
            out[left[hit]] = self.entry[slot[hit]]
            go = ~hit & (k != 0)
            left, slot = left[go], (slot[go] + 1) & mask
        return out

    def add(self, hashes: np.ndarray, lanes: Lanes, which: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Entries of new words of distinct hashes."""
        n = len(hashes)
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int32, n) // 4
        counts = lanes.counts[which]
        begin = np.cumsum(counts) - counts
        entry = np.arange(self.words, self.words + n)
        for name in ("start", "length", "first", "bytes"):
            setattr(self, name, grown(getattr(self, name), self.words + n))
        self.pool, self.lanes = grown(self.pool, self.ids + len(flat)), grown(self.lanes, self.used + int(counts.sum()))
        self.start[entry], self.length[entry] = self.ids + np.cumsum(size) - size, size
        self.pool[self.ids : self.ids + len(flat)] = flat
        self.first[entry], self.bytes[entry] = self.used + begin, lanes.lengths[which]
        self.lanes[self.used : self.used + int(counts.sum())] = lanes.values[np.repeat(lanes.first[which] - begin, counts) + np.arange(int(counts.sum()))]
        self.words, self.ids, self.used = self.words + n, self.ids + len(flat), self.used + int(counts.sum())
        left, slot, mask = np.arange(n), (hashes >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(left):
            free = np.nonzero(self.keys[slot] == 0)[0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.entry[slot[won]] = hashes[left[won]], entry[left[won]]
            go = np.ones(len(left), bool)
            go[won] = False
            left, slot = left[go], (slot[go] + 1) & mask
        return entry

    def gather(self, lanes: Lanes, fill: Callable[[np.ndarray], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and where each word's end; ``fill`` gives the ids of the numbered words.

        A word whose hash belongs to another one, in the block or in the table, is filled by itself and not remembered.
        """
        hashes = np.maximum(lanes.hashes(), np.uint64(1))
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.words + len(distinct) > self.most or self.used > 8 * self.most:
            while len(distinct) > self.most:
                self.bits, self.most = self.bits + 1, 2 * self.most
            self.clear()
        entry = self.find(distinct)
        known = np.nonzero(entry >= 0)[0]
        fits = np.ones(len(distinct), bool)
        fits[known] = lanes.equal(at[known], self.lanes, self.first[entry[known]], self.bytes[entry[known]])
        fresh = np.nonzero(entry < 0)[0]
        if len(fresh):
            entry[fresh] = self.add(distinct[fresh], lanes, at[fresh], fill(at[fresh]))
        every = np.arange(len(hashes))
        odd = np.nonzero(~fits[inverse] | ~lanes.equal(every, lanes.values, lanes.first[at[inverse]], lanes.lengths[at[inverse]]))[0]
        lengths, begins, pool = self.length[entry][inverse].astype(np.int64), self.start[entry][inverse], self.pool
        if len(odd):
            extra = fill(odd)
            lengths[odd] = [len(x) // 4 for x in extra]
            begins[odd] = self.ids + np.cumsum(lengths[odd]) - lengths[odd]
            pool = np.concatenate((pool[: self.ids], np.frombuffer(b"".join(extra), "<u4")))
        ends = np.cumsum(lengths)
        return pool[np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], ends
