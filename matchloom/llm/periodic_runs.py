"""Periodic runs of words: Lyndon stacks under both orders, compared and extended by rolling-hash LCE.

A run is a maximal stretch with a smallest period.  By the runs theorem each run holds a word that is the longest Lyndon word at its
start, under one of the two opposite orders of the alphabet.  So each text is scanned from right to left twice: a stack, kept as the
next smaller suffix of each position, gives the longest Lyndon word that begins there, and that is the only candidate at
this position under this order.  Suffixes whose first words differ are compared by these; others by their longest common extension (LCE), found
by binary search over rolling hashes.  Since equal words have equal hashes, an LCE is never found too short; the words it covers are then
compared themselves, so it is never too long either.  Extensions known from the same distance are used again and not compared twice.
Candidates that aren't repeated at least ``EXPONENT - 1`` times are dropped by one array comparison of hashes, the others extended both ways
in the same manner, and every run's words compared with those one period on.

No suffix array is built.  A text is one task's work, linear in its words up to the logarithm of the searches; rows are never shuffled.

Edge cases: a null, empty or blank text has no words and no runs; rows that repeat a ``doc_id`` are texts of their own; a null ``doc_id`` is kept, and
the query's rewriting by the id's hash leaves its text as it is; columns other than the two named are not read; of runs of equal
exponent the smallest start comes first, then the smallest period; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

#: A run has at least so many words, and at least so many times its period.
LEAST_WORDS, EXPONENT = 6, 4
BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
SUMMARY = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Words:
    """Word numbers of one text with rolling hashes of all its stretches."""

    #: So many words are compared one by one before hashes are used.
    DIRECT = 8

    def __init__(self, ids: list[int], base: int = BASE):
        self.ids, self.n = ids, len(ids)
        self.array = np.array(ids, np.int64)
        with np.errstate(over="ignore"):
            powers = np.full(self.n + 1, base, np.uint64)
            powers[0] = 1
            self.powers = np.cumprod(powers)
            self.prefix = np.zeros(self.n + 1, np.uint64)
            # word numbers spread over 64 bits, so that small ones don't cancel out
            spread = (self.array.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
            np.cumsum((spread ^ (spread >> np.uint64(29))) * self.powers[:-1], out=self.prefix[1:])
        #: By distance: where the last extension was asked for, and how long it was.
        self.known: dict[int, tuple[int, int]] = {}

    def same(self, i: int, j: int, length: int) -> bool:
        """Whether the hashes of two stretches agree (i < j)."""
        p, q = self.prefix, self.powers
        return (int(p[i + length]) - int(p[i])) * int(q[j - i]) & _ALL == (int(p[j + length]) - int(p[j])) & _ALL

    def all_same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``same`` of many pairs."""
        p = self.prefix
        with np.errstate(over="ignore"):
            return (p[i + length] - p[i]) * self.powers[j - i] == p[j + length] - p[j]

    def longest(self, most: int, equal: Callable[[int], bool]) -> int:
        """The largest length up to ``most`` that is ``equal``; shorter ones are too."""
        step = 1
        while step < most and equal(step):
            step *= 2
        lo, hi = step // 2, min(step, most)
        if hi == most and equal(most):
            return most
        while lo < hi - 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if equal(mid) else (lo, mid)
        return lo

    def differ(self, i: int, j: int, length: int) -> int:
        """How many words agree from ``i`` and ``j`` on, of ``length``, by the words themselves."""
        a = self.array
        for at in range(0, length, 1 << 14):
            stop = min(length, at + (1 << 14))
            found = np.flatnonzero(a[i + at : i + stop] != a[j + at : j + stop])
            if len(found):
                return at + int(found[0])
        return length

    def ahead(self, i: int, j: int) -> int:
        """How many words agree from ``i`` and ``j`` on (i < j)."""
        w, n = self.ids, self.n
        k, few = 0, min(self.DIRECT, n - j)
        while k < few and w[i + k] == w[j + k]:
            k += 1
        if k < few or j + k == n:
            return k
        at, reach = self.known.get(j - i, (n, 0))
        if i <= at <= i + k:  # what lies beyond was compared when it was asked for
            k = at - i + reach
        else:
            k = self.longest(n - j, lambda length: self.same(i, j, length))
            if i <= at < i + k:
                near = self.differ(i, j, at - i)
                k = near if near < at - i else near + reach
            else:
                k = self.differ(i, j, k)
        self.known[j - i] = (i, k)
        return k

    def behind(self, i: int, j: int) -> int:
        """How many words agree before ``i`` and ``j`` (i < j)."""
        k = self.longest(i, lambda length: self.same(i - length, j - length, length))
        while k and self.differ(i - k, j - k, k) < k:  # a hash that lied: never seen
            k -= self.differ(i - k, j - k, k) + 1
        return k

    def lyndon(self, upward: bool) -> list[int]:
        """Where the longest Lyndon word at each position ends: the next smaller suffix, under the words' order or the opposite one."""
        w, n, ahead = self.ids, self.n, self.ahead
        end = [n] * (n + 1)
        self.known = {}
        for i in range(n - 1, -1, -1):
            j, x = i + 1, w[i]
            while j < n:
                y = w[j]
                if x == y:
                    k = ahead(i, j)
                    if j + k == n:  # a prefix is the smaller one under both orders
                        break
                    if (w[i + k] < w[j + k]) is not upward:
                        break
                elif (x < y) is not upward:
                    break
                j = end[j]
            end[i] = j
        return end

    def runs(self, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, by start, then period."""
        found: set[tuple[int, int, int]] = set()
        at = np.arange(self.n)
        for upward in (True, False):
            period = np.array(self.lyndon(upward)[: self.n], np.int64) - at
            # a run of this exponent holds one of its Lyndon words with exponent - 1 periods from there on
            i = np.flatnonzero(at + (exponent - 1) * period <= self.n)
            if exponent > 2:
                i = i[self.array[i] == self.array[np.minimum(i + period[i], self.n - 1)]]
            p = period[i]
            keep = self.all_same(i, i + p, (exponent - 2) * p)
            last: dict[int, int] = {}
            for a, q in zip(i[keep].tolist(), p[keep].tolist(), strict=True):
                if a + 2 * q <= last.get(q, 0):  # in the run of this period just found
                    continue
                start = a - self.behind(a, a + q)
                stop = a + q + self.ahead(a, a + q)
                last[q] = max(last.get(q, 0), stop)
                if stop - start >= max(least, exponent * q):
                    if self.differ(start, start + q, stop - start - q) != stop - start - q:
                        raise RuntimeError("a run that isn't periodic")
                    found.add((start, stop - start, q))
        return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(words: list, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a word sequence."""
    if len(words) < least:
        return []
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) * exponent > len(words) and max(np.bincount(ids)) < exponent:  # every word of a run comes that often
        return []
    return Words(ids).runs(least, exponent)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def made_periodic(doc_id: int | None, words: list) -> list:
    """The query's input: of a tenth of all ids, the words from some place on are made periodic."""
    h = crc32(b"%d" % doc_id) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // p + 1))[: n - a]


def texts_of(batch: pa.RecordBatch, few: int = 64) -> Iterator[tuple[int | None, list[bytes]]]:
    """doc_id and words of each row."""
    for at in range(0, batch.num_rows, few):
        part = batch.slice(at, few)
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            yield doc_id, (text or "").encode().split()


def find_runs(docs: DataFrame, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, every run (by start, then period) and the text without repeats (words joined by one space) of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            ids, runs, texts = [], [], []
            for doc_id, words in texts_of(batch):
                got = runs_of(words, least, exponent)
                ids.append(doc_id)
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in got])
                texts.append(b" ".join(collapsed(words, got)).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").transform(mapped, run, SCHEMA)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int | None, int | None, int | None, int | None]:
    """The run of greatest exponent as (start, length, period, thousandths of the exponent); nulls if there is none."""
    if not runs:
        return (None,) * 4
    s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return s, n, q, 1000 * n // q


def summary(docs: DataFrame) -> DataFrame:
    """Number of runs, the strongest one and digests of each text of (doc_id, text), made periodic by ``made_periodic`` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SUMMARY.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, words in texts_of(batch):
                words = made_periodic(doc_id, words)
                runs = runs_of(words)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                rows.append((doc_id, len(runs), *strongest(runs), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name.endswith("sha256") else pa.int64()) for c, name in zip(columns, names, strict=True)], names)

    return docs.select("doc_id", "text").transform(mapped, run, SUMMARY)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of them made periodic."""
    from .common import table

    return summary(table(spark, sf_dir, "documents", "doc_id", "text"))
