"""Sequence packing by Karmarkar-Karp multiway differencing.

Every task streams its own documents, so nothing is shuffled and no key can run hot.  Consecutive documents of
a partition form shards of about ``SHARD_WINDOWS`` windows, or of ``MOST_DOCUMENTS`` documents if these are tiny.  In a shard, every full window of a long document is a
sequence by itself; what remains is cut into items of at most ``max_item`` tokens (neighbouring tiny ones make one item), and multiway differencing deals the
items out: it keeps merging the two partial partitions with the widest spread, largest window on smallest.  It starts at
the least window count that could hold the shard, and while the fullest window exceeds the capacity the count rises by
one.  The last shard of a partition takes up to twice as many windows, so that no small rest is left over; a partition
that holds less than one window in all is written as power-of-two sequences, which need no padding.

Edge cases: a null or empty text has only its separator token; a null ``doc_id`` is packed like any other; repeated rows are
packed each on its own; a text of any length is cut into full windows and one rest; among equal spreads and sizes the earlier item goes first, so
a partition's pieces are the same at every run; an empty table gives no pieces; columns other than the two named are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, remembered
from .words import Lanes, WordTable, chunks, spans, text_buffers

CAPACITY = 4096
SHARD_WINDOWS = 256
MAX_ITEM = 1024
#: Neighbouring items below this many tokens are dealt out together, up to this many.
TOGETHER = 128
#: Shards of tiny documents end here.
MOST_DOCUMENTS = 1 << 17
SEPARATOR = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal ``sizes`` into ``k`` windows by the largest differencing method; the item numbers of each window.

    A partial partition is its filled windows only, largest first, so memory follows the items and not items times windows.
    """
    n = len(sizes)
    left: list[int] = []
    right: list[int] = []
    heap = [(-int(size) if k > 1 else 0, i, np.array([size]), np.array([i])) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        # largest on smallest: only where both are filled do two windows become one
        alone, other = min(len(a), k - len(b)), min(len(b), k - len(a))
        both = len(a) - alone
        joined = n + len(left) + np.arange(both)
        left += na[alone:].tolist()
        right += nb[other:][::-1].tolist()
        sums = np.concatenate((a[:alone], a[alone:] + b[other:][::-1], b[:other]))
        nodes = np.concatenate((na[:alone], joined, nb[:other]))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), tie, sums, nodes))
        tie += 1
    windows = []
    for root in heap[0][3] if heap else []:
        stack, items = [int(root)], []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += (left[x - n], right[x - n])
        windows.append(sorted(items))
    return windows


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; every size is at most ``capacity``."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += 1


def plan(lengths: list[int], capacity: int, max_item: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document number, start, length, sequence number, offset) of documents with these token counts."""
    pieces, sequence = [], 0
    items: list[list[tuple[int, int, int]]] = []
    weights: list[int] = []
    total = sum(lengths)
    if total < capacity:
        offset, room = 0, 1 << max(total, 1).bit_length() - 1
        for d, n in enumerate(lengths):
            start = 0
            while start < n:
                take = min(n - start, room - offset)
                pieces.append((d, start, take, sequence, offset))
                start, offset, total = start + take, offset + take, total - take
                if offset == room:
                    sequence, offset, room = sequence + 1, 0, 1 << max(total, 1).bit_length() - 1
        return pieces
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            pieces.append((d, start, capacity, sequence, 0))
            start, sequence = start + capacity, sequence + 1
        parts = -(-(n - start) // max_item)
        for i in range(parts):
            take = -(-(n - start) // (parts - i))
            if weights and weights[-1] + take <= min(TOGETHER, capacity):
                items[-1].append((d, start, take))
                weights[-1] += take
            else:
                items.append([(d, start, take)])
                weights.append(take)
            start += take
    if items:
        for window in windows_of(weights, capacity):
            offset = 0
            for d, start, take in chain.from_iterable(items[i] for i in window):
                pieces.append((d, start, take, sequence, offset))
                offset += take
            sequence += 1
    return pieces


class BulkEncoder:
    """Token ids through the ``tokenizers`` library, asked once for each word that a task doesn't remember.

    The vocabulary drops white space and never joins across it, lower-cases, and splits a comma or full stop off a word before white
    space.  So texts are cut at blanks and line ends and before such a mark, lower-cased in ASCII, and hashed as byte
    arrays; the distinct words of a block of texts are looked up by hash and compared byte for byte, and new ones go to the library many
    at a time.  Blocks with combining marks or what may be a special token are neither lower-cased nor cut at marks.
    """

    TOGETHER = 500
    BLOCK = 1 << 20

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table = WordTable()

    def ask(self, words: list[str]) -> list[bytes]:
        """Ids of words that hold no blank, from the library."""
        out: list[bytes] = []
        lines = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        for line, e in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4").tobytes()
            starts = np.cumsum([0] + [len(x) + 1 for x in line])
            cuts = np.searchsorted(np.array([a for a, _ in e.offsets], np.int64), starts).tolist()
            out += [ids[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``data`` one after the other, and where each text's begin and end."""
        solid = _SOLID[data]
        plain = not (_MARKS[data].any() or b"<|" in data.tobytes())
        cuts = None
        if plain:
            cuts = np.zeros(len(data), bool)
            cuts[1:] = _STOP[data[1:]] & _LETTER[data[:-1]]
            cuts[:-1] &= ~solid[1:] | np.isin(np.arange(1, len(data)), offsets)
            data = _LOWER[data]
        starts, stops = spans(data, offsets, solid, cuts)

        def fill(fresh: np.ndarray) -> list[bytes]:
            return self.ask([data[a:b].tobytes().decode() for a, b in zip(starts[fresh].tolist(), stops[fresh].tolist(), strict=True)])

        ids, ends = self.table.gather(Lanes(data, starts, stops), fill)
        return ids, np.concatenate(([0], ends))[np.searchsorted(starts, offsets)]


_SOLID, _STOP, _LETTER, _MARKS = (np.zeros(256, bool) for _ in range(4))
_SOLID[:] = True
_SOLID[[10, 32]] = False
_STOP[[ord(","), ord(".")]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Lead bytes of U+0300 to U+037F, the combining marks.
_MARKS[[0xCC, 0xCD]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def encoder(path: str) -> BulkEncoder:
    return remembered(("encoder", path), lambda: BulkEncoder(path))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, max_item: int = MAX_ITEM, shard_windows: int = SHARD_WINDOWS, ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences; with ``ids`` each piece carries its token ids as array<int>."""
    schema = SCHEMA + (", ids array<int>" if ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, tail = encoder(tokenizer_path), np.array([separator], "<u4").tobytes()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        waiting: list[tuple[int | None, bytes]] = []
        held = 0

        def flush(n: int) -> pa.RecordBatch:
            nonlocal base, held, waiting
            shard, waiting = waiting[:n], waiting[n:]
            rows = []
            made = plan([len(b) // 4 for _, b in shard], capacity, max_item)
            for d, start, length, sequence, offset in made:
                doc, b = shard[d]
                piece = b[4 * start : 4 * (start + length)]
                rows.append((doc, start, length, zlib.crc32(piece), len(b) // 4, base + sequence, offset) + ((np.frombuffer(piece, "<u4").astype(np.int32),) if ids else ()))
            base += max((x[3] for x in made), default=-1) + 1
            held -= sum(len(b) // 4 for _, b in shard)
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        target = shard_windows * capacity
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            data, offsets = text_buffers(texts)
            for a, b in chunks(offsets, enc.BLOCK):
                found, cuts = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for doc, x, y in zip(doc_ids[a:b], cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    waiting.append((doc, found[x:y].tobytes() + tail))
                    held += y - x + 1
                while (held >= 2 * target or len(waiting) >= 2 * MOST_DOCUMENTS) and len(waiting) > 1:
                    n = total = 0
                    while total < target and n < MOST_DOCUMENTS:
                        total += len(waiting[n][1]) // 4
                        n += 1
                    yield flush(n)
        if waiting:
            yield flush(len(waiting))

    return docs.select("doc_id", "text").transform(mapped, run, schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
