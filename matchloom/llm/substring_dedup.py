"""Substring dedup: Rabin-Karp hashes of all windows of 13 words, counted in Spark, then merged to removal intervals.

Three passes, all over whole texts.

1. Each task hashes every window of its documents (polynomial over mixed word hashes, 64 bits and a check byte), keeps for each window
   only the smallest document it has seen, and deals the sorted windows out by hash range as packed blocks.  Documents
   that lose a window inside the task are noted at once, so a passage that a third of all documents share costs one
   entry per task flush, not one per document.
2. A task per group of hash ranges merges the blocks and finds, for each window, the documents beyond the smallest.
   It deals out the lost windows by document group.
3. Documents, as compressed blocks of the same groups, meet their lost windows; the covered words are removed in
   maximal intervals.

The first shuffle moves about nine bytes a window.  There are as many buckets and groups as the texts' bytes (summed up beforehand)
need, so that memory stays the same at any input size.  Beyond 2^14 buckets (64 GB of text) windows are dealt like in a radix
sort: by the leading bits first, and within those, many blocks together, by the next ones, so that blocks stay large.

Edge cases: a null or empty text has no words; documents of fewer than 13 words have no window; rows with a null
``doc_id`` are returned whole and lend no windows; rows with the same ``doc_id`` are one document; other columns are carried along, but for
those that have the names of the result's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, remembered
from .words import chunks, mix, text_buffers, words

WINDOW = 13
FLUSH_WINDOWS = 1_000_000
#: Bytes of text whose windows make a bucket, on average: some 600,000 windows, two million at most.
BUCKET_BYTES = 4 << 20
#: Leading hash bits that one pass deals by.
PASS_BITS = 14
BLOCKS = "slot int, kind int, payload binary"

_WORD_BASE, _CHECK_BASE = 0xD1342543DE82EF95, 0xA0761D6478BD642F


def rolled(hashes: np.ndarray, base: int, window: int) -> np.ndarray:
    """Polynomial hash of each run of ``window`` hashes, by Horner's rule over shifted slices."""
    n = len(hashes) - window + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(window if n > 0 else 0):
        out = out * np.uint64(base) + hashes[j : j + n]
    return mix(out)


def window_hashes(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, check byte and row number of every window in these texts."""
    starts, _, hashes = words(data, offsets)
    rows = np.searchsorted(offsets, starts, "right") - 1
    n = len(starts) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    whole = rows[:n] == rows[window - 1 :]
    return rolled(hashes, _WORD_BASE, window)[whole], (rolled(hashes, _CHECK_BASE, window)[whole] >> np.uint64(56)).astype(np.uint8), rows[:n][whole]


def pack_windows(hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> bytes:
    """Sorted hashes as byte planes of their steps, check bytes, and documents by number or in a narrow type."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    first, steps = steps[:1].copy(), steps.copy()
    steps[0] = 0
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8)
    known, number = np.unique(docs, return_inverse=True)
    base, span = int(known[0]), int(known[-1]) - int(known[0])
    wide = np.uint32 if span < 1 << 32 else np.uint64
    narrow = np.uint16 if len(known) <= 1 << 16 else np.uint32
    if known.nbytes + len(docs) * np.dtype(narrow).itemsize < len(docs) * np.dtype(wide).itemsize:
        form, body = np.dtype(narrow).itemsize, known.tobytes() + number.astype(narrow).tobytes()
    else:
        form, known, body = np.dtype(wide).itemsize, known[:0], (docs - base).astype(np.uint64).astype(wide).tobytes()
    head = np.array([len(hashes), planes, form, len(known), base], np.int64).tobytes()
    return head + first.tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes() + checks.tobytes() + body


def unpack_windows(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, planes, form, known, base = np.frombuffer(payload, np.int64, 5).tolist()
    first, at = np.frombuffer(payload, np.uint64, 1, 40)[0], 48
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :planes] = np.frombuffer(payload, np.uint8, n * planes, at).reshape(planes, n).T
    at += n * planes
    checks = np.frombuffer(payload, np.uint8, n, at)
    at += n
    if known:
        docs = np.frombuffer(payload, np.int64, known, at)[np.frombuffer(payload, f"u{form}", n, at + 8 * known)]
    else:
        docs = np.frombuffer(payload, f"u{form}", n, at).astype(np.int64) + base
    return np.cumsum(steps.view(np.uint64)[:, 0], dtype=np.uint64) + first, checks, docs


def firsts(hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, in order of hash, of each window's smallest document; and those of all its other documents."""
    order = np.argsort(hashes)
    h = hashes[order]
    same = h[1:] == h[:-1]
    run = np.zeros(len(h), bool)
    run[1:] |= same
    run[:-1] |= same
    at = np.nonzero(run)[0]
    if not len(at):
        return order, order[:0]
    sub = order[at]
    sub = sub[np.lexsort((docs[sub], checks[sub], hashes[sub]))]
    order[at] = sub
    new = np.ones(len(sub), bool)
    new[1:] = (hashes[sub[1:]] != hashes[sub[:-1]]) | (checks[sub[1:]] != checks[sub[:-1]])
    lead = docs[sub[np.maximum.accumulate(np.where(new, np.arange(len(sub)), 0))]]
    stays = np.ones(len(order), bool)
    stays[at] = new
    return order[stays], sub[~new & (docs[sub] > lead)]


def group_of(docs: np.ndarray, groups: int) -> np.ndarray:
    return (mix(docs.view(np.uint64) if docs.dtype == np.int64 else docs.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def pack_lost(docs: np.ndarray, hashes: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Lost windows by document group: distinct documents and counts (compressed), and hashes."""
    if not len(docs):
        return
    codec = pa.Codec("zstd")
    slot = group_of(docs, groups)
    order = np.lexsort((hashes, docs, slot))
    slot, docs, hashes = slot[order], docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    slot, docs, hashes = slot[new], docs[new], hashes[new]
    cuts = [0, *(np.nonzero(np.diff(slot))[0] + 1).tolist(), len(slot)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        known, counts = np.unique(docs[a:b], return_counts=True)
        head = codec.compress(np.diff(known, prepend=0).tobytes() + counts.astype(np.uint32).tobytes(), asbytes=True)
        yield int(slot[a]), np.array([len(known), len(head)], np.int64).tobytes() + head + hashes[a:b].tobytes()


def unpack_lost(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = np.frombuffer(payload, np.int64, 2).tolist()
    head = pa.Codec("zstd").decompress(payload[16 : 16 + size], 12 * n, asbytes=True)
    docs = np.cumsum(np.frombuffer(head, np.int64, n))
    return np.repeat(docs, np.frombuffer(head, np.uint32, n, 8 * n)), np.frombuffer(payload, np.uint64, -1, 16 + size)


def blocks(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    slot, kind, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["slot", "kind", "payload"])


def in_parts(rows: list[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += len(r[2])
        if size >= most:
            yield blocks(part)
            part, size = [], 0
    if part:
        yield blocks(part)


def bucket_bits(docs: DataFrame) -> int:
    """So many leading hash bits that a bucket holds the windows of about ``BUCKET_BYTES``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4, (size // BUCKET_BYTES).bit_length())


def dealt(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Blocks of each window's smallest document by leading bits, and of the windows that other documents have lost already.

    The latter only pass through the next step, whatever their slot.
    """
    h, c, d = (np.concatenate(x) for x in zip(*held, strict=True))
    keep, gone = firsts(h, c, d)
    rows = [(s, 1, p) for s, p in pack_lost(d[gone], h[gone], groups)]
    h, c, d = h[keep], c[keep], d[keep]
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    cuts = [0, *(np.nonzero(np.diff(slot))[0] + 1).tolist(), len(slot)]
    rows += [(int(slot[a]), 0, pack_windows(h[a:b], c[a:b], d[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    yield from in_parts(rows)


def lost_windows(docs: DataFrame, window: int, bits: int, groups: int, tasks: int, pass_bits: int = PASS_BITS) -> DataFrame:
    """Blocks of windows that documents lose, by document group."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("windows", tuple)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        for batch in batches:
            ids = batch.column("doc_id")
            batch = batch.filter(ids.is_valid())
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column("text"))
            for a, b in chunks(offsets):
                h, c, r = window_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window)
                if len(h):
                    held.append((h, c, ids[a:b][r]))
                    count += len(h)
                if count >= FLUSH_WINDOWS:
                    yield from dealt(held, min(bits, pass_bits), groups)
                    held, count = [], 0
        if held:
            yield from dealt(held, min(bits, pass_bits), groups)

    def finer(to: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            count, at = 0, -1
            for batch in batches:
                for slot, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if kind:
                        yield blocks([(slot, 1, payload.as_py())])
                        continue
                    if held and (slot != at or count >= 2 * FLUSH_WINDOWS):
                        yield from dealt(held, to, groups)
                        held, count = [], 0
                    at = slot
                    held.append(unpack_windows(payload.as_py()))
                    count += len(held[-1][0])
            if held:
                yield from dealt(held, to, groups)

        return run

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        bucket, parts = -1, []

        def close() -> None:
            nonlocal count
            if len(parts) > 1:
                h, c, d = (np.concatenate(x) for x in zip(*map(unpack_windows, parts), strict=True))
                _, gone = firsts(h, c, d)
                if len(gone):
                    lost.append((d[gone], h[gone]))
                    count += len(gone)

        def emit() -> Iterator[pa.RecordBatch]:
            d, h = (np.concatenate(x) for x in zip(*lost, strict=True))
            yield from in_parts([(s, 0, p) for s, p in pack_lost(d, h, groups)])

        for batch in batches:
            passing = []
            for slot, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = payload.as_py()
                if kind:
                    passing.append((slot, 0, payload))
                    continue
                if slot != bucket:
                    close()
                    bucket, parts = slot, []
                parts.append(payload)
            yield from in_parts(passing)
            if count >= FLUSH_WINDOWS:
                yield from emit()
                lost, count = [], 0
        close()
        if lost:
            yield from emit()

    def by_slot(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "slot").sortWithinPartitions("slot")

    windows = by_slot(docs.select("doc_id", "text").transform(mapped, hashed, BLOCKS))
    for have in range(pass_bits, bits, pass_bits):
        windows = by_slot(windows.transform(mapped, finer(min(bits, have + pass_bits)), BLOCKS))
    return windows.transform(mapped, merged, BLOCKS)


def intervals(removed: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed words as (first, end)."""
    edge = np.diff(np.concatenate(([0], removed.view(np.int8), [0])))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))


def removal(text: bytes, lost: np.ndarray, window: int) -> tuple[int, np.ndarray, bytes]:
    """Number of words, which are removed, and the rest joined by blanks."""
    data = np.frombuffer(text, np.uint8)
    starts, _, hashes = words(data, np.zeros(0, np.int64))
    hit = np.isin(rolled(hashes, _WORD_BASE, window), lost)
    edge = np.zeros(len(starts) + 1, np.int64)
    at = np.nonzero(hit)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    removed = np.cumsum(edge)[:-1] > 0
    kept = text.split()
    return len(starts), removed, b" ".join([w for w, r in zip(kept, removed.tolist(), strict=True) if not r])


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False, pass_bits: int = PASS_BITS) -> DataFrame:
    """``docs`` with kept_text, n_words, n_removed and spans (maximal removed word ranges); with ``digest`` only doc_id, the counts and kept_sha256."""
    spark, docs = docs.sparkSession, docs.drop("kept_text", "n_words", "n_removed", "spans")
    bits = bucket_bits(docs)
    groups, tasks = 1 << bits, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields]
    if digest:
        docs, fields = docs.select("doc_id", "text"), []
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    else:
        schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ", kept_text string, n_words long, n_removed long, spans array<struct<first:int,end:int>>"
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            slot = group_of(ids, groups)
            order = np.argsort(slot, kind="stable")
            cuts = [0, *(np.nonzero(np.diff(slot[order]))[0] + 1).tolist(), len(order)]
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    sink = pa.BufferOutputStream()
                    part = batch.take(pa.array(order[a:b]))
                    with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                        w.write_batch(part)
                    rows.append((int(slot[order[a]]), 1, sink.getvalue().to_pybytes()))
            yield from in_parts(rows)

    def finished(part: pa.RecordBatch, docs_lost: np.ndarray, lost: np.ndarray) -> pa.RecordBatch:
        ids = part.column("doc_id").cast(pa.int64())
        out: list[tuple] = []
        for doc, text in zip(ids.to_pylist(), part.column("text").to_pylist(), strict=True):
            raw = (text or "").encode()
            a, b = (0, 0) if doc is None else np.searchsorted(docs_lost, [doc, doc + 1] if doc < (1 << 63) - 1 else [doc, doc])
            if b > a:
                n, removed, kept = removal(raw, lost[a:b], window)
                spans = intervals(removed)
                gone = int(removed.sum())
            else:
                kept = raw.split()
                n, gone, spans, kept = len(kept), 0, [], b" ".join(kept)
            out.append((hashlib.sha256(kept).hexdigest(), n, gone) if digest else (kept.decode(), n, gone, [{"first": x, "end": y} for x, y in spans]))
        text, n, gone, *spans = zip(*out, strict=True)
        if digest:
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans[0], span)], [*part.schema.names, "kept_text", "n_words", "n_removed", "spans"])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, table = -1, [], None
        empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        for batch in batches:
            for slot, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if slot != at:
                    at, parts, table = slot, [], None
                if kind == 0:
                    parts.append(payload.as_py())
                    continue
                if table is None:
                    d, h = (np.concatenate(x) for x in zip(*map(unpack_lost, parts), strict=True)) if parts else empty
                    order = np.argsort(d, kind="stable")
                    table = d[order], h[order]
                with pa.ipc.open_stream(payload.as_buffer()) as r:
                    for part in r:
                        if part.num_rows:
                            yield finished(part, *table)

    lost = lost_windows(docs, window, bits, groups, tasks, pass_bits)
    texts = docs.transform(mapped, grouped, BLOCKS)
    return lost.union(texts).repartition(tasks, "slot").sortWithinPartitions("slot", "kind").transform(mapped, reduced, schema)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Substring dedup over all documents."""
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM wins GROUP BY k
), hit AS (
  SELECT DISTINCT doc_id, i + o AS i FROM (SELECT x.doc_id, x.i FROM wins x JOIN firsts f ON x.k = f.k WHERE x.doc_id > f.first_doc), (SELECT unnest(range(0, 13)) AS o)
), toks AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), kept AS (
  SELECT t.doc_id, count(*) FILTER (WHERE h.i IS NULL) AS n_kept, string_agg(t.word, ' ' ORDER BY t.i) FILTER (WHERE h.i IS NULL) AS s
  FROM toks t LEFT JOIN hit h ON t.doc_id = h.doc_id AND t.i = h.i GROUP BY t.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
