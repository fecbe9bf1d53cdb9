"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words' buckets (weight log(1 + count), scaled to unit length), statistics of its shape in coarse bins, and the
bin of its length as the table gives it (``n_chars``).  With weights w and factors V the score is the logistic function of

    w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairs cost one pass over the features.  The model is fitted on the driver on at most ``SAMPLE`` labelled rows (those of the
smallest id hashes outside the held-out fold); every document is then scored in a narrow pass.

Edge cases: a null or empty text has no words and its own bins; a null ``n_chars`` has its own bin; without labels, or with labels of
one kind only, the score is that share for every document; a null ``doc_id`` is scored and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, split_of
from .labels import sample, targets, with_targets
from .words import chunks, text_buffers, words

SAMPLE = 6000
WORD_BUCKETS = 1 << 14
BINS = 12
FACTORS = 8
EPOCHS = 12
THRESHOLD = 0.3
STATISTICS = ("upper", "symbol", "digit", "bar", "non_ascii", "word_length", "distinct", "line_length", "stops", "size")
WIDTH = WORD_BUCKETS + BINS * (len(STATISTICS) + 1) + 1

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[[*b"!#$%&*+/<=>@[]^_`{}~\\"]] = 2
_KIND[48:58] = 3
_KIND[ord("|")] = 4
_KIND[128:] = 5
_KIND[10] = 6
_KIND[[*b".,;:?"]] = 7


def binned(share: np.ndarray) -> np.ndarray:
    """0 for none, then bins of equal width in the square root of a share."""
    return np.where(share <= 0, 0, 1 + np.minimum((np.sqrt(np.clip(share, 0, 1)) * (BINS - 1)).astype(np.int64), BINS - 2))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values from each offset to the next."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value triples of some texts, in order of row; ``n_chars`` is -1 where null."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    kind = _KIND[data]
    starts, stops, hashes = words(data, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    count = np.maximum(np.bincount(row, minlength=n), 1)
    key, times = np.unique(row * WORD_BUCKETS + (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), return_counts=True)
    rows, which, value = key // WORD_BUCKETS, key % WORD_BUCKETS, np.log1p(times)
    norm = np.sqrt(np.maximum(np.bincount(rows, value * value, n), 1e-12))
    value = value / norm[rows]
    lines = sums(kind == 6, offsets) + 1
    stats = [sums(kind == k, offsets) / size for k in (1, 2, 3, 4, 5)]
    stats += [np.minimum(np.bincount(row, stops - starts, n) / count / 20, 1), np.bincount(rows, minlength=n) / count, np.minimum(size / lines / 2000, 1), sums(kind == 7, offsets) / size, np.minimum(np.log1p(size) / 14, 1)]
    extra = [WORD_BUCKETS + BINS * i + binned(s) for i, s in enumerate(stats)]
    extra.append(WORD_BUCKETS + BINS * len(STATISTICS) + np.where(n_chars < 0, 0, 1 + np.minimum((np.log1p(np.maximum(n_chars, 0)) / 1.3).astype(np.int64), BINS - 2)))
    extra.append(np.full(n, WIDTH - 1))
    k = len(extra)
    rows = np.concatenate((rows, np.repeat(np.arange(n), k)))
    which = np.concatenate((which, np.stack(extra, 1).ravel()))
    value = np.concatenate((value, np.full(n * k, 0.5)))
    order = np.argsort(rows, kind="stable")
    return rows[order], which[order], value[order]


class Machine:
    """Factorisation machine for a 0/1 label."""

    def __init__(self, width: int = WIDTH, factors: int = FACTORS, seed: int = 3):
        self.w0, self.w = 0.0, np.zeros(width)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (width, factors))

    def raw(self, rows: np.ndarray, which: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and each row's factor sums."""
        x = self.v[which] * value[:, None]
        first = np.searchsorted(rows, np.arange(n + 1))
        inner = np.zeros((n, self.v.shape[1]))
        squares = np.bincount(rows, (x * x).sum(1), n)
        filled = first[1:] > first[:-1]
        if filled.any():
            inner[filled] = np.add.reduceat(x, first[:-1][filled])
        return self.w0 + np.bincount(rows, self.w[which] * value, n) + 0.5 * ((inner * inner).sum(1) - squares), inner

    def fit(self, rows: np.ndarray, which: np.ndarray, value: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02, decay: float = 1e-4) -> Machine:
        """Adam on the logistic loss, with weight decay on what a batch touches."""
        n = len(y)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
        self.w0 = float(np.log(share / (1 - share)))
        if n == 0 or y.min() == y.max():
            self.v[:] = 0
            return self
        first = np.searchsorted(rows, np.arange(n + 1))
        rng = np.random.default_rng(11)
        params = np.concatenate((self.w[:, None], self.v), 1)
        m, s, t = np.zeros_like(params), np.zeros_like(params), 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                pick = order[at : at + batch]
                idx = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
                r = np.repeat(np.arange(len(pick)), first[pick + 1] - first[pick])
                f, x = which[idx], value[idx]
                self.w, self.v = params[:, 0], params[:, 1:]
                z, inner = self.raw(r, f, x, len(pick))
                g = (1 / (1 + np.exp(-z)) - y[pick])[r] / len(pick)
                grad = np.concatenate(((g * x)[:, None], (g * x)[:, None] * (inner[r] - self.v[f] * x[:, None])), 1)
                used, inverse = np.unique(f, return_inverse=True)
                total = np.zeros((len(used), params.shape[1]))
                np.add.at(total, inverse, grad)
                total += decay * params[used]
                t += 1
                m[used] = 0.9 * m[used] + 0.1 * total
                s[used] = 0.99 * s[used] + 0.01 * total * total
                params[used] -= rate * m[used] / (1 - 0.9**t) / (np.sqrt(s[used] / (1 - 0.99**t)) + 1e-8)
        self.w, self.v = params[:, 0].copy(), params[:, 1:].copy()
        return self


def lengths(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("n_chars").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``most`` labelled documents outside the held-out fold."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            size, ids, y = lengths(batch), batch.column("doc_id").to_pylist(), batch.column("y").to_pylist()
            for a, b in chunks(offsets):
                rows, which, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size[a:b])
                cuts = np.searchsorted(rows, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array(y[a:b], pa.int32()), pa.array([which[i:j].astype("<i4").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), pa.array([value[i:j].astype("<f4").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                    ["doc_id", "y", "which", "value"],
                )

    rows = with_targets(docs.select("doc_id", "text", "n_chars"), sample(targets(labels, target).select("doc_id", "y"), most)).transform(mapped, extracted, "doc_id long, y int, which binary, value binary")
    got = sorted(rows.collect(), key=lambda r: (r.doc_id, r.which))
    which = [np.frombuffer(r.which, "<i4") for r in got]
    row = np.repeat(np.arange(len(got)), [len(x) for x in which])
    flat = np.concatenate(which).astype(np.int64) if got else np.zeros(0, np.int64)
    value = np.concatenate([np.frombuffer(r["value"], "<f4") for r in got]).astype(np.float64) if got else np.zeros(0)
    return Machine().fit(row, flat, value, np.array([r.y for r in got], np.float64))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Machine(1, 1)
        model.w0, model.w, model.v = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            size = lengths(batch)
            out = np.zeros(batch.num_rows)
            for a, b in chunks(offsets):
                rows, which, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size[a:b])
                out[a:b] = 1 / (1 + np.exp(-np.clip(model.raw(rows, which, value, b - a)[0], -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    fold = F.coalesce(split_of() == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", "n_chars", fold).transform(mapped, run, "doc_id long, held_out boolean, score double, predicted int")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    from .common import table

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    return score(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
