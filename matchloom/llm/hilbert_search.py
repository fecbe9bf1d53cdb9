"""Approximate nearest neighbours by inner product along shifted Hilbert curves.

Equal vectors collapse to one class first, with the few smallest ids that any answer can need.  Vectors get one more component that makes them
equally long, so that the largest inner product is the smallest angle.  Each of several curves orders a random projection of the
vectors, shifted against the cells; a vector's place on a curve is its quantile among the keys of a bounded sample (``SAMPLE`` classes
of the smallest hashes), with ties spread by id hash.  Each curve is cut at quantiles into parts of about ``PART`` vectors, range-partitioned by Spark.
A query compares itself with the vectors whose places are within its window, on every curve, and the best of all curves are merged
by their exact scores.

The window is fitted on truth: ``FIT_QUERIES`` sampled vectors are compared with every vector (in blocks; only scores and places leave
the tasks), and the half-width is the ``TARGET`` quantile of how far their true neighbours lie from them on the nearest curve.  Of all
numbers of curves from two up that reach the target, the one with the least to compare is taken.  So the window is as narrow as the table
allows: where vectors come in clusters, the share to compare falls as the table grows; where they have no structure
at all no order of them is of use, windows are wide, and work comes near that of a full scan on each curve.

Edge cases: vectors that are null, empty, zero or not finite, or of another length than most of the sample, and null ids, take
no part; rows that repeat a ``vec_id`` with the same vector count once, with another vector each counts; with fewer candidates than asked for, all are returned; ties go to the smaller id;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mapped, partitions
from .vectors import matrix, usable
from .words import mix

CURVES = 8
FEWEST = 2
DIMENSIONS = 8
CELL_BITS = 6
SAMPLE = 4096
FIT_QUERIES = 64
TARGET = 0.95
PART = 4096
K = 20
VISITS = "slot long, kind int, place double, h1 long, h2 long, ids binary, vector binary"
FOUND = "h1 long, h2 long, payload binary"
GAPS = "query int, score double, gaps array<double>"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of ``bits``-bit coordinates) on the Hilbert curve, by Skilling's transform."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Projections, shifts and sampled keys of all curves; ``fit`` sets how many are used and the window's half-width."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int = CURVES, seed: int = 5):
        self.longest, self.width = longest, sample.shape[1]
        lifted = self.lift(sample)
        m = min(DIMENSIONS, lifted.shape[1])
        rng = np.random.default_rng(seed)
        self.axes = [np.linalg.qr(rng.normal(size=(lifted.shape[1], m)))[0] for _ in range(curves)]
        self.shifts = [rng.uniform(0, 1, m) for _ in range(curves)]
        self.centre, self.scale = [], []
        for a in self.axes:
            y = lifted @ a
            self.centre.append(y.mean(0))
            self.scale.append(np.maximum(y.std(0), 1e-12))
        self.sorted = [np.sort(self.key(lifted, c)) for c in range(curves)]
        self.used, self.half = curves, 1.0

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors * vectors).sum(1), 0))
        return np.concatenate((vectors, rest[:, None]), 1)

    def key(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        y = (lifted @ self.axes[curve] - self.centre[curve]) / self.scale[curve]
        cells = ((y + 3) / 6 * ((1 << CELL_BITS) - 1) + self.shifts[curve]).astype(np.int64)
        return hilbert_keys(np.clip(cells, 0, (1 << CELL_BITS) - 1), CELL_BITS)

    def places(self, lifted: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        """Quantiles in 0 to 1; between sampled keys in proportion, among equal keys by id hash."""
        known, key = self.sorted[curve], self.key(lifted, curve)
        a, b = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
        spread = (mix(ids.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        low, high = known[np.maximum(a - 1, 0)], known[np.minimum(a, len(known) - 1)]
        between = np.where(high > low, (key - low) / np.maximum(high - low, 1), spread)
        at = np.where(b > a, a + spread * (b - a), a - 1 + np.clip(between, 0, 1))
        return np.clip(at / max(len(known) - 1, 1), 0, 1)

    def all_places(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places on every curve, one row a curve."""
        lifted = self.lift(vectors)
        return np.stack([self.places(lifted, ids, c) for c in range(len(self.axes))])

    def fit(self, gaps: np.ndarray) -> None:
        """The number of curves and the half-width that find TARGET of the true neighbours with the least to compare; ``gaps`` has a row a neighbour and a column a curve."""
        if not len(gaps):
            return
        halves = [float(np.quantile(gaps[:, :m].min(1), TARGET)) for m in range(1, gaps.shape[1] + 1)]
        self.used = min(range(min(FEWEST, len(halves)), len(halves) + 1), key=lambda m: (m * min(1.0, 2 * halves[m - 1]), m))
        self.half = halves[self.used - 1]


def scored(query: np.ndarray, vectors: np.ndarray, inside: np.ndarray, ids: list[np.ndarray], first: np.ndarray, k: int) -> Iterator[bytes]:
    """Of each query the k best (id, exact score) among the classes that are inside its window, best first."""
    rough = np.where(inside, query @ vectors.T, -np.inf)
    enough = min(k, vectors.shape[0])
    floor = -np.partition(-rough, enough - 1, axis=1)[:, enough - 1]
    for q, (scores, low) in enumerate(zip(rough, floor, strict=True)):
        slack = 1e-9 * (1 + abs(low)) if np.isfinite(low) else 0
        pick = np.nonzero((scores >= low - slack) & np.isfinite(scores))[0]
        exact = (vectors[pick] * query[q]).sum(1)
        best = np.lexsort((first[pick], -exact))[:k]
        near = [ids[i] for i in pick[best].tolist()]
        yield packed(np.concatenate([np.zeros(0, np.int64), *near]), np.repeat(exact[best], [len(x) for x in near]), k)


def packed(ids: np.ndarray, scores: np.ndarray, k: int) -> bytes:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order].astype("<i8").tobytes() + scores[order].astype("<f8").tobytes()


def vectors_of(column: pa.Array) -> np.ndarray:
    return matrix(column.cast(pa.list_(pa.float64())))


def search(rows: DataFrame, every: int = 20, k: int = K, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each vec_id divisible by ``every``."""
    spark = rows.sparkSession
    keys = ["h1", "h2"]
    valid = rows.where(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", F.col("embedding").alias("v"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    # the limit is applied before the shuffle too, so a vector that many rows share sends a few of them from each task
    by_id = Window.partitionBy(*keys).orderBy("vec_id")
    smallest = valid.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k + 1)
    asking = valid.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", *keys)
    asked = asking.select(*keys).distinct().withColumn("asks", F.lit(True))
    classes = smallest.groupBy(*keys).agg(F.first("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    classes = cut(classes.join(asked, keys, "left").select(*keys, "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks")))
    some = classes.orderBy(F.xxhash64(*keys), *keys).limit(SAMPLE).select("v", F.col("ids")[0].alias("id")).collect()
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(r.v) for r in some]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n))
    classes = classes.where(F.size("v") == width)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, longest = classes.agg(F.count("*"), F.sqrt(F.max(squares))).first()
    known = np.array([r.v for r in some if len(r.v) == width], float)
    tried, tried_ids = known[:FIT_QUERIES], np.array([r.id for r in some if len(r.v) == width][:FIT_QUERIES], np.int64)
    curves = Curves(known, float(longest))
    fitted = spark.sparkContext.broadcast((curves, tried, curves.all_places(tried, tried_ids)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, query, asked_at = fitted.value
        best: list[list[tuple[float, list[float]]]] = [[] for _ in query]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                v = vectors_of(rows.column("v"))
                scores = query @ v.T
                scores[(v[None, :, :1] == query[:, None, :1])[:, :, 0] & (scores >= (query * query).sum(1)[:, None] - 1e-9) & (v[None] == query[:, None]).all(2)] = -np.inf
                place = c.all_places(v, first_ids(rows))
                top = np.argpartition(-scores, min(k, len(v)) - 1, axis=1)[:, : min(k, len(v))]
                gaps = np.abs(place[:, top] - asked_at[:, :, None])
                for q in range(len(query)):
                    mine = [(float(scores[q, i]), gaps[:, q, j].tolist()) for j, i in enumerate(top[q].tolist()) if np.isfinite(scores[q, i])]
                    best[q] = sorted(best[q] + mine, reverse=True)[:k]
        flat = [(q, s, g) for q, mine in enumerate(best) for s, g in mine]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.float64()), pa.array([x[2] for x in flat], pa.list_(pa.float64()))], ["query", "score", "gaps"])

    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "gaps")
    truth = classes.select("v", "ids").transform(mapped, measured, GAPS).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("gaps").collect()
    curves.fit(np.array([r.gaps for r in truth]))
    parts = max(1, -(-total // part))
    shared = spark.sparkContext.broadcast(curves)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                v = vectors_of(rows.column("v"))
                place, ask = c.all_places(v, first_ids(rows)), np.nonzero(rows.column("asks").to_numpy(zero_copy_only=False))[0]
                raw = [x.tobytes() for x in (v.astype(np.float32) if (v.astype(np.float32) == v).all() else v)]
                known = [np.array(x, "<i8").tobytes() for x in rows.column("ids").to_pylist()]
                columns: list[list[np.ndarray]] = [[], [], [], []]
                for curve in range(c.used):
                    here = place[curve]
                    low, high = (np.clip((x * parts).astype(np.int64), 0, parts - 1) for x in (here[ask] - c.half, here[ask] + c.half))
                    visits = high - low + 1
                    to = np.repeat(low - np.cumsum(visits) + visits, visits) + np.arange(visits.sum())
                    own = np.minimum((here * parts).astype(np.int64), parts - 1)
                    which = np.concatenate((np.arange(len(v)), np.repeat(ask, visits)))
                    for x, y in zip(columns, (np.concatenate((own, to)) + curve * parts, np.repeat([0, 1], [len(v), visits.sum()]), here[which], which), strict=True):
                        x.append(y)
                slot, kind, spot, which = map(np.concatenate, columns)
                taken = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(kind, pa.int32()), pa.array(spot), rows.column("h1").take(taken), rows.column("h2").take(taken), pa.array([known[i] if j == 0 else b"" for i, j in zip(which.tolist(), kind.tolist(), strict=True)], pa.binary()), pa.array([raw[i] for i in which], pa.binary())],
                    [x.split()[0] for x in VISITS.split(", ")],
                )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, at = shared.value.half, None
        spots, vectors, ids, first = np.zeros(0), np.zeros((0, width)), [], np.zeros(0, np.int64)
        held: list[tuple[float, np.ndarray, np.ndarray]] = []
        asked: list[tuple[float, np.ndarray, int, int]] = []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal spots, vectors, ids, first, held
            if held:
                spots, vectors, ids = np.array([x[0] for x in held]), np.stack([x[1] for x in held]), [x[2] for x in held]
                first, held = np.array([x[0] for x in ids]), []
            if not asked or not len(spots):
                return
            near = np.array([x[0] for x in asked])
            a, b = np.searchsorted(spots, near[0] - half), np.searchsorted(spots, near[-1] + half, "right")
            if a < b:
                inside = np.abs(spots[None, a:b] - near[:, None]) <= half
                got = list(scored(np.stack([x[1] for x in asked]), vectors[a:b], inside, ids[a:b], first[a:b], k + 1))
                yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in asked], pa.int64()), pa.array([x[3] for x in asked], pa.int64()), pa.array(got, pa.binary())], ["h1", "h2", "payload"])

        for batch in batches:
            for slot, kind, spot, h1, h2, known, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slot != at:
                    yield from answer()
                    at, held, asked = slot, [], []
                    spots = np.zeros(0)
                v = np.frombuffer(raw, np.float32 if len(raw) == 4 * width else np.float64).astype(np.float64)
                if kind == 0:
                    held.append((spot, v, np.frombuffer(known, "<i8")))
                    continue
                asked.append((spot, v, h1, h2))
                if len(asked) == 128:
                    yield from answer()
                    asked = []
        yield from answer()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, near, scores = None, [], []

        def close() -> tuple[np.ndarray, np.ndarray]:
            i, s = np.concatenate(near), np.concatenate(scores)
            _, one = np.unique(np.stack((i, s.view(np.int64))), axis=1, return_index=True)
            order = one[np.lexsort((i[one], -s[one]))[: k + 1]]
            return i[order], s[order]

        def rows_of(done: list[tuple]) -> pa.RecordBatch:
            lists = pa.array([[{"id": i, "score": s} for i, s in zip(x[1].tolist(), x[2].tolist(), strict=True)] for x in done], pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())])))
            return pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in done], pa.int64()), pa.array([x[0][1] for x in done], pa.int64()), lists], ["h1", "h2", "near"])

        for batch in batches:
            done = []
            for h1, h2, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h1, h2) != at:
                    if near:
                        done.append((at, *close()))
                    at, near, scores = (h1, h2), [], []
                n = len(payload) // 16
                near.append(np.frombuffer(payload, "<i8", n))
                scores.append(np.frombuffer(payload, "<f8", n, 8 * n))
                if len(near) > 256:
                    i, s = close()
                    near, scores = [i], [s]
            if done:
                yield rows_of(done)
        if near:
            yield rows_of([(at, *close())])

    n = partitions(spark)
    visits = classes.transform(mapped, placed, VISITS).repartitionByRange(n, "slot").sortWithinPartitions("slot", "kind", "place")
    found = visits.transform(mapped, searched, FOUND).repartition(n, *keys).sortWithinPartitions(*keys)
    lists = found.transform(mapped, merged, "h1 long, h2 long, near array<struct<id:long,score:double>>")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asking.select(F.col("vec_id").alias("query_id"), *keys).distinct().join(lists, keys).select("query_id", F.posexplode(others).alias("at", "of"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("of.id").alias("vec_id"), F.col("of.score").alias("score"))


def first_ids(rows: pa.RecordBatch) -> np.ndarray:
    """The smallest id of each class."""
    ids = rows.column("ids")
    return ids.flatten().to_numpy()[np.concatenate(([0], np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))[:-1])).astype(np.int64)]


def op8_hilbert_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vec_id divisible by 20."""
    from .common import table

    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
