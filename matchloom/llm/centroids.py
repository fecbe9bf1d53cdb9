"""Centroid clustering: Lloyd's rounds over a cover tree of the vectors and a tree of the centroids.

Components become integers, so sums, floors and distances are exact and no order of summation matters.  Each task builds cover trees of its vectors
once, in blocks of at most ``BLOCK``: equal vectors of a block become one point with a weight; a node's children lie within half
of its radius and are further than that from each other.  The trees are written to the shared folder and read again in every round.

A round sends the centroids (k rows, bounded by the parameter) and a cover tree of these along with the tasks.  Pairs of nodes, one of each tree, go
down together, all pairs of a block as arrays: a pair is pruned when even its nearest points are further apart than the vector node's
furthest point can be from some centroid.  A node with one centroid left is settled as a whole by its stored sum; points whose node ends with several
are compared with those exactly.  Tasks return one sum per cluster, which Spark adds up; the driver gets k rows a round.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are left out; integers
beyond 2^27 either way are taken as that bound (distances then still fit a long); fewer vectors than k make fewer clusters; rows that
repeat a ``vec_id`` are vectors of their own, and of equal hashes the smaller vector seeds first; a null ``vec_id`` is assigned but never seeds;
equal distances go to the smaller cluster; an empty cluster keeps its centroid; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, stored

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
SEED = "1"
#: Vectors of a tree, and points of a node that isn't divided any more.
BLOCK, LEAF = 1024, 8
MOST = 1 << 27
#: Up to here squared distances are exact as doubles.
EXACT = 1 << 22
_LONG = (1 << 63) - 1


def usable(vector: str, dimensions: int) -> Column:
    """``dimensions`` components, none null or not finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) == dimensions) & finite, F.lit(False))


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -MOST, MOST).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows pair by pair, exact."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1 << 14):
        d = a[at : at + (1 << 14)] - b[at : at + (1 << 14)]
        out[at : at + (1 << 14)] = np.einsum("ij,ij->i", d, d)
    return out


def distances(points: np.ndarray) -> np.ndarray:
    """Distances of all pairs of a block."""
    if np.abs(points).max(initial=0) <= EXACT:
        x = points.astype(np.float64)
        n = np.einsum("ij,ij->i", x, x)
        return np.sqrt(np.maximum(n[:, None] + n - 2 * (x @ x.T), 0))
    return np.stack([np.sqrt(squared(np.broadcast_to(p, points.shape), points).astype(np.float64)) for p in points])


class Tree(NamedTuple):
    """A cover tree; the points of a node are a range, so ``order`` tells where each one went.

    Node i has its centre at point ``centre[i]``, all its points within ``radius[i]``, the nodes ``child[first[i]:first[i + 1]]`` below it, and the points
    ``loose[start[i]:start[i + 1]]`` that are in none of these.
    """

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    child: np.ndarray
    start: np.ndarray
    loose: np.ndarray


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    far = distances(points)
    order: list[int] = []
    centre, radius, low, high, below, loose = [], [], [], [], [], []

    def grow(c: int, members: np.ndarray) -> int:
        """The node around ``c`` of all ``members`` (``c`` among them); it goes as deep as halvings of the radius."""
        me, r = len(centre), float(far[c, members].max())
        centre.append(c)
        radius.append(r)
        low.append(len(order))
        high.append(0)
        below.append([])
        loose.append([])
        single = [members] if len(members) <= leaf or r == 0 else []
        rest, at = (members[:0] if single else members), c
        while len(rest):
            near = far[at, rest] <= r / 2
            part, rest = rest[near], rest[~near]
            if len(part) > 1:
                below[me].append(grow(at, part))
            else:
                single.append(part)
            if len(rest):
                at = int(rest[0])
        for part in single:
            for p in part.tolist():
                loose[me].append(len(order))
                order.append(p)
        high[me] = len(order)
        return me

    grow(0, np.arange(len(points)))
    placed = np.empty(len(order), np.int64)
    placed[order] = np.arange(len(order))
    ints = [np.array(x, np.int64) for x in (order, placed[centre], low, high, np.cumsum([0, *map(len, below)]), [c for x in below for c in x], np.cumsum([0, *map(len, loose)]), [p for x in loose for p in x])]
    return Tree(ints[0], ints[1], np.array(radius), *ints[2:])


class Centroids:
    """Centroids with their cover tree, as items: 0 to k - 1 are the centroids themselves, later ones the tree's nodes."""

    def __init__(self, rows: np.ndarray):
        self.rows, k = rows, len(rows)
        t = cover_tree(rows, leaf=1)
        self.centre = np.concatenate((np.arange(k), t.order[t.centre]))
        self.radius = np.concatenate((np.zeros(k), t.radius))
        parts = [np.concatenate((k + t.child[t.first[i] : t.first[i + 1]], t.order[t.loose[t.start[i] : t.start[i + 1]]])) for i in range(len(t.centre))]
        self.child = np.concatenate(parts)
        self.first = np.concatenate((np.zeros(k, np.int64), np.cumsum([0, *map(len, parts)])))
        self.root = k
        self.holds = np.zeros((k + len(parts), k), bool)
        self.holds[np.arange(k), np.arange(k)] = True
        for i in range(len(parts)):
            self.holds[k + i, t.order[t.low[i] : t.high[i]]] = True


def unfolded(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges ``first[at]`` to ``first[at + 1]``: which of ``at`` each element belongs to, and the element's place."""
    n = first[at + 1] - first[at]
    who = np.repeat(np.arange(len(at)), n)
    return who, first[at][who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)


def descend(points: np.ndarray, tree: Tree, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dual-tree assignment: settled nodes and their clusters, then points compared one by one and theirs; each point is in exactly one of the two.

    ``points`` are in the tree's order.
    """
    k = len(centroids.rows)
    x, c = points.astype(np.float64), centroids.rows.astype(np.float64)
    node, item = np.zeros(1, np.int64), np.full(1, centroids.root)
    settled, singles, options = [], [], []
    while len(node):
        d = np.sqrt(np.einsum("ij,ij->i", e := x[tree.centre[node]] - c[centroids.centre[item]], e))
        begins = np.flatnonzero(np.diff(node, prepend=-1))
        group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(node))))
        # an item's centre is a centroid, so every point of the node has one within this
        bound = np.minimum.reduceat(d, begins)[group] + tree.radius[node]
        keep = d - tree.radius[node] - centroids.radius[item] <= bound * (1 + 1e-9) + 1e-6
        node, item, group = node[keep], item[keep], group[keep]
        many = np.bincount(group)[group] > 1
        done = ~many & (item < k)
        settled.append((node[done], item[done]))
        node, item, group = node[~done], item[~done], group[~done]
        if not len(node):
            break
        # the wider side is divided first
        wide = (item >= k) & (centroids.radius[item] >= tree.radius[node])
        wait = np.bincount(group, wide)[group] > 0
        who, at = unfolded(centroids.first, item[wide])
        deeper = [(node[wide][who], centroids.child[at]), (node[wait & ~wide], item[wait & ~wide])]
        node, item = node[~wait], item[~wait]
        who, at = unfolded(tree.first, node)
        deeper.append((tree.child[at], item[who]))
        begins = np.flatnonzero(np.diff(node, prepend=-1))
        if len(begins):
            held = np.logical_or.reduceat(centroids.holds[item], begins)
            who, at = unfolded(tree.start, node[begins])
            singles.append(tree.loose[at])
            options.append(held[who])
        node, item = (np.concatenate(z) for z in zip(*deeper, strict=True))
        by = np.lexsort((item, node))
        node, item = node[by], item[by]
    nodes, clusters = (np.concatenate(z) for z in zip(*settled, strict=True))
    if not singles:
        return nodes, clusters, np.zeros(0, np.int64), np.zeros(0, np.int64)
    alone = np.concatenate(singles)
    row, cluster = np.nonzero(np.concatenate(options))
    d = squared(points[alone[row]], centroids.rows[cluster])
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.flatnonzero(d == np.minimum.reduceat(d, begins)[row]) if len(begins) else begins
    return nodes, clusters, alone, cluster[best[np.flatnonzero(np.diff(row[best], prepend=-1))]]


#: A block: its distinct vectors in the tree's order, their weights, the tree, and every row's id and place.
FIELDS = ("points", "weight", "centre", "radius", "low", "high", "first", "child", "start", "loose")
TREES = ", ".join(f"{c} binary" for c in FIELDS) + ", ids array<long>, places array<int>"


def plant(vectors: DataFrame, dimensions: int, scale: int, block: int) -> DataFrame:
    """The cover trees of (vec_id, embedding), in blocks within each task; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def full() -> pa.RecordBatch:
            ids = pa.concat_arrays([i for i, _ in held])
            points, places, weight = np.unique(np.concatenate([v for _, v in held]), axis=0, return_inverse=True, return_counts=True)
            tree = cover_tree(points)
            placed = np.empty(len(points), np.int32)
            placed[tree.order] = np.arange(len(points), dtype=np.int32)
            values = [points[tree.order].astype(np.int32), weight[tree.order].astype(np.int64), *tree[1:]]
            columns = [pa.array([v.tobytes()], pa.binary()) for v in values]
            lists = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([placed[places.ravel()].tolist()], pa.list_(pa.int32()))]
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, *lists], [*FIELDS, "ids", "places"])

        room = block
        for batch in batches:
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            at = 0
            while at < batch.num_rows:
                stop = min(batch.num_rows, at + room)
                held.append((batch.column("vec_id").slice(at, stop - at), integers(values[at:stop], scale)))
                room -= stop - at
                at = stop
                if not room:
                    yield full()
                    room = block
        if held:
            yield full()

    return vectors.transform(mapped, run, TREES)


def opened(batch: pa.RecordBatch, row: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, Tree]:
    """Points, weights and tree of a stored block."""
    kinds = {"points": np.int32, "radius": np.float64}
    got = {c: np.frombuffer(batch.column(c)[row].as_buffer(), kinds.get(c, np.int64)) for c in FIELDS}
    points = got["points"].reshape(-1, dimensions).astype(np.int64)
    return points, got["weight"], Tree(np.arange(len(points)), *(got[c] for c in FIELDS[2:]))


def sums(trees: DataFrame, rows: np.ndarray, dimensions: int) -> dict[int, tuple[int, list[int]]]:
    """By cluster, the number of vectors nearest to it and their sums: k rows, one partial row per cluster and task."""
    k = len(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows)
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                points, weight, tree = opened(batch, i, dimensions)
                nodes, of, alone, own = descend(points, tree, centroids)
                weighted = points * weight[:, None]
                upto = np.concatenate((np.zeros((1, dimensions), np.int64), np.cumsum(weighted, axis=0)))
                many = np.append(0, np.cumsum(weight))
                np.add.at(count, of, many[tree.high[nodes]] - many[tree.low[nodes]])
                np.add.at(total, of, upto[tree.high[nodes]] - upto[tree.low[nodes]])
                np.add.at(count, own, weight[alone])
                np.add.at(total, own, weighted[alone])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = trees.select(*FIELDS).transform(mapped, run, "cluster long, n long, total array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dimensions)])
    return {r["cluster"]: (r["n"], [r[f"t{i}"] for i in range(dimensions)]) for r in added.collect()}


def assigned(trees: DataFrame, rows: np.ndarray, dimensions: int) -> DataFrame:
    """vec_id, cluster and squared distance of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows)
        for batch in batches:
            for i in range(batch.num_rows):
                points, _, tree = opened(batch, i, dimensions)
                nodes, of, alone, own = descend(points, tree, centroids)
                cluster = np.empty(len(points), np.int64)
                cluster[alone] = own
                for lo, hi, c in zip(tree.low[nodes].tolist(), tree.high[nodes].tolist(), of.tolist(), strict=True):
                    cluster[lo:hi] = c
                d = squared(points, rows[cluster])
                at = batch.column("places")[i].values.to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(cluster[at].astype(np.int32)), pa.array(d[at])], ["vec_id", "cluster", "distance"])

    return trees.transform(mapped, run, "vec_id long, cluster int, distance long")


def seeds(vectors: DataFrame, k: int, scale: int) -> np.ndarray:
    """The k vectors of the smallest hashes of ``1:<vec_id>``."""
    named = vectors.where("vec_id IS NOT NULL").withColumn("_hash", F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256))
    return integers(np.array([r.embedding for r in named.orderBy("_hash", "embedding").limit(k).collect()]), scale)


def moved(rows: np.ndarray, found: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Centroids after a round: exact floors of the means; those of no vector stay."""
    return np.array([[t // found[i][0] for t in found[i][1]] if i in found else r for i, r in enumerate(rows.tolist())], np.int64)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid (array<long>) of every usable row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable("embedding", dimensions))
    rows = seeds(kept, k, scale)
    if not len(rows):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    trees, _ = stored(plant(kept, dimensions, scale, block), "cover-trees")
    for _ in range(rounds):
        rows = moved(rows, sums(trees, rows, dimensions))
    out = cut(assigned(trees, rows, dimensions))
    inertia = {r["cluster"]: int(r["total"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    whole = min(sum(inertia.values()), _LONG)
    told = spark.createDataFrame([(c, min(t, _LONG), whole, rows[c].tolist()) for c, t in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # k rows at most
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all embeddings."""
    from .common import table

    out = cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _oracle() -> str:
    """Rounds of assignment and exact floors of means, unrolled."""
    parts = [
        """kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept
), c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS cluster, v FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16
)"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS (
  SELECT vec_id, arg_min({{'c': cluster, 'd': d}}, (d, cluster)) AS best FROM (
    SELECT vec_id, cluster, list_sum(list_transform(list_zip(k.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, c{r}) GROUP BY vec_id
)""")
        if r < ROUNDS:
            parts.append(f"""m{r} AS (
  SELECT cluster, list(x ORDER BY i) AS v FROM (
    SELECT best.c AS cluster, i, ((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS x FROM parts JOIN a{r} USING (vec_id) GROUP BY best.c, i) GROUP BY cluster
), c{r + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster
)""")
    return (
        "WITH "
        + ", ".join(parts)
        + f"""
SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.best.c"""
    )


ORACLE = _oracle()
