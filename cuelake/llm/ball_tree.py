"""Centroid clustering of integer vectors, with metric trees that assign whole balls of vectors at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.staging import written

#: Vectors of one tree, and of one leaf at most.
ROWS, LEAF = 8192, 32
#: Components are below this in size, so that squared distances fit 64 bits.
LARGEST = 1 << 27
TREE = "vec_ids array<long>, vectors binary, centres binary, radii binary, bounds binary, childs binary, sums binary"


def kept(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors with `dims` components, none null or non-finite, as integers floor(scale * x)."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


class Tree:
    """A metric tree over the rows of `v`, which it puts in an order such that each node's are a slice.

    Nodes stand level by level. centres and radii: all rows of a node are within the radius of its
    centre; bounds: its slice; childs: the first of its two children, 0 for a leaf; sums: of its rows.
    """

    def __init__(self, v: np.ndarray):
        self.order = np.arange(len(v))
        centres, radii, bounds, childs, sums = [], [], [], [], []
        todo = [(0, len(v))]
        while todo:
            below = []
            first_below = len(bounds) + len(todo)
            for a, b in todo:
                rows = v[self.order[a:b]]
                sums.append(rows.sum(axis=0, dtype=np.int64))
                centre = sums[-1] / (b - a)
                apart = np.sqrt(((rows - centre) ** 2).sum(axis=1))
                centres.append(centre)
                radii.append(apart.max() * (1 + 1e-9) + 1e-6)
                bounds.append((a, b))
                if b - a <= LEAF or radii[-1] < 0.5:
                    childs.append(0)
                    continue
                childs.append(first_below + len(below))
                one = rows[np.argmax(apart)]
                far = ((rows - one) ** 2).sum(axis=1)
                other = rows[np.argmax(far)]
                side = np.argsort((rows @ (other - one).astype(np.float64)), kind="stable")
                self.order[a:b] = self.order[a:b][side]
                half = a + (b - a) // 2
                below += [(a, half), (half, b)]
            todo = below
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.bounds, self.childs, self.sums = np.array(bounds, np.int64), np.array(childs, np.int64), np.array(sums, np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the nearest allowed centroid (smallest of equals) and the squared distance, exactly."""
    best, least = np.zeros(len(v), np.int64), np.full(len(v), np.iinfo(np.int64).max)
    for k in np.flatnonzero(allowed.any(axis=0)):
        mine = np.flatnonzero(allowed[:, k])
        d = ((v[mine] - centroids[k]) ** 2).sum(axis=1)
        closer = d < least[mine]
        best[mine[closer]], least[mine[closer]] = k, d[closer]
    return best, least


def assigned(v: np.ndarray, centres: np.ndarray, radii: np.ndarray, bounds: np.ndarray, childs: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Which centroid is nearest, for whole balls where it is so for all their rows, else for the rows of leaves.

    A centroid stays in question for a ball as long as it can be nearest to some point in it: its
    distance from the centre less the radius is no more than that of another plus the radius. Returns
    the balls that have one centroid left with its number, and the rows of other leaves with theirs.
    """
    spare = 1e-6 * (1 + max(np.abs(centroids).max(initial=0), np.abs(centres).max(initial=0)))
    nodes, question = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    balls, ball_of, rows, row_of = [], [], [], []
    while len(nodes):
        apart = np.sqrt(((centres[nodes][:, None, :] - centroids[None]) ** 2).sum(axis=2))
        apart[~question] = np.inf
        reach = radii[nodes][:, None]
        question &= apart - reach <= (apart + reach).min(axis=1, keepdims=True) + spare
        alone = question.sum(axis=1) == 1
        balls.append(nodes[alone])
        ball_of.append(np.argmax(question[alone], axis=1))
        nodes, question = nodes[~alone], question[~alone]
        leaf = childs[nodes] == 0
        for node, allowed in zip(nodes[leaf].tolist(), question[leaf], strict=True):
            a, b = bounds[node]
            rows.append(np.arange(a, b))
            row_of.append(np.broadcast_to(allowed, (b - a, len(centroids))))
        inner, question = nodes[~leaf], question[~leaf]
        nodes, question = np.concatenate([childs[inner], childs[inner] + 1]), np.concatenate([question, question])
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    best, _ = nearest(v[at], centroids, np.concatenate(row_of)) if rows else (np.zeros(0, np.int64), None)
    return np.concatenate(balls), np.concatenate(ball_of), at, best


def _trees(dims: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, n = [], [], 0

        def tree() -> pa.RecordBatch:
            v = np.concatenate(vectors)
            t = Tree(v)
            names = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.concat_arrays(ids).take(pa.array(t.order)))
            columns = [v[t.order].astype(np.int32), t.centres, t.radii, t.bounds, t.childs, t.sums]
            return pa.RecordBatch.from_arrays([names, *(pa.array([c.tobytes()], pa.binary()) for c in columns)], [x.split()[0] for x in TREE.split(", ")])

        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                ids.append(part.column("vec_id"))
                vectors.append(part.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dims))
                n += part.num_rows
                if n >= ROWS:
                    yield tree()
                    ids.clear(), vectors.clear()
                    n = 0
        if n:
            yield tree()

    return make


def _read(row: dict, dims: int) -> tuple[np.ndarray, ...]:
    of = lambda name, kind: np.frombuffer(row[name], kind)
    return of("vectors", np.int32).astype(np.int64).reshape(-1, dims), of("centres", float).reshape(-1, dims), of("radii", float), of("bounds", np.int64).reshape(-1, 2), of("childs", np.int64)


def _summed(trees: DataFrame, centroids: np.ndarray) -> list:
    """For each centroid: how many vectors are nearest to it, and their sum. Each task sums its trees, of whole balls without a look at their rows."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, seen = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tree = _read(row, dims)
                balls, ball_of, rows, row_of = assigned(*tree, centroids)
                own = np.frombuffer(row["sums"], np.int64).reshape(-1, dims)
                np.add.at(total, ball_of, own[balls])
                np.add.at(count, ball_of, np.diff(tree[3][balls], axis=1)[:, 0])
                np.add.at(total, row_of, tree[0][rows])
                np.add.at(count, row_of, 1)
                seen += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), pa.array(np.full(k, seen)), pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "n", "looked_at", "sums"])

    parts = trees.mapInArrow(sums, "cluster int, n long, looked_at long, sums array<long>")
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _start(rows: DataFrame, k: int, dims: int) -> np.ndarray:
    """The vectors of the k ids with the smallest digests."""
    first = rows.where("vec_id IS NOT NULL").withColumn("_hash", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["v"] for r in first.orderBy("_hash", "v").limit(k).collect()], np.int64).reshape(-1, dims)


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """One row for each kept vector of `vectors` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with `dims` components, none null or non-finite, that as integers floor(scale * x) are
    below 2^27, so that squared distances fit 64 bits. The k kept vectors whose ids have the smallest
    digests are the first centroids (of rows that repeat an id, the smaller vector first; rows whose id is
    null are clustered but don't start a cluster); if there are fewer, so are the clusters. A cluster
    without vectors keeps its centroid. With no vector to start from there are no rows. Other columns
    are not looked at.

    Trees are made once, of ROWS vectors each, in the task that reads them. A round sends k centroids to
    the tasks and k sums back from each.
    """
    spark: SparkSession = vectors.sparkSession
    rows = kept(vectors.select("vec_id", "embedding"), dims, scale)
    trees = written(rows.mapInArrow(_trees(dims), TREE), "trees")
    centroids = _start(rows, k, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = centroids.copy()
        for r in _summed(trees, centroids):
            if r["n"]:
                centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                tree = _read(row.to_pylist()[0], dims)
                v, bounds = tree[0], tree[3]
                balls, ball_of, at, best = assigned(*tree, centroids)
                cluster = np.empty(len(v), np.int32)
                for (a, b), c in zip(bounds[balls].tolist(), ball_of.tolist(), strict=True):
                    cluster[a:b] = c
                cluster[at] = best
                distance = ((v - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([row.column("vec_ids").flatten(), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = written(trees.select("vec_ids", "vectors", "centres", "radii", "bounds", "childs").mapInArrow(placed, "vec_id long, cluster int, distance long"), "clustered")
    own = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row for each cluster
    total = sum(r["cluster_inertia"] for r in own)
    known = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total, _digest(centroids[r["cluster"]])) for r in own], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
