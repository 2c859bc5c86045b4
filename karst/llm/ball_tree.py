"""Centroid clustering of integer vectors, exact, with whole balls of vectors assigned at once.

Each partition builds metric trees over blocks of its vectors, once: a node is a ball with its centre, radius, count and the integer sum of
its vectors, halved along the line between two far vectors down to leaves of a few vectors. The trees are written to the shared
folder. In a round every tree is walked from its root, level by level: by the triangle inequality a centroid whose least distance to a
ball exceeds another's greatest can be nearest to none of its vectors; where one centroid is left, the whole ball is its, with count and
sum; else the walk goes on below, and in leaves exact distances decide. Only sums leave a task, one row for each centroid.

Distances in leaves, sums and means are integers, so ties and results do not depend on how the vectors are dealt out; bounds of balls are
floating point with a margin above their error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack, session_of, staged, task, unpack

#: Vectors of one tree, at most, and of a leaf.
BLOCK, LEAF = 8192, 24
#: Vectors with a larger component do not take part: their squared distances would not fit in a long.
LARGEST = 1 << 27
#: Components up to which sums of squares are exact in double precision.
EXACT = 1 << 22


def tree(v: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the vectors, and the nodes of their tree, parents before children: first and end in that order, left child (right is the
    next; -1: leaf), centre, radius and sum."""
    order, nodes, todo = np.arange(len(v)), [], [(0, len(v))]
    left: list[int] = []
    at = 0
    while at < len(todo):
        a, z = todo[at]
        own = order[a:z]
        x = v[own].astype(float)
        middle = x.mean(axis=0)
        far = ((x - middle) ** 2).sum(axis=1)
        nodes.append((a, z, middle, np.sqrt(far.max())))
        if z - a > leaf and far.max() > 0:
            p = x[far.argmax()]
            q = x[((x - p) ** 2).sum(axis=1).argmax()]
            half = (z - a) // 2
            order[a:z] = own[np.argpartition(x @ (q - p), half)]
            left.append(len(todo))
            todo += [(a, a + half), (a + half, z)]
        else:
            left.append(-1)
        at += 1
    sums = np.concatenate([np.zeros((1, v.shape[1]), np.int64), np.cumsum(v[order], axis=0, dtype=np.int64)])
    a, z = (np.array([n[k] for n in nodes]) for k in (0, 1))
    return order, {"first": a, "end": z, "left": np.array(left), "centre": np.array([n[2] for n in nodes]), "radius": np.array([n[3] for n in nodes]), "sum": sums[z] - sums[a]}


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors (rows) to centroids (columns)."""
    if not len(v) or max(np.abs(v).max(), np.abs(centroids).max()) <= EXACT and v.shape[1] <= 128:
        a, c = v.astype(float), centroids.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def assign(v: np.ndarray, t: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For vectors in the order of their tree: the nearest centroid of each (ties: the first), and sums and counts of the centroids' vectors."""
    k = len(centroids)
    own, sums, counts = np.full(len(v), -1, np.int64), np.zeros((k, v.shape[1]), np.int64), np.zeros(k, np.int64)
    at, able = np.zeros(1, np.int64), np.ones((1, k), bool)
    c = centroids.astype(float)
    while len(at):
        m, r = t["centre"][at], t["radius"][at][:, None]
        d = np.sqrt(np.maximum(((m[:, None, :] - c) ** 2).sum(axis=2), 0))
        slack = 1e-9 * (1 + d + r)
        farthest = np.where(able, d + r + slack, np.inf).min(axis=1, keepdims=True)
        able = able & (d - r - slack <= farthest)
        sure = able.sum(axis=1) == 1
        for node, who in zip(at[sure], able[sure].argmax(axis=1), strict=True):
            own[t["first"][node] : t["end"][node]] = who
        who = able[sure].argmax(axis=1)
        np.add.at(sums, who, t["sum"][at[sure]])
        np.add.at(counts, who, (t["end"] - t["first"])[at[sure]])
        rest, able = at[~sure], able[~sure]
        leaf = t["left"][rest] < 0
        some = _spread(t["first"][rest[leaf]], t["end"][rest[leaf]])
        if len(some):
            who = squared(v[some], centroids).argmin(axis=1)
            own[some] = who
            np.add.at(sums, who, v[some])
            counts += np.bincount(who, minlength=k)
        below = t["left"][rest[~leaf]]
        at, able = np.concatenate([below, below + 1]), np.concatenate([able[~leaf]] * 2)
    return own, sums, counts


def _spread(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    many = end - first
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


def _width(v: np.ndarray) -> np.dtype:
    return np.dtype("<i2" if not len(v) or np.abs(v).max() < 1 << 15 else "<i4")


def _trees(dims: int):
    """Trees over blocks of a partition's vectors, one row each."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        v = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
        order, nodes = tree(v)
        ids = t["vec_id"].combine_chunks().take(pa.array(order))
        width, low = _width(v), np.column_stack([nodes["first"], nodes["end"], nodes["left"]]).astype("<i4")
        return pa.RecordBatch.from_pydict({
            "ids": [pack(ids.to_numpy(zero_copy_only=False).astype(np.int64))], "vectors": [pack(v[order].astype(width).reshape(-1))], "wide": [width.itemsize], "nodes": [pack(low.reshape(-1))],
            "centres": [pack(nodes["centre"].astype("<f8").reshape(-1).view("<i8"))], "radii": [pack(nodes["radius"].astype("<f8").view("<i8"))], "sums": [pack(nodes["sum"].reshape(-1))],
        })

    def trees(batches):
        held, rows = [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                if rows + part.num_rows > BLOCK:
                    yield block(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield block(held)

    return task(trees)


def _read(b: pa.RecordBatch, dims: int):
    for r in b.to_pylist():
        low = unpack(r["nodes"], "<i4").reshape(-1, 3).astype(np.int64)
        t = {
            "first": low[:, 0], "end": low[:, 1], "left": low[:, 2], "centre": unpack(r["centres"], "<i8").view("<f8").reshape(-1, dims),
            "radius": unpack(r["radii"], "<i8").view("<f8"), "sum": unpack(r["sums"], "<i8").reshape(-1, dims),
        }
        yield unpack(r["ids"], "<i8"), unpack(r["vectors"], f"<i{r['wide']}").astype(np.int64).reshape(-1, dims), t


def _summed(centroids: np.ndarray, dims: int):
    """Count and sum of the vectors nearest to each centroid, one row for each centroid and task."""

    def summed(batches):
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for b in batches:
            for _, v, t in _read(b, dims):
                _, s, n = assign(v, t, centroids)
                sums, counts = sums + s, counts + n
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_pydict({"cluster": some, "n": counts[some], **{f"s{k}": sums[some, k] for k in range(dims)}})

    return task(summed)


def _assigned(centroids: np.ndarray, dims: int):
    def assigned(batches):
        for b in batches:
            for ids, v, t in _read(b, dims):
                own, _, _ = assign(v, t, centroids)
                d = ((v - centroids[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": own.astype(np.int32), "distance": d})

    return task(assigned)


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id long, vector array<long>: floor(scale * x) of the vectors that take part; see ball_tree_clusters()."""
    own = F.col("embedding").cast("array<double>")
    sound = (F.size(own) == dims) & F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST / scale))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(own, lambda x: F.floor(x * scale).cast("long")).alias("vector"))


def ball_tree_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each vector that takes part.

    vectors: vec_id long, embedding array of numbers; other columns are ignored. Components become floor(scale * x). The first centroids are
    the k vectors whose sha256 of ``seed:vec_id`` is least, in that order (ties by components). Each round gives every vector to its nearest
    centroid (ties: the smaller number) and moves each centroid that has vectors to floor(sum / count); then vectors are given out
    once more. centroid_sha256: of the last centroid's components as decimals joined by commas.

    Rows with a null vec_id, a null vector, another length than dims, or a component that is null, not finite or above 2**27 / scale
    (whose squared distances a long cannot hold) take no part. Repeated rows count once each. Fewer than k vectors give fewer centroids; an
    empty table gives no rows.
    """
    session_of(vectors)
    rows = whole_vectors(vectors, dims, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(key, "vector").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not first:
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")))).limit(0)
    centroids = np.array([r["vector"] for r in first], np.int64)
    trees = staged(rows.mapInArrow(_trees(dims), "ids binary, vectors binary, wide long, nodes binary, centres binary, radii binary, sums binary"))
    columns = [f"s{j}" for j in range(dims)]
    for _ in range(rounds):
        found = trees.mapInArrow(_summed(centroids, dims), f"cluster long, n long, {', '.join(f'{c} long' for c in columns)}")
        found = found.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in columns))
        moved = centroids.copy()
        for r in found.collect():  # one row for each centroid
            moved[r["cluster"]] = [int(r[c]) // r["n"] for c in columns]
        if (moved == centroids).all():
            break  # further rounds change nothing
        centroids = moved
    given = staged(trees.mapInArrow(_assigned(centroids, dims), schema))
    sums = {r["cluster"]: int(r["d"]) for r in given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = F.col("cluster") + 1
    return given.select(
        "vec_id", "cluster", "distance",
        F.element_at(F.array(*(F.lit(sums.get(j, 0)).cast("long") for j in range(len(centroids)))), at).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.element_at(F.array(*(F.lit(x) for x in names)), at).alias("centroid_sha256"),
    )
