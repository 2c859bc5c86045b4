"""Approximate nearest neighbours by largest inner product: inverted lists, and an adaptive scan of dimensions within them.

Vectors get one more component that makes all norms equal, so the largest inner product becomes the smallest distance, and are
turned by a random rotation, so that the first components estimate the whole distance. Lists are the cells of centroids fitted on
a bounded sample; every vector is indexed. How many lists a query probes is measured: for a bounded sample of queries the true
neighbours are found by brute force over all rows, and the number of lists is the smallest that holds the target share of them.

A probed list is scanned in blocks of columns. After each block a candidate whose partial distance, scaled to all columns, is
above the query's bound by more than the test allows is abandoned; the bound is the distance of the k-th nearest vector of the
sample, which no true neighbour exceeds. Vectors of the sample are never abandoned early, and those of a query's k nearest that
lie in no probed list are added, so that k vectors are always found. What remains is scored on the original vectors in double
precision.

Large lists are cut into chunks, and so are the queries that probe a list, so that no task holds more than one chunk of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_groups, session_of, staged

#: Vectors of the sample that gives centroids and bounds; sampled queries that tune the number of probes; most lists.
SAMPLE, TUNING, LISTS = 8_000, 64, 4_096
#: Vectors of a list, and queries, that meet in one task.
LIST_CHUNK, QUERY_CHUNK = 4_096, 1_024
#: Columns of a block, and the width of the hypothesis test.
COLUMNS, WIDTH = 16, 2.1
#: Queries that one task plans, about, and that are held against the sample at once.
PLANNED, TURN = 512, 256


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


@dataclass
class Lists:
    """Rotation, centroids and sample; of fixed size whatever the number of vectors."""

    norm: float
    rotation: np.ndarray
    centroids: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray
    sample_lists: np.ndarray

    def turned(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return (np.column_stack([x, extra]) @ self.rotation).astype(np.float32)

    def order(self, y: np.ndarray) -> np.ndarray:
        """The lists from the nearest centroid on."""
        return np.argsort((self.centroids**2).sum(axis=1) - 2 * y @ self.centroids.T, axis=1, kind="stable")


def centroids_of(y: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spread rows; empty cells keep their centroid."""
    c = y[np.linspace(0, len(y) - 1, many).astype(int)].copy()
    for _ in range(rounds):
        own = ((c**2).sum(axis=1) - 2 * y @ c.T).argmin(axis=1)
        size = np.bincount(own, minlength=many)
        sums = np.zeros_like(c)
        np.add.at(sums, own, y)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows; equal rows give equal sums, whatever stands around them."""
    return (x * q).sum(axis=1)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def survivors(x: np.ndarray, q: np.ndarray, bound: np.ndarray, spared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places of the pairs that no test abandons.

    x, q: turned rows; bound: squared distances, with room for rounding; spared: vectors that only the full distance can rule out.
    """
    dims = x.shape[1]
    a = min(COLUMNS, dims)
    part = (x[:, :a] ** 2).sum(axis=1)[None, :] + (q[:, :a] ** 2).sum(axis=1)[:, None] - 2 * q[:, :a] @ x[:, :a].T
    test = lambda d: (d / dims) * (1 + WIDTH / np.sqrt(d)) ** 2 if d < dims else 1.0
    i, j = np.nonzero((part <= (bound * test(a))[:, None]) | spared[None, :])
    part = part[i, j]
    while a < dims and len(i):
        z = min(dims, a + COLUMNS)
        part = part + ((x[j, a:z] - q[i, a:z]) ** 2).sum(axis=1)
        keep = (part <= bound[i] * test(z)) | (spared[j] & (z < dims))
        i, j, part, a = i[keep], j[keep], part[keep], z
    return i, j


def _pairs(k: int):
    """Candidates of each chunk of a list and of the queries that probe it."""

    def pairs(batches):
        for t, bounds in by_groups(batches, ["list", "part", "turn"]):
            kind, ids = t["query"].to_numpy(zero_copy_only=False), t["vec_id"].to_numpy()
            turned, vectors, uid, bound = t["turned"].to_pylist(), t["vector"].to_pylist(), t["uid"].to_numpy(), t["bound"].to_numpy()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for a, z in zip(bounds, bounds[1:], strict=False):
                at = np.arange(a, z)
                qs, xs = at[kind[a:z]], at[~kind[a:z]]
                if not len(qs) or not len(xs):
                    continue
                y = np.frombuffer(b"".join(turned[n] for n in xs), np.float32).reshape(len(xs), -1)
                p = np.frombuffer(b"".join(turned[n] for n in qs), np.float32).reshape(len(qs), -1)
                i, j = survivors(y, p, bound[qs], bound[xs] < 0)
                own = ids[qs][i] != ids[xs][j]
                i, j = i[own], j[own]
                x = np.frombuffer(b"".join(vectors[n] for n in xs)).reshape(len(xs), -1)
                q = np.frombuffer(b"".join(vectors[n] for n in qs)).reshape(len(qs), -1)
                score = np.concatenate([products(x[j[s : s + 65536]], q[i[s : s + 65536]]) for s in range(0, len(j), 65536)]) if len(j) else np.zeros(0)
                order = np.lexsort((ids[xs][j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, np.arange(len(qs)))
                keep = np.arange(len(i)) - first[i] < k
                for o, v in zip(out, (ids[qs][i[keep]], uid[qs][i[keep]], ids[xs][j[keep]], score[keep]), strict=True):
                    o.append(v)
            names = ("query_id", "uid", "vec_id", "score")
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else np.zeros(0, np.float64 if n == "score" else np.int64)) for o, n in zip(out, names, strict=True)], names=list(names))

    return pairs


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, the rows whose vec_id is divisible by query_every.

    vectors: vec_id long, embedding array of numbers; other columns are ignored. Nearness is the inner product in double
    precision, ties go to the smaller vec_id; with fewer than k candidates all are returned. Rows without vec_id, and vectors that
    are null, zero, hold null or non-finite components or are not of the most frequent length (the shorter, at a tie) take no
    part. Rows with the query's own vec_id are not its candidates; a repeated query gives one result, repeated vectors each count.
    recall: the share of true neighbours that the lists probed held for the queries that tuned their number.
    """
    spark = session_of(vectors)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    good = F.expr("vec_id is not null and x is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(x, c -> c <> 0)")
    rows = rows.where(good)
    shape = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(x, 0d, (s, c) -> s + c * c)")).alias("norm")).orderBy(F.desc("n"), "dims").first()
    out = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("x") == shape["dims"])
    total, dims = shape["n"], shape["dims"]
    part = min(1.0, SAMPLE / total)
    sampled = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < int(part * (1 << 30))
    taken = rows.where(sampled).limit(2 * SAMPLE).collect()  # about SAMPLE vectors
    taken = sorted(taken, key=lambda r: (r["vec_id"], r["x"])) or rows.limit(1).collect()
    sample, sample_ids = np.array([r["x"] for r in taken]), np.array([r["vec_id"] for r in taken])
    rotation = np.linalg.qr(np.random.default_rng(3).normal(size=(dims + 1, dims + 1)))[0]
    index = Lists(float(np.sqrt(shape["norm"])), rotation, np.zeros((1, dims + 1)), sample, sample_ids, sample_ids)
    turned = index.turned(sample, False)
    index.centroids = centroids_of(turned, int(max(1, min(LISTS, len(sample) // 4, round(total**0.5)))))
    index.sample_lists = index.order(turned)[:, 0]
    model = spark.sparkContext.broadcast(index)  # at most LISTS centroids and 2 * SAMPLE vectors

    def listed(batches):
        for b in batches:
            x = matrix(b.column("x"))
            y = model.value.turned(x, False)
            lists = model.value.order(y)[:, 0] if len(y) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(lists.astype(np.int32)), pa.array([v.tobytes() for v in y], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "list", "turned", "vector"])

    indexed = staged(rows.mapInArrow(listed, "vec_id long, list int, turned binary, vector binary"))
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # at most LISTS rows
        sizes[r["list"]] = r["n"]

    spread = max(2, -(-total // (query_every * PLANNED)))
    queries = rows.where(F.col("vec_id") % query_every == 0).repartition(spread, "vec_id").distinct()
    probes = _tuned_probes(spark, model, indexed, queries.where(F.pmod(F.xxhash64("vec_id", F.lit("tune")), F.lit(16)) < 8).limit(TUNING), k, recall)

    kinds = {"list": pa.int32(), "bound": pa.float64(), "turned": pa.binary(), "vector": pa.binary(), "found": pa.int64(), "score": pa.float64()}

    def rows_of(ids: np.ndarray, uids: np.ndarray, **given) -> pa.RecordBatch:
        columns = [pa.array(given[c], t) if c in given else pa.nulls(len(ids), t) for c, t in kinds.items()]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(uids, pa.int64()), *columns], names=["vec_id", "uid", *kinds])

    def probing(batches):
        index = model.value
        everything = index.turned(index.sample, False).astype(np.float64)
        lengths = (everything**2).sum(axis=1)
        for b in batches:
            x, ids, uids = matrix(b.column("x")), b.column("vec_id").to_numpy(), b.column("uid").to_numpy()
            for turn in range(0, len(x), TURN):
                part = slice(turn, turn + TURN)
                y = index.turned(x[part], True)
                lists = index.order(y)
                many = np.maximum(probes, (np.cumsum(sizes[lists], axis=1) <= k).sum(axis=1) + 1)
                far = lengths + (y.astype(np.float64) ** 2).sum(axis=1)[:, None] - 2 * y.astype(np.float64) @ everything.T
                far[index.sample_ids == ids[part][:, None]] = np.inf
                near = np.argsort(far, axis=1, kind="stable")[:, :k]
                last = np.take_along_axis(far, near[:, -1:], axis=1)[:, 0]
                bound = np.where((near.shape[1] == k) & np.isfinite(last), last * (1 + 1e-4) + 1e-5 * index.norm**2, np.inf)
                probed = (np.arange(lists.shape[1]) < many[:, None]) & (sizes[lists] > 0)
                own, place = np.nonzero(probed)
                turned, vector = (pa.array([v.tobytes() for v in a], pa.binary()) for a in (y, x[part]))
                yield rows_of(ids[part][own], uids[part][own], list=lists[own, place], bound=bound[own], turned=turned.take(pa.array(own)), vector=vector.take(pa.array(own)))
                # of the nearest of the sample those that lie in no probed list
                outside = np.take_along_axis(np.argsort(lists, axis=1), index.sample_lists[near], axis=1) >= many[:, None]
                own, place = np.nonzero(outside & (np.take_along_axis(far, near, axis=1) < np.inf))
                which = near[own, place]
                yield rows_of(ids[part][own], uids[part][own], found=index.sample_ids[which], score=products(index.sample[which], x[part][own]))

    shape = "vec_id long, uid long, list int, bound double, turned binary, vector binary, found long, score double"
    asked = staged(queries.withColumn("uid", F.xxhash64("vec_id", "x")).mapInArrow(probing, shape))
    added = asked.where("list is null").select(F.col("vec_id").alias("query_id"), "uid", F.col("found").alias("vec_id"), "score")
    asked = asked.where("list is not null").drop("found", "score")
    parts = spark.createDataFrame([(i, int(-(-n // LIST_CHUNK))) for i, n in enumerate(sizes.tolist()) if n], "list int, parts int")  # at most LISTS rows
    turns = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("turns"))
    deal = F.broadcast(parts.join(turns, "list"))
    spread = lambda key, n: F.pmod(F.xxhash64(key, F.lit("deal")), F.col(n)).cast("int")
    many = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(deal, "list").select("list", spread("vec_id", "parts").alias("part"), many("turns").alias("turn"), F.lit(False).alias("query"), "vec_id", F.lit(0).cast("long").alias("uid"), F.when(sampled, -1.0).otherwise(0.0).alias("bound"), "turned", "vector")
    right = asked.join(deal, "list").select("list", many("parts").alias("part"), spread("uid", "turns").alias("turn"), F.lit(True).alias("query"), "vec_id", "uid", "bound", "turned", "vector")
    met = left.unionAll(right).repartition("list", "part", "turn").sortWithinPartitions("list", "part", "turn", "query", "vec_id")
    found = met.mapInArrow(_pairs(k), "query_id long, uid long, vec_id long, score double").unionAll(added)
    rank = F.row_number().over(Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _tuned_probes(spark, model, indexed: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """The number of lists that hold the target share of the true neighbours of a few queries, by brute force over all rows."""
    asked = queries.collect()  # at most TUNING queries
    if not asked:
        return len(model.value.centroids)
    q, ids = np.array([r["x"] for r in asked]), np.array([r["vec_id"] for r in asked])

    def scanned(batches):
        tops: list[list] = [[] for _ in q]
        for b in batches:
            x, own = np.frombuffer(b"".join(b.column("vector").to_pylist())).reshape(b.num_rows, -1), b.column("vec_id").to_numpy()
            lists = b.column("list").to_numpy()
            score = x @ q.T
            for n in range(len(q)):
                s = np.where(own == ids[n], -np.inf, score[:, n])
                for p in np.argpartition(-s, min(k, len(s) - 1))[:k] if len(s) > k else range(len(s)):
                    if own[p] != ids[n]:
                        tops[n].append((float(s[p]), int(lists[p])))
                tops[n] = sorted(tops[n], reverse=True)[:k]
        rows = [(n, *x) for n, top in enumerate(tops) for x in top]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int32())], names=["query", "score", "list"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "list"))
    true = indexed.select("vec_id", "list", "vector").mapInArrow(scanned, "query int, score double, list int").withColumn("rank", rank).where(F.col("rank") <= k).collect()  # k rows for each query
    order = model.value.order(model.value.turned(q, True))
    place = np.argsort(order, axis=1)
    ranks = np.sort([place[r["query"], r["list"]] for r in true])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else len(order[0])
