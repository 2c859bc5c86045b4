"""Clusters by metric trees against plain loops in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from karst.llm import ball_tree
from karst.llm.ball_tree import assign, ball_tree_clusters, squared, tree


def brute(rows, k, rounds, dims, scale, seed):
    kept = []
    for vec_id, v in rows:
        if vec_id is None or v is None or len(v) != dims or any(x is None or not math.isfinite(x) or abs(x) > ball_tree.LARGEST / scale for x in v):
            continue
        kept.append((vec_id, [math.floor(scale * x) for x in v]))
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = [nearest(v) for _, v in kept]
    each = [sum(d for d, o in own if o == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, j, d, each[j], sum(each), sha[j]) for (i, _), (d, j) in zip(kept, own, strict=True))


def vectors(rng, n, dims, groups):
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(groups)]
    out = [(i, [rng.gauss(m, 0.05) for m in rng.choice(middles)]) for i in range(n)]
    out += [(n + i, list(out[3][1])) for i in range(40)]  # copies: ties
    out += [(7, list(out[7][1])), (7, list(out[8][1]))]  # repeated rows and ids
    return out


ODD = [(900, None), (901, []), (902, [1.0, 2.0, 3.0, 4.0, 5.0]), (903, [None, 0.0, 0.0, 0.0]), (904, [float("nan"), 0.0, 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1, 0.1, 0.1, 0.1]), (906, [1e30, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("groups,scale,block", [(5, 1024, 8192), (60, 8, 50), (3, 3, 30)])
def test_clusters_equal_brute_force(spark, monkeypatch, groups, scale, block):
    monkeypatch.setattr(ball_tree, "BLOCK", block)
    rows = vectors(random.Random(groups), 260, 4, groups) + ODD
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, ids string").repartition(5)
    got = ball_tree_clusters(df, 6, 7, 4, scale, 3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 6, 7, 4, scale, 3)


def test_large_components_and_few_vectors(spark):
    rows = [(1, [130000.0, -131072.0]), (2, [-131072.0, 131072.0]), (3, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ball_tree_clusters(df, 8, 3, 2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 8, 3, 2, 1024, 3)
    none = ball_tree_clusters(df.limit(0))
    assert none.collect() == [] and none.columns == got.columns and none.dtypes == got.dtypes


def test_balls_hold_their_vectors_and_whole_balls_are_assigned():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-9, 9, (700, 8)) + m for m in (0, 200, 400)])
    order, t = tree(v)
    x = v[order]
    assert sorted(order) == list(range(len(v)))
    for a, z, m, r, s in zip(t["first"], t["end"], t["centre"], t["radius"], t["sum"], strict=True):
        assert np.sqrt(((x[a:z] - m) ** 2).sum(axis=1)).max() <= r + 1e-9 and (x[a:z].sum(axis=0) == s).all()
    centroids = np.array([[0] * 8, [201] * 8, [399] * 8])
    seen = []
    plain = ball_tree.squared
    try:
        ball_tree.squared = lambda a, c: seen.append(len(a)) or plain(a, c)
        own, sums, counts = assign(x, t, centroids)
    finally:
        ball_tree.squared = plain
    assert sum(seen) <= len(v) // 20  # of far groups only a leaf across a border is looked into
    want = squared(x, centroids).argmin(axis=1)
    assert (own == want).all() and (counts == np.bincount(want)).all() and all((sums[j] == x[want == j].sum(axis=0)).all() for j in range(3))
