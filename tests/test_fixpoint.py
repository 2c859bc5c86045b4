"""Walks by broadcast arcs and by joined rounds give the same rows, also on nulls, loops and empty relations."""

import random

import pytest
from pyspark.sql import functions as F

from karst.plans.fixpoint import walks


def brute(seeds, arcs):
    out = set()
    for walk, node, ban in seeds:
        if walk is None or node is None:
            continue
        seen, todo = {node}, [node]
        while todo:
            at = todo.pop()
            for s, d, alt in arcs:
                if s == at and d is not None and d not in seen and (ban is None or alt != ban):
                    seen.add(d)
                    todo.append(d)
        out |= {(walk, n) for n in seen}
    return out


@pytest.mark.parametrize("sent", [1000, 0])
def test_same_as_brute_force(spark, sent):
    rng = random.Random(1)
    arcs = [(rng.randrange(12), rng.randrange(12), rng.choice([None, "x", "y"])) for _ in range(30)] + [(None, 1, None), (3, None, "x"), (4, 4, None)]
    seeds = [(k, rng.randrange(14), rng.choice([None, "x", "z"])) for k in range(6)] + [(9, None, None), (None, 2, None)]
    arcs_df = spark.createDataFrame(arcs, "src long, dst long, alt string").withColumn("walk", F.lit(1))
    found = walks(spark.createDataFrame(seeds, "walk long, node long, ban string"), arcs_df, arcs_sent=sent)
    assert {tuple(r) for r in found.collect()} == brute(seeds, arcs)


@pytest.mark.parametrize("sent", [1000, 0])
def test_empty(spark, sent):
    none = spark.createDataFrame([], "src long, dst long, alt string")
    seeds = spark.createDataFrame([(1, 5, None)], "walk long, node long, ban string")
    assert [tuple(r) for r in walks(seeds, none, arcs_sent=sent).collect()] == [(1, 5)]
    assert walks(seeds.limit(0), none, arcs_sent=sent).count() == 0
