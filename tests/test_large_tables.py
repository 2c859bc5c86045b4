"""What must not go through the driver or be multiplied out, however small its files are."""

import random

import pyarrow as pa
import pytest

from karst.operators import extract, graph, guard_trees
from karst.sources import ir, programs


def test_fold_demands_send_no_guards_to_all_tasks(spark):
    nodes = [(g, 0, None, "AND", None, None, None, None) for g in range(3)] + [(g, 1, 0, "NOT", None, None, None, None) for g in range(3)]
    nodes += [(0, 2, 1, "ATOM", "LOC", "i1", "ownedBy", 4), (1, 2, 1, "ATOM", "LOC", "i1", "ownedBy", 5), (2, 2, 1, "OR", None, None, None, None)]
    nodes += [(2, 3, 2, "ATOM", "LOC", "i1", "ownedBy", 4), (2, 4, 2, "ATOM", "LOC", "i2", "ownedBy", 1)]
    levelled = guard_trees.levels(spark.createDataFrame(nodes, "guard long, node long, parent long, op string, kind string, var string, cmp string, value int"))
    found = guard_trees.fold_demands(levelled, spark.createDataFrame([("i1", 4), ("i2", 1)], "var string, value int"))
    assert {(r["guard"], r["var"], r["value"]) for r in found.collect()} == {(0, "i1", 4), (2, "i1", 4), (2, "i2", 1)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 1  # the places, at most


def test_equal_tests_of_many_bodies_are_one_guard(spark, tmp_path):
    """Thirty bodies take an item, with and without it at hand, and under the same test: two guards, and nodes that moved once."""
    ego, has = programs.variable(0), programs.send(programs.variable(0), "has", programs.number(3))
    take = programs.send(ego, "get", programs.number(5))
    rows = []
    for k in range(30):
        for node in ir.flattened(programs.node("List", take, programs.node("If", has, take))):
            off, up, ord_, depth, last, t, name, vtype, idx, value = node
            rows.append(("f", 1, f"o{k}", "doit", off, None if off == 0 else up, ord_, depth, last, t, name, vtype, idx, value))
    nodes = spark.createDataFrame(rows, "file string, script int, owner string, body string, node int, parent int, ord int, depth int, post int, t string, name string, vtype string, idx int, value int")
    program = extract.extract(nodes, extract.room_scopes(nodes, spark.createDataFrame([(1, 1)], "script int, room int")))
    assert program.takes.count() == 60
    assert program.facts.select("guard").distinct().count() == 2
    assert program.alts.count() == 2
    assert {tuple(r) for r in program.needs.collect()} == {("i3", 1)}


@pytest.mark.parametrize("seed", range(3))
def test_pockets_are_what_each_cut_leaves_out(spark, seed):
    rng = random.Random(seed)
    arcs = {(rng.randrange(30) * 7 + 3, rng.randrange(30) * 7 + 3) for _ in range(45)}
    starts = [3, 10][: 1 + seed % 2]

    def reached(over):
        seen = list(starts)
        for x in seen:
            seen.extend(b for a, b in sorted(over) if a == x and b not in seen)
        return set(seen)

    found = graph.pockets(spark.createDataFrame([(s,) for s in starts], "room long"), spark.createDataFrame(sorted(arcs), "src long, dst long"))
    full = reached(arcs)
    assert {tuple(r) for r in found.collect()} == {(a, b, r) for a, b in arcs if a in full for r in full - reached(arcs - {(a, b)})}
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_markets_of_a_task_are_gone_through_in_one_stream(spark):
    from karst.operators import markets
    from karst.plans.fixpoint import whole_groups

    rows = [(m, c, [c, c + 1]) for m in range(40) for c in range(1 + m % 3)]
    consumers = spark.createDataFrame(rows, "market long, consumer int, tokens array<int>")
    spends = spark.createDataFrame([(m, 9, 0, []) for m in range(45)], "market long, spend int, token int, satisfies array<int>")
    assert {(r["market"], r["consumers"], r["tokens"], r["saturated"]) for r in graph.saturating(consumers).collect()} == {(m, 1 + m % 3, 2 + m % 3, True) for m in range(40)}
    assert markets.squeezes(consumers, spends).count() == 0
    for found in (graph.saturating(consumers), markets.squeezes(consumers, spends)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1], [0, 1]), ([], []), ([1, 2], [2, 3]), ([2], [4]))]
    assert [(k, g["v"]) for k, g in whole_groups(batches, "k")] == [(1, [0, 1, 2]), (2, [3, 4])]


def test_rounds_of_costs_leave_one_table(spark):
    """What a round wrote goes when the next has been written."""
    from karst.operators import costs
    from karst.plans import fixpoint

    before = len(fixpoint._WRITTEN)
    writes = spark.createDataFrame([(k, f"o{k}", 1, ["a"] if k == 9 else []) for k in range(10)], "write int, register string, value int, items array<string>")
    deps = spark.createDataFrame([(k, f"o{k + 1}", [1]) for k in range(9)], "write int, register string, values array<int>")
    assert {tuple(r) for r in costs.chained(writes, deps).collect()} == {(k, "a") for k in range(10)}
    assert len(fixpoint._WRITTEN) - before <= 4


def test_sinks_walk_from_rooms_where_something_is_lost(spark):
    from karst.operators import gated

    asked = []

    def pairs(rooms):
        asked.extend(r["room"] for r in rooms.collect())
        return spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "a long, b long")

    frame = lambda data: spark.createDataFrame(data, "item string, room long")
    found = gated.dangerous_sinks(frame([("x", 1), ("y", 1), ("x", 2)]), frame([("x", 1), ("x", 2), ("x", 3), ("z", 3)]), frame([("x", 2)]), pairs)
    assert {tuple(r) for r in found.collect()} == {("x", 1, 2)} and set(asked) == {1}
