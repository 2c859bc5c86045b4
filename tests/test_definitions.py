"""Operators on small inputs whose results follow from their definitions."""

from karst.operators import gated, graph, machines, product
from karst.operators.world import World
from pyspark.sql import functions as F


def test_registers_have_any_values(spark):
    ways = spark.createDataFrame([(1, 2, 0, 2, None), (2, 3, 2, None, None), (3, 1, 7, 0, "x")], "src long, dst long, req int, setv int, alt string")
    start = spark.createDataFrame([(1,)], "room long")
    assert {(r["room"], r["value"]) for r in product.states(start, ways).collect()} == {(1, 0), (2, 2), (3, 2)}
    assert {r["room"] for r in gated.reach_without(start, [ways], spark.createDataFrame([("x",)], "item string")).collect()} == {1, 2, 3}


def test_pockets_with_several_starts(spark):
    arcs = spark.createDataFrame([(1, 3), (2, 3), (3, 4)], "src long, dst long")
    starts = spark.createDataFrame([(1,), (2,)], "room long")
    assert {tuple(r) for r in graph.pockets(starts, arcs).collect()} == {(3, 4, 4)}


def test_setstate_lands_behind_its_target(spark):
    rows = [("m", 0, 0, "ADVANCE", None, 0, 0, 0), ("m", 1, 0, "SETSTATE", 5, 0, 1, 0), ("m", 6, 0, "ADVANCE", None, 0, 0, 0), ("m", 7, 0, "EXIT", None, 0, 1, 0)]
    steps = spark.createDataFrame(rows, "machine string, state long, path long, trans string, target long, cues long, effects long, guards long")
    none = spark.createDataFrame([], "machine string, state long")
    got = {r["state"]: (r["trans"], r["target"]) for r in machines.compressed(steps, none).collect()}
    assert got == {0: ("ADVANCE", None), 1: ("JUMP", 7), 6: ("ADVANCE", None), 7: ("EXIT", None)}
    assert {(r["state"], r["next"]) for r in machines.arcs(steps).collect()} == {(0, 1), (1, 6), (6, 7)}


def world(spark, ways, sources, needs, goals=()):
    shape = "src long, dst long, req_r int, set_r int, alts array<array<string>>"
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    place = "item string, room long"
    write = "register string, room long, value int, cost array<string>"
    return World(df(ways, shape), df([], write), df([], "register string, room long, frm int, to int, cost array<string>"), df(sources, place), df(needs, place), df([(1,)], "room long"), df([(g,) for g in goals], "room long"), df([], place), (("r",),))


def test_guards_multiply_alternatives(spark):
    w = world(spark, [(1, 2, None, None, [["A"]]), (1, 2, 0, None, [[]])], [], [])
    specs = spark.createDataFrame([(1, 2, ["B", "C"], [["D", "E"]])], "src long, dst long, items array<string>, groups array<array<string>>")
    got = sorted(r["alts"] for r in w.guarded(specs).ways.collect())
    assert got == [[["A", "B", "C", "D"], ["A", "B", "C", "E"]], [["B", "C", "D"], ["B", "C", "E"]]]


def test_a_stranding_is_found_guarded_and_fixed(spark):
    """The rope is in room 1, is asked for in room 3, and there is no way back from room 2."""
    w = world(spark, [(1, 2, None, None, None), (2, 3, None, None, None), (3, 4, None, None, [["rope"]])], [("rope", 1)], [("rope", 3)])
    assert {tuple(r) for r in w.strandings().collect()} == {(1, 2, "rope")}
    specs = w.specs()
    assert [(r["src"], r["dst"], r["items"], r["groups"]) for r in specs.collect()] == [(1, 2, ["rope"], [])]
    assert {tuple(r) for r in w.verified(specs).collect()} == {("item", "rope", "fixed")}
    assert w.unsatisfiable(specs).count() == 0
    back = world(spark, [(1, 2, None, None, None), (2, 1, None, None, [[]]), (2, 3, None, None, None)], [("rope", 1)], [("rope", 2)])
    assert {tuple(r) for r in back.strandings().collect()} == set()


def test_registers_close_the_way_back(spark):
    """Crossing 1 -> 2 sets the register; the way back asks for its old value, and so the rope is lost though the graph goes round."""
    w = world(spark, [(1, 2, None, 1, None), (2, 1, 0, None, [["rope"]]), (2, 3, None, None, None)], [("rope", 1)], [("rope", 2)])
    assert {tuple(r) for r in w.strandings().collect()} == {(1, 2, "rope")}
    assert {(r["after"], r["room"]) for r in w.rooms_after(w.edges.select(F.col("dst").alias("after"))).collect()} >= {(2, 2), (2, 3), (3, 3)}
