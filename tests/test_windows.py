"""Windows that shut, starts of several rooms, strandings that are no findings, and mazes, on small written worlds."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from karst import operators
from karst.operators import mazes, windows
from karst.operators.latches import flip_seals
from karst.operators.world import World
from karst.plans.fixpoint import walks, written

WAY = "src long, dst long, req_a int, set_a int, alts array<array<string>>"
FREE = [[]]


def world(spark, ways, sources=(), needs=(), starts=(1,), goals=(), drops=(), slots=(), sites=None, writes=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    pairs = "item string, room long"
    return World(
        frame(ways, WAY), frame(writes, "register string, room long, value int, cost array<string>"), frame([], "register string, room long, frm int, to int, cost array<string>"), frame(sources, pairs), frame(needs, pairs),
        frame([(s,) for s in starts], "room long"), frame([(g,) for g in goals], "room long"), frame([], pairs), (("a",),), frame(drops, pairs), frame(slots, "room long, items array<string>"),
        None if sites is None else frame(sites, "item string, room long, site string, register string, values array<int>"),
    )


def test_walks_set_out_from_every_start(spark):
    w = world(spark, [(1, 3, None, None, FREE), (2, 4, None, None, FREE)], starts=(1, 2))
    units = spark.createDataFrame([("x", ["x"])], "unit string, items array<string>")
    assert {r["room"] for r in w.reach_without(units).collect()} == {1, 2, 3, 4}
    avoided = {tuple(r) for r in w.reach_avoiding(spark.createDataFrame([(1,), (4,)], "avoided long")).collect()}
    assert avoided == {(1, 1), (1, 2), (1, 3), (1, 4), (4, 1), (4, 2), (4, 3)}  # to set out is not to enter
    traps = spark.createDataFrame([("a", 0)], "register string, safe int")
    edges, asks = spark.createDataFrame([(1, 3), (2, 4)], "src long, dst long"), spark.createDataFrame([(1, 3, "a", 0), (9, 8, "a", 0)], "src long, dst long, register string, value int")
    items = lambda rows: spark.createDataFrame(rows, "item string, room long")
    sealed = flip_seals(spark.createDataFrame([(1,), (2,)], "room long"), edges, traps, asks, items([("p", 3), ("q", 4), ("r", 3), ("r", 2)]), items([("p", 1), ("q", 1), ("r", 1)]))
    assert {r["item"] for r in sealed.collect()} == {"p"}


def test_strandings_leave_out_what_is_forced_unholdable_or_retired(spark):
    # 1 <-> 2 <-> 3, then one way 3 -> 4 -> 5; lamp and rope lie in 1, the dress in 2; the door 3 -> 4 asks for the dress
    ways = [(1, 2, None, None, FREE), (2, 1, None, None, FREE), (2, 3, None, None, FREE), (3, 2, None, None, FREE), (3, 4, None, None, [["dress"]]), (4, 5, None, None, FREE)]
    sources = [("lamp", 1), ("rope", 1), ("dress", 2), ("coin", 6)]
    needs = [("lamp", 5), ("rope", 5), ("dress", 5)]
    rows = lambda df: {tuple(r) for r in df.collect()}
    beside = world(spark, [*ways, (3, 5, None, None, FREE)], sources, needs, slots=[(2, ["dress", "rope"])])  # so the dress is needed where one can come without it
    assert rows(beside.strandings()) == {(3, 4, "lamp"), (3, 5, "lamp"), (3, 5, "rope"), (3, 5, "dress")}
    assert rows(beside.dropped()) == {(3, 4, "dress", "forced"), (3, 4, "rope", "unholdable: trade")}
    # the only way to the lamp leads through 6, where the dress burns
    burnt = world(spark, [*ways, (2, 6, None, None, FREE), (6, 7, None, None, FREE), (7, 2, None, None, FREE)], [("lamp", 7), ("rope", 1), ("dress", 2)], needs, drops=[("dress", 6), ("dress", 4)])
    assert rows(burnt.strandings()) == {(3, 4, "rope")} and rows(burnt.dropped()) == {(3, 4, "lamp", "unholdable: cost")}


def test_a_crossing_ends_needs_that_it_leaves_no_place_for(spark):
    # all crossings lead on to 8, walked to only while the register is 0, as 3 -> 4 sets it; 2 -> 4 and one way of 3 -> 6 commit to nothing
    ways = [(1, 2, None, None, FREE), (2, 1, None, None, FREE), (2, 3, None, None, FREE), (3, 2, None, None, FREE)]
    ways += [(3, 4, None, 1, FREE), (4, 5, None, None, FREE), (4, 8, 0, None, FREE), (3, 6, None, 1, FREE), (3, 6, None, None, FREE), (6, 8, 0, None, FREE), (2, 4, None, None, FREE)]
    sources, needs = [("lamp", 1), ("rope", 1), ("coin", 1)], [("lamp", 5), ("rope", 8), ("coin", 5)]
    sites = [("coin", 5, "s", "a", [0]), ("lamp", 5, "s", "a", [0]), ("lamp", 5, "t", None, None)]  # the coin is of use at 0 alone, the lamp always
    w = world(spark, ways, sources, needs, sites=sites)
    assert {tuple(r) for r in w.strandings().collect()} == {(3, 4, "lamp"), (3, 6, "rope"), (2, 4, "lamp"), (2, 4, "rope"), (2, 4, "coin")}
    assert {tuple(r) for r in w.dropped().collect()} == {(3, 4, "rope", "retired"), (3, 4, "coin", "retired")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_what_comes_after_a_crossing_in_sets(spark, seed):
    """Two registers walked on their own; a ring, what leads into it and out of it, and rooms that are never reached."""
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, None, None, 0, 1])
    ways = [(k, (k + 1) % 20, None, None, None, None, FREE) for k in range(20)] + [(rng.randrange(45), rng.randrange(45), pick(), pick(), pick(), pick(), FREE) for _ in range(70)]
    w = world(spark, [], starts=(40, 3) if seed < 3 else (50,))
    both = spark.createDataFrame(ways, "src long, dst long, req_a int, set_a int, req_b int, set_b int, alts array<array<string>>")
    w = replace(w, ways=both, projections=(("a",), ("b",)))
    crossed = spark.createDataFrame([(k,) for k in [*range(48), 5]], "after long")
    holds, sets = w.rooms_after_sets(crossed)
    got = holds.join(sets, "set").select("after", "room").distinct().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, w.rooms_after(crossed).distinct().collect()))


def test_strandings_without_all_pairs(spark, monkeypatch):
    """A ring of 80 rooms that a register goes round with, and from each a way out for good: none is followed round the ring for itself."""
    found = []

    def counted(seeds, arcs):
        rows = written(walks(seeds, arcs))
        found.append(rows.count())
        return rows

    ways = [(k, (k + 1) % 80, None, k % 2, FREE) for k in range(80)] + [(k, 100 + k, 0, 1, FREE) for k in range(80)]
    needs = [("lamp", 100 + k) for k in range(0, 80, 2)] + [("rope", 100 + k) for k in range(80)]
    w = world(spark, ways, [("lamp", 5), ("rope", 5)], needs, starts=(1,))
    monkeypatch.setattr(operators.world, "walks", counted)
    monkeypatch.setattr(operators.graph, "walks", counted)
    lost = {(k, 100 + k, i) for k in range(80) for i in ("lamp", "rope") if k % 2 == 1 and i == "rope"}
    assert {tuple(r) for r in w.strandings().collect()} == lost
    assert sum(found) < 2 * 16 * 260 + 10 * 260 < 80 * 160  # two walks of 16 states, and few of all


def test_a_window_shuts_when_every_producer_dies(spark):
    ways = [(1, 2, None, None, FREE), (2, 1, None, None, FREE), (2, 3, None, 1, FREE), (3, 1, None, None, FREE), (1, 9, None, None, FREE)]
    w = world(spark, ways, goals=(9,))
    producers = [("cat", "s1", 2, "a", [0]), ("cat", "s2", 1, "a", [0]), ("dog", "s3", 2, "a", [0]), ("dog", "s4", 1, None, None), ("eel", "s5", 7, "a", [0]), ("fox", "s6", 2, "a", [0, 1]), ("owl", "s7", 1, "a", [0])]
    p = spark.createDataFrame(producers, "demand string, site string, room long, register string, values array<int>")
    demands = spark.createDataFrame([("cat", 1), ("cat", 7), ("dog", 1), ("eel", 1), ("fox", 1), ("owl", 9)], "demand string, room long")
    got = {(r["demand"], r["room"], r["register"], r["value"], tuple(r["flips"])) for r in windows.window_closures(w, p, demands).collect()}
    assert got == {("cat", 1, "a", 1, (3,)), ("owl", 9, "a", 1, (3,))}
    dead_end = world(spark, [(1, 2, None, 1, FREE), (1, 9, None, None, FREE)], goals=(9,))
    assert windows.window_closures(dead_end, p, demands).count() == 0  # lost before anything shuts


def test_a_value_is_stranded_behind_a_flip(spark):
    schema = "src long, dst long, req_a int, set_a int, req_b int, set_b int, alts array<array<string>>"
    frame = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    pairs = "item string, room long"
    ways = [(1, 2, None, None, None, None, FREE), (2, 1, None, None, None, None, FREE), (2, 3, None, 1, None, None, FREE), (3, 4, None, None, None, None, FREE), (4, 9, None, None, None, None, FREE), (1, 9, None, None, None, None, FREE)]
    w = World(
        frame(ways, schema), frame([("b", 1, 2, []), ("b", 4, 3, [])], "register string, room long, value int, cost array<string>"), frame([], "register string, room long, frm int, to int, cost array<string>"), frame([], pairs), frame([], pairs),
        frame([(1,)], "room long"), frame([(9,)], "room long"), frame([], pairs), (("a",), ("b",)),
    )
    # room 4 presupposes b = 2, set in room 1 alone; 3 can be set in 4 itself; 7 nowhere; room 1 is behind
    demands = frame([(4, "b", [2]), (4, "b", [3]), (4, "b", [7]), (4, "b", [0, 2]), (2, "b", [2]), (4, "a", [0])], "room long, register string, values array<int>")
    got = {tuple(r) for r in windows.value_strandings(w, demands).collect()}
    assert {r for r in got if r[0] == "a"} == {("a", 1, "b", 0, 4)}


def grid(rng, width, height, doors):
    """Cells of a grid with opposite lists of shuffled names; some doors have no way back."""
    names = rng.sample(["p", "q", "r", "s"], 4)
    lists = {n: set() for n in names}
    for c in range(width * height):
        for (ahead, back), step, inside in ((names[:2], 1, (c + 1) % width), (names[2:], width, c + width < width * height)):
            if inside and rng.random() < doors:
                lists[ahead].add(c)
                if rng.random() < 0.97:
                    lists[back].add(c + step)
    return names, lists


def test_mazes_equal_a_plain_flood(spark):
    rng, doors, rooms, want, shape = random.Random(3), [], [], set(), {}
    for m, width in ((0, 16), (1, 8), (2, 32)):
        names, lists = grid(rng, width, 10, 0.7)
        shape[m] = names, width
        doors += [(m, n, c) for n, cells in lists.items() for c in cells] + [(m, "few", 1), (m, "none", None)]
        own = {c: f"room{m}-{k % 7}" for k, c in enumerate(rng.sample(range(width * 10), 8))}
        rooms += [(m, c, r) for c, r in own.items()]
        step = dict(zip(names, (1, -1, width, -width), strict=True))
        for room in set(own.values()):
            seen = {c for c, r in own.items() if r == room}
            todo = list(seen)
            while todo:
                c = todo.pop()
                for to in (c + step[n] for n in names if c in lists[n]):
                    if to not in seen:
                        seen.add(to)
                        if to not in own:
                            todo.append(to)
            want |= {(m, room, own[c]) for c in seen if c in own and own[c] != room}
    d = spark.createDataFrame([*doors, doors[0]], "maze long, list string, cell long")
    found = mazes.axes(d)
    got = {(r["maze"], r["step"]): {r["ahead"], r["back"]} for r in found.collect()}
    assert got == {(m, s): set(n) for m, (names, width) in shape.items() for s, n in ((1, names[:2]), (width, names[2:]))}
    reach = mazes.maze_reach(mazes.passages(d, found), spark.createDataFrame(rooms, "maze long, cell long, room string"))
    assert {tuple(r) for r in reach.collect()} == want and want


@pytest.mark.parametrize("keep", [("p", "q"), ("p", "q", "r")])
def test_a_maze_without_two_axes_has_no_passages(spark, keep):
    names, lists = grid(random.Random(1), 16, 10, 0.8)
    rows = [(0, n, c) for n, cells in lists.items() for c in cells if n in keep]
    assert mazes.axes(spark.createDataFrame(rows, "maze long, list string, cell long")).count() == 0
    assert mazes.axes(spark.createDataFrame([], "maze long, list string, cell long")).select(F.col("step")).count() == 0
