"""Work that grows with the input: dealt to tasks by number, without tables sent to all of them, and with no products of rows."""

import itertools
import random

import pytest
from karst.operators import detect, gated, graph, idioms, mazes
from karst.operators.world import World
from karst.plans import fixpoint
from karst.plans.fixpoint import many_tasks, walks
from karst.sources import star

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_walks_are_dealt_to_many_tasks(spark):
    """Few seeds of one ban are few bytes, which Spark puts into one task if it is left to it."""
    arcs = spark.createDataFrame([(k, k + 1, None) for k in range(100)], "src long, dst long, alt string")
    found = walks(spark.createDataFrame([(k, k, None) for k in range(100)], "walk long, node long, ban string"), arcs)
    assert found.rdd.getNumPartitions() == many_tasks(spark)
    assert found.count() == sum(101 - k for k in range(100))


def test_what_walks_find_is_not_sent_to_all_tasks(spark):
    arcs = spark.createDataFrame([(1, 2, None)], "src long, dst long, alt string")
    found = walks(spark.createDataFrame([(1, 1, None)], "walk long, node long, ban string"), arcs)
    names = spark.createDataFrame([(1, "a"), (2, "b")], "node long, name string")
    assert "BroadcastExchange" not in plan(names.join(found, "node"))


@pytest.mark.parametrize("rows", ["edges", "ways", "world_ways", "sources", "moves", "offers", "part_asks"])
def test_no_table_is_sent_to_all_tasks(spark, rows):
    assert "BroadcastExchange" not in plan(getattr(star, rows)(spark, DIR))


def test_bands_are_dealt_to_many_tasks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("pq"), k, rng.randrange(40)) for k in range(60)]
    a, b = spark.createDataFrame(rows, "g string, a long, x long"), spark.createDataFrame(rows, "g string, b long, y long")
    found = idioms.band_join(a, b, "g", "x", "y", 3)
    assert found.rdd.getNumPartitions() == many_tasks(spark)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted((p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and abs(p[2] - q[2]) <= 3)


@pytest.mark.parametrize("tile", [2, 3, 64])
def test_flood_by_tiles(spark, tile):
    rng = random.Random(tile)
    width, height = 11, 17
    cells = {(x, y) for x in range(width) for y in range(height) if rng.random() < 0.62}
    seeds = {c for c in cells if c[1] == 0}
    reached, todo = set(seeds), list(seeds)
    while todo:
        x, y = todo.pop()
        new = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & cells - reached
        reached |= new
        todo += new
    df = lambda rows: spark.createDataFrame([*rows, *list(rows)[:3]], "x long, y long")
    assert sorted(tuple(r) for r in idioms.flood(df(cells), df(seeds), width, tile).collect()) == sorted(reached)
    assert idioms.flood(df(cells), df(seeds).limit(0), width, tile).count() == 0


def test_a_long_corridor_takes_no_walk_of_cells(spark, monkeypatch):
    """Up and down columns over 40 rows: more steps than there are parts to walk."""
    sent = []
    monkeypatch.setattr(idioms, "walks", lambda seeds, arcs: sent.append(arcs.count()) or walks(seeds, arcs))
    cells = [(x, y) for x in range(0, 21, 2) for y in range(40)] + [(x, 39 if x % 4 == 1 else 0) for x in range(1, 20, 2)]
    df = spark.createDataFrame(cells, "x long, y long")
    assert idioms.flood(df, df.where("x = 0 and y = 0"), 21).count() == len(cells)
    assert sent == [0]


def test_rooms_that_reach_an_item_without_the_closure(spark):
    rng = random.Random(5)
    arcs = {(rng.randrange(15), rng.randrange(15)) for _ in range(25)}
    places = [(rng.choice("ab"), rng.randrange(17)) for _ in range(6)]
    reach = {(a, a) for a in range(17)}
    while len(more := reach | {(a, d) for a, b in reach for s, d in arcs if s == b}) > len(reach):
        reach = more
    rooms = spark.createDataFrame([(k,) for k in range(16)], "room long")
    found = detect.reobtainable(spark.createDataFrame(places, "item string, room long"), spark.createDataFrame(list(arcs), "src long, dst long"), rooms)
    assert sorted(tuple(r) for r in found.collect()) == sorted({(i, a) for i, b in places for a in range(16) if (a, b) in reach})


def test_moves_from_anywhere_are_not_multiplied(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(gated, "walks", lambda seeds, arcs: sent.append(arcs.count()) or walks(seeds, arcs))
    moves = [("a", None, k) for k in range(2, 40)] + [("a", 7, 0), ("a", 1, 50), ("b", None, 0), ("c", None, 3)]
    drops = [("a", 1), ("a", 60), ("b", 5), ("c", 3)]
    found = gated.permanent_drops(spark.createDataFrame(moves, "item string, src long, dst long"), spark.createDataFrame(drops, "item string, room long"))
    assert found.count() == 0  # all of a and b come back; nothing hands c over
    stay = gated.permanent_drops(spark.createDataFrame([("a", 7, 0), ("a", 1, 50), ("a", 50, 1)], "item string, src long, dst long"), spark.createDataFrame([("a", 1), ("a", 7), ("a", 0)], "item string, room long"))
    assert [tuple(r) for r in stay.collect()] == [("a", 1)]
    assert sent[0] <= 3 * len(moves)


def test_components_without_the_closure(spark, monkeypatch):
    """Three rings in a chain, single rooms, a room that is no node, and rooms without arcs; few are walked from at once."""
    rng = random.Random(7)
    arcs = {(10 * r + k, 10 * r + (k + 1) % 10) for r in range(3) for k in range(10)} | {(5, 13), (15, 23), (40, 1), (25, 41), (99, 50), (50, 99), (51, 99), (99, 51)}
    arcs |= {(rng.randrange(60, 80), rng.randrange(60, 80)) for _ in range(30)}
    nodes = [*range(55), *range(60, 80)]
    reach = {(a, a) for a in [*nodes, 99]}
    while len(more := reach | {(a, d) for a, b in reach for s, d in arcs if s == b}) > len(reach):
        reach = more
    same = {a: [b for b in nodes if (a, b) in reach and (b, a) in reach] for a in nodes}
    rows = []
    monkeypatch.setattr(graph, "walks", lambda seeds, arcs: rows.append(seeds.count()) or walks(seeds, arcs))
    df = spark.createDataFrame([(k,) for k in nodes], "room long")
    found = graph.strong_components(df, spark.createDataFrame(list(arcs), "src long, dst long"), 2, 3)
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, min(s), len(s)) for a, s in same.items())
    assert rows[0] == 2 and sum(rows) < 2 * len(nodes)
    assert graph.strong_components(df.limit(0), spark.createDataFrame(list(arcs), "src long, dst long")).count() == 0


@pytest.mark.parametrize(("seed", "arcs", "pairs"), [(1, 90, 0), (3, 40, 0), (4, 60, 1000), (5, 0, 0), (6, 70, 0)])
def test_the_widest_room_without_the_closure(spark, seed, arcs, pairs):
    """Also rooms that are no nodes (from 50 on), two parts that do not hang together, and ties."""
    rng = random.Random(seed)
    arcs = {(rng.randrange(55), rng.randrange(55)) for _ in range(arcs)}
    if seed == 6:
        arcs = {(a // 2 + 25 * (b % 2), b // 2 + 25 * (b % 2)) for a, b in arcs}
    reach = {a: {a} for a in range(50)}
    for seen in reach.values():
        todo = list(seen)
        while todo:
            at = todo.pop()
            new = {d for s, d in arcs if s == at} - seen
            seen |= new
            todo += new
    df = spark.createDataFrame([(k,) for k in [*range(50), 3, None]], "room long")
    found = graph.widest(df, spark.createDataFrame(list(arcs), "src long, dst long"), pairs)
    assert [tuple(r) for r in found.collect()] == [max(((k, len(v)) for k, v in reach.items()), key=lambda x: (x[1], -x[0]))]
    assert graph.widest(df.limit(0), spark.createDataFrame(list(arcs), "src long, dst long"), pairs).count() == 0


def test_the_start_is_found_with_few_walks(spark, monkeypatch):
    """A ring of 600 rooms with rooms before and behind it: all of them reach the ring, and none is walked through it but some chosen ones."""
    arcs = [(k, (k + 1) % 600) for k in range(600)] + [(1000 + k, k) for k in range(200)] + [(k, 2000 + k) for k in range(200)] + [(1500, 1000)]
    seen = []

    def counted(seeds, arcs):
        found = fixpoint.written(walks(seeds, arcs))
        seen.append(found.count())
        return found

    monkeypatch.setattr(graph, "walks", counted)
    rooms = spark.createDataFrame([(k,) for k in {x for a in arcs for x in a}], "room long")
    found = graph.widest(rooms, spark.createDataFrame(arcs, "src long, dst long"), 0)
    assert [tuple(r) for r in found.collect()] == [(1500, 802)]
    assert sum(seen) < 2 * 64 * 1001 + 1000  # of 641,205 pairs and more


@pytest.mark.parametrize("most", [1 << 18, 14, 0])
def test_mazes_are_walked_one_by_one(spark, monkeypatch, most):
    rng = random.Random(11)
    steps = {(m, rng.randrange(12), rng.randrange(12)) for m in range(3) for _ in range(12 + 6 * m)}
    rooms = {(m, rng.randrange(12), rng.choice("pqrst")) for m in range(4) for _ in range(5)}
    want, at = set(), {(m, c) for m, c, _ in rooms}
    for m, c, room in rooms:
        seen, todo = set(), [c]
        while todo:
            here = todo.pop()
            new = {d for k, s, d in steps if k == m and s == here} - seen
            seen |= new
            todo += [d for d in new if (m, d) not in at]
        want |= {(m, room, to) for k, d, to in rooms if k == m and d in seen and to != room}
    called = []
    monkeypatch.setattr(mazes, "walks", lambda seeds, arcs: called.append(1) or walks(seeds, arcs))
    found = mazes.maze_reach(spark.createDataFrame(list(steps), "maze long, src long, dst long"), spark.createDataFrame(list(rooms), "maze long, cell long, room string"), most=most)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert bool(called) == (most < 18)


def guarded_world(spark, ways):
    """ways: src, dst, alts."""
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    place, write = "item string, room long", "register string, room long, value int, cost array<string>"
    rows = df(((a, b, None, None, alts) for a, b, alts in ways), "src long, dst long, req_r int, set_r int, alts array<array<string>>")
    return World(rows, df([], write), df([], "register string, room long, frm int, to int, cost array<string>"), df([], place), df([], place), df([(1,)], "room long"), df([], "room long"), df([], place), (("r",),))


SPEC = "src long, dst long, items array<string>, groups array<array<string>>"


def test_alternatives_of_many_groups_stay_the_different_ones(spark):
    """All pairs of twelve items: 2**66 ways to choose, of which 13 differ."""
    names = [chr(97 + k) for k in range(12)]
    w = guarded_world(spark, [(1, 2, None), (1, 3, [["z"]])])
    specs = spark.createDataFrame([(1, 2, [], [list(p) for p in itertools.combinations(names, 2)])], SPEC)
    but = [[x for x in names if x != y] for y in names]
    got = {r["dst"]: r["alts"] for r in w.guarded(specs).ways.collect()}
    assert got == {2: sorted([*but, names]), 3: [["z"]]}
    assert {r["dst"]: r["alts"] for r in w.guarded_minimal(specs).ways.collect()} == {2: sorted(but), 3: [["z"]]}


def test_guards_equal_a_plain_product(spark):
    rng = random.Random(11)
    some = lambda most, least=0: rng.sample("abcdefghijk", rng.randint(least, most))
    ways = [(1, k, None if k == 2 else [some(3) for _ in range(rng.randint(0, 3))]) for k in range(2, 14)]
    wanted = [(1, k, some(2), [some(3, 1) for _ in range(rng.randint(0, 4))] if k < 12 else [["a", "b"], []]) for k in range(2, 13)]
    expected = {13: ways[-1][2]}
    for (_, k, alts), (_, _, items, groups) in zip(ways, wanted, strict=False):
        expected[k] = sorted({tuple(sorted({*a, *items, *chosen})) for a in alts or [[]] for chosen in itertools.product(*groups)})
    w, specs = guarded_world(spark, ways), spark.createDataFrame(wanted, SPEC)
    full, few = w.guarded(specs), w.guarded_minimal(specs)
    got = {r["dst"]: r["alts"] for r in full.ways.collect()}
    assert {k: [tuple(a) for a in v] for k, v in got.items() if k < 13} == {k: v for k, v in expected.items() if k < 13} and got[13] == expected[13]
    least = {r["dst"]: {tuple(a) for a in r["alts"]} for r in few.ways.collect() if r["dst"] < 13}
    assert least == {k: {a for a in v if not any(set(b) < set(a) for b in v)} for k, v in expected.items() if k < 13}
    rows = lambda df: sorted(map(str, df.collect()))
    for name in ("demands", "freely_reversible", "groups"):
        assert rows(getattr(full, name)) == rows(getattr(few, name)), name


def test_guards_are_verified_by_their_minimal_alternatives(spark, monkeypatch):
    """The world with all alternatives of a guard is never made to see what it fixes."""
    monkeypatch.setattr(World, "guarded", None)
    asked = []
    monkeypatch.setattr(World, "strandings", lambda w: asked.append(w.ways.collect()) or spark.createDataFrame([], "src long, dst long, unit string"))
    monkeypatch.setattr(World, "group_strandings", lambda w: spark.createDataFrame([], "room long, unit string"))
    pairs = [list(p) for p in itertools.combinations("abcdefgh", 2)]
    guarded_world(spark, [(1, 2, None)]).verified(spark.createDataFrame([(1, 2, [], pairs)], SPEC))
    assert [len(rows[0]["alts"] or []) for rows in asked] == [0, 8]
    assert asked[1][0]["mentions"] == list("abcdefgh")


def test_arcs_with_many_bars_are_not_sent(spark, monkeypatch):
    """Few arcs may carry many bars: what goes through the driver is bounded by both."""
    rng = random.Random(7)
    arcs = [(rng.randrange(12), rng.randrange(12), rng.sample("abcdef", rng.randint(0, 4))) for _ in range(40)]
    arcs, seeds = spark.createDataFrame(arcs, "src long, dst long, bars array<string>"), spark.createDataFrame([(k, k % 12, "abcdef-"[k % 7]) for k in range(30)], "walk long, node long, ban string")
    sent = sorted(tuple(r) for r in walks(seeds, arcs).collect())
    monkeypatch.setattr(fixpoint, "BARS_SENT", 5)
    monkeypatch.setattr(fixpoint, "_sent", None)
    assert sorted(tuple(r) for r in walks(seeds, arcs).collect()) == sent
