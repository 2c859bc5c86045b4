"""Guard trees against folds in Python, over random trees; guard arrays against all small guards."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from karst.functions import guards as G
from karst.operators import guard_trees as T
from karst.sources import star

SHAPE = "guard long, node long, parent long, op string, kind string, var string, cmp string, value int"
FLIP = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
TEST = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b}
DOMAIN = range(3)


def grown(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([("ATOM", "OWN", f"i{rng.randrange(4)}", None, None), ("ATOM", "CMP", f"r{rng.randrange(2)}", rng.choice(list(TEST)), rng.randrange(3)), ("ATOM", "LOC", f"i{rng.randrange(2)}", "ownedBy", rng.randrange(2)), ("ATOM", "OPAQUE", None, None, None)])
    op = rng.choice(["AND", "OR", "NOT"])
    return (op, *[grown(rng, depth - 1) for _ in range(1 if op == "NOT" else rng.randrange(1, 4))])


def rows_of(key, tree):
    rows, count = [], itertools.count()

    def add(g, parent):
        at = next(count)
        rows.append((key, at, parent, g[0], *(g[1:] if g[0] == "ATOM" else (None,) * 4)))
        for x in g[1:] if g[0] != "ATOM" else ():
            add(x, at)

    add(tree, None)
    return rows


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(3)
    one, two = ("ATOM", "CMP", "r0", "==", 1), ("ATOM", "CMP", "r0", "==", 2)
    return {**{k: grown(rng, 4) for k in range(80)}, 80: ("AND", one, ("AND", two)), 81: ("AND", one, ("NOT", one)), 82: ("OR", one, two), 83: ("AND", one, ("NOT", two))}


@pytest.fixture(scope="module")
def levelled(spark, trees):
    return T.levels(spark.createDataFrame([r for k, t in trees.items() for r in rows_of(k, t)], SHAPE))


def leaves(g, pos=True, spine=True, plain=True):
    """(atom, positive, on the spine) of a tree."""
    if g[0] == "ATOM":
        yield g, pos, spine
    elif g[0] == "NOT":
        yield from leaves(g[1], not pos, spine and g[1][0] == "ATOM", False)
    else:
        for k in g[1:]:
            yield from leaves(k, pos, spine and g[0] == "AND", plain)


def fold(g, leaf, pos=True):
    """var -> values that hold whenever the guard does."""
    if g[0] == "ATOM":
        return leaf(g, pos)
    if g[0] == "NOT":
        return fold(g[1], leaf, not pos)
    kids = [fold(k, leaf, pos) for k in g[1:]]
    if pos == (g[0] == "AND"):
        out = {}
        for kid in kids:
            for v, vals in kid.items():
                out[v] = out[v] & vals if v in out else vals
        return {v: vals for v, vals in out.items() if vals}
    return {v: set().union(*(k[v] for k in kids)) for v in set.intersection(*map(set, kids))}


def sets(g, pos):
    if g[1] != "CMP":
        return {}
    cmp = g[3] if pos else FLIP[g[3]]
    if cmp == "==":
        return {g[2]: {g[4]}}
    good = {v for v in DOMAIN if TEST[cmp](v, g[4])}
    return {g[2]: good} if good and len(good) < len(DOMAIN) else {}


def pairs(found):
    return {(k, *x) for k, xs in found.items() for x in xs}


def test_what_must_be_held(trees, levelled, spark):
    own = lambda g, pos: {g[2]: {1}} if g[1] == "OWN" and pos else {}
    assert {tuple(r) for r in T.required(levelled).collect()} == {(k, v) for k, t in trees.items() for v in fold(t, own)}
    put = spark.createDataFrame([("i0", 0), ("i1", 1)], "var string, value int")
    placed = lambda g, pos: {g[2]: {1}} if g[1] == "LOC" and pos and (g[2], g[4]) in {("i0", 0), ("i1", 1)} else {}
    assert {tuple(r) for r in T.placed_required(levelled, put).collect()} == {(k, v) for k, t in trees.items() for v in fold(t, placed)}


def test_what_is_mentioned(trees, levelled):
    got = {(r["guard"], r["var"]): (r["present"], r["absent"]) for r in T.polarity(levelled).collect()}
    want = {}
    for k, t in trees.items():
        for g, pos, _ in leaves(t):
            if g[1] == "OWN":
                p, a = want.get((k, g[2]), (False, False))
                want[k, g[2]] = (p or pos, a or not pos)
    assert got == want
    for side, positive in ((0, True), (1, False)):
        assert {tuple(r) for r in T.mentioned(levelled, positive=positive).collect()} == {k for k, v in want.items() if v[side]}


def test_registers(trees, levelled, spark):
    domain = spark.createDataFrame([(f"r{r}", v) for r in range(2) for v in DOMAIN], "var string, value int")
    flat, must, equal = {}, {}, {}
    for k, t in trees.items():
        for g, pos, spine in leaves(t):
            if g[1] == "CMP":
                cmp = g[3] if pos else FLIP[g[3]]
                if spine:
                    (equal if cmp == "==" else must).setdefault(k, set()).add((g[2], g[4]) if cmp == "==" else (g[2], cmp, g[4]))
                if spine or cmp == "==":
                    flat.setdefault(k, set()).update((g[2], v) for v in sets(g, pos).get(g[2], ()))
    assert {tuple(r) for r in T.must_hold(levelled).collect()} == pairs(must)
    assert {tuple(r) for r in T.must_equal(levelled).collect()} == pairs(equal)
    assert {tuple(r) for r in T.register_sets(levelled, domain).collect()} == pairs(flat)
    assert {tuple(r) for r in T.structural_sets(levelled, domain).collect()} == {(k, r, v) for k, t in trees.items() for r, vs in fold(t, sets).items() for v in vs}
    clash = set()
    for k, t in trees.items():
        eq = {(g[2], g[4]) for g, pos, spine in leaves(t) if spine and pos and g[1] == "CMP" and g[3] == "=="}
        ban = {(g[2], g[4]) for g, pos, spine in leaves(t) if spine and not pos and g[1] == "CMP" and g[3] == "=="}
        if eq & ban or len({r for r, _ in eq}) < len(eq):
            clash.add(k)
    assert {r["guard"] for r in T.contradictory(levelled).collect()} == clash and clash


def holds(g, facts):
    """True, False or None (unknown), with unknown dropped from AND and making OR true."""
    if g[0] == "ATOM":
        return facts(g)
    if g[0] == "NOT":
        k = g[1]
        if k[0] == "NOT":
            return holds(k[1], facts)
        if k[0] in ("AND", "OR"):
            return holds(("OR" if k[0] == "AND" else "AND", *[("NOT", x) for x in k[1:]]), facts)
        x = facts(k)
        return None if x is None else not x
    kids = [holds(k, facts) for k in g[1:]]
    return False not in kids if g[0] == "AND" else any(k is not False for k in kids)


def test_unknown_atoms_may_be_either(trees, levelled):
    known = {"i0": True, "i1": False}
    facts = lambda g: known.get(g[2]) if g[1] == "OWN" else g[4] > 0 if g[1] == "CMP" else None
    value = F.when(F.col("kind") == "OWN", F.when(F.col("var") == "i0", True).when(F.col("var") == "i1", False)).when(F.col("kind") == "CMP", F.col("value") > 0)
    got = {r["guard"]: r["holds"] for r in T.satisfiable(levelled, T.atoms(levelled).select("guard", "node", value.alias("holds"))).collect()}
    assert got == {k: holds(t, facts) is not False for k, t in trees.items()}
    assert set(got.values()) == {True, False}


def test_negation_is_the_opposite(trees, levelled, spark):
    """For all facts the negated tree holds where the tree does not; negating twice gives the tree back."""
    found = T.negated(levelled)
    nodes = {}
    for r in found.collect():
        nodes.setdefault(r["guard"], []).append(r)

    def tree(rows, node):
        r = next(x for x in rows if x["node"] == node)
        if r["op"] == "ATOM":
            return ("ATOM", r["kind"], r["var"], r["cmp"], r["value"])
        return (r["op"], *[tree(rows, x["node"]) for x in sorted(rows, key=lambda x: abs(x["node"])) if x["parent"] == node])

    def plain(g, facts):
        return facts(g) if g[0] == "ATOM" else not plain(g[1], facts) if g[0] == "NOT" else (all if g[0] == "AND" else any)(plain(k, facts) for k in g[1:])

    rng = random.Random(1)
    for k, t in trees.items():
        root = next(x["node"] for x in nodes[k] if x["parent"] is None)
        flipped = tree(nodes[k], root)
        assert not any(g[0] == "NOT" and g[1][0] == "NOT" for g in walk(flipped)) or any(g[0] == "NOT" and g[1][0] == "NOT" for g in walk(t))
        for _ in range(5):
            chosen = {}
            facts = lambda g, c=chosen: c.setdefault(g, rng.random() < 0.5)
            assert plain(t, facts) != plain(flipped, facts)


def walk(g):
    yield g
    for k in g[1:] if g[0] != "ATOM" else ():
        yield from walk(k)


def test_opposites_and_exclusive_pairs(spark):
    a, b = ("ATOM", "OWN", "x", None, None), ("ATOM", "CMP", "r", "==", 1)
    both = ("AND", a, b)
    trees = {1: both, 2: ("NOT", ("AND", b, a)), 3: ("NOT", both), 4: ("AND", ("NOT", a), b), 5: ("OR", ("NOT", a), b), 6: a}
    lev = T.levels(spark.createDataFrame([r for k, t in trees.items() for r in rows_of(k, t)], SHAPE))
    every = spark.createDataFrame([(x, y) for x in trees for y in trees if x < y], "a long, b long")
    assert {tuple(r) for r in T.complementary(lev, every).collect()} == {(1, 2), (1, 3)}
    assert {tuple(r) for r in T.exclusive(lev, every).collect()} == {(1, 4), (4, 6)}
    assert {(r["guard"], r["op"]) for r in T.spine(lev).collect()} == {(1, "ATOM"), (2, "NOT"), (3, "NOT"), (4, "NOT"), (4, "ATOM"), (5, "OR"), (6, "ATOM")}


def test_nothing(spark):
    none = T.levels(spark.createDataFrame([], SHAPE))
    assert T.required(none).count() == T.texts(none).count() == T.negated(none).count() == T.satisfiable(none, none.select("guard", "node", F.lit(True).alias("holds"))).count() == 0


SMALL = [list(s) for n in range(3) for s in itertools.combinations("pq", n)]


def test_blocked_is_every_alternative(spark):
    """All guards of up to two alternatives over two items, all bans."""
    rows = [([list(a) for a in alts], ban) for n in range(3) for alts in itertools.combinations(SMALL, n) for ban in SMALL] + [(None, ["p"])]
    df = spark.createDataFrame(rows, "alts array<array<string>>, ban array<string>").withColumn("got", G.blocked(F.col("alts"), F.col("ban")))
    for r in df.collect():
        assert r["got"] == (bool(r["alts"]) and all(set(a) & set(r["ban"]) for a in r["alts"]))


def test_conjoined_holds_when_both_do(spark):
    some = [list(a) for n in (1, 2) for a in itertools.combinations(SMALL + [["s"], ["p", "s"]], n)]
    df = spark.createDataFrame([(a, b) for a in some for b in some], "a array<array<string>>, b array<array<string>>").withColumn("c", G.conjoined(F.col("a"), F.col("b")))
    held = lambda g, have: any(set(x) <= have for x in g)
    for r in df.collect():
        for n in range(4):
            for have in map(set, itertools.combinations("pqs", n)):
                assert held(r["c"], have) == (held(r["a"], have) and held(r["b"], have))
        assert not any(set(x) < set(y) for x in r["c"] for y in r["c"])


def test_three_valued_folds(spark):
    rows = [(list(v),) for n in range(4) for v in itertools.product([True, False, None], repeat=n)]
    for r in spark.createDataFrame(rows, "v array<boolean>").select("v", G.all_of(F.col("v")).alias("a"), G.any_of(F.col("v")).alias("o")).collect():
        assert (r["a"], r["o"]) == (False not in r["v"], any(x is not False for x in r["v"]))


def test_factored_guards_hold_where_their_alternatives_do(spark):
    """Random alternatives over three items, in every world; the text is read again and evaluated."""
    rng = random.Random(17)
    guards = [[(sorted(p), sorted(rng.sample(sorted({"key", "map", "oil"} - set(p)), rng.randrange(0, 2 if len(p) < 3 else 1)))) for p in (rng.sample(["key", "map", "oil"], rng.randrange(0, 4)) for _ in range(rng.randrange(1, 4)))] for _ in range(80)]
    df = spark.createDataFrame([(k, g) for k, g in enumerate(guards)], "k int, a array<struct<present:array<string>,absent:array<string>>>")
    rows = df.select("k", G.factored(F.col("a")).alias("f"), G.rendered(G.factored(F.col("a")), "<{}>").alias("t")).collect()

    def read(text, world):
        if text.startswith("<"):
            return text[1:-1] in world
        word, parts, depth, start = text[1:4].strip(), [], 0, text.index(" ") + 1
        for i in range(start, len(text) - 1):
            depth += (text[i] == "(") - (text[i] == ")")
            if depth == 0 and (text[i + 1] in " )" or i == len(text) - 2):
                parts.append(text[start : i + 1])
                start = i + 2
        values = [read(p, world) for p in parts if p]
        return not values[0] if word == "not" else all(values) if word == "and" else any(values)

    for r in rows:
        alts = guards[r["k"]]
        asked = {x for p, _ in alts for x in p}
        kept = [(set(p), set(n) - asked) for p, n in alts]  # an absence of what another alternative asks for only says which came first
        both = set.intersection(*(p for p, _ in kept)), set.intersection(*(n for _, n in kept))
        rest = [(p - both[0], n - both[1]) for p, n in kept if p - both[0] or n - both[1]]
        assert (set(r["f"]["present"]), set(r["f"]["absent"])) == both
        for bits in range(8):
            world = {x for j, x in enumerate(("key", "map", "oil")) if bits >> j & 1}
            want = both[0] <= world and not both[1] & world and (not rest or any(p <= world and not n & world for p, n in rest))
            assert (True if r["t"] is None else read(r["t"], world)) == want


def test_nodes_of_guards_move_once(spark):
    plan = star.guard_nodes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_levels_place_whole_guards_and_leave_out_what_hangs_nowhere(spark):
    deep = [(7, k, None if k == 0 else k - 1, "NOT" if k < 40 else "ATOM", "OWN", "i1", None, None) for k in range(41)]
    found = T.levels(spark.createDataFrame([*deep, (7, 90, 91, "ATOM", "OWN", "i2", None, None), (8, 0, None, "ATOM", "OWN", "i3", None, None)], SHAPE)).collect()
    assert {(r.guard, r.node, r.depth, r.positive, r.plain, r.below) for r in found} == {(7, k, k, k % 2 == 0, k == 0, int(k < 40)) for k in range(41)} | {(8, 0, 0, True, True, 0)}


def test_guards_are_computed_once(spark):
    """What stands at several places of an expression, or inside a lambda, is computed at each of them."""
    alts = F.expr("array(struct(array('i1') as present, array(concat('i', id)) as absent))")
    for made in (G.factored(alts), G.rendered(G.factored(alts), "(has {})"), G.minimal(F.expr("array(array(concat('i', id)))"))):
        plan = spark.range(1).select(made.alias("made"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("concat(i, ") == 1


def test_conjoined_guards_are_dealt_to_all_tasks(spark):
    """The products of a site take long and few bytes, so Spark would put all sites into one task."""
    found = queries()["conjoined_guards"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
