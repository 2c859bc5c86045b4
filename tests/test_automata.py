"""Compiled machines and what holds on every path, against plain walks over random machines; costs along chains against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from karst.operators import automata as A
from karst.operators import costs

OPS = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">=": lambda x, y: x >= y}


def random_machines(rng, many, forward=False, adds=True):
    """forward: no way back, so that counters which grow end; adds: counters may grow."""
    steps, entries, domains = [], [], []
    for m in range(many):
        states = [s for s in range(6) if rng.random() < 0.85] or [0]
        for s in states:
            for p in range(rng.randrange(1, 3)):
                trans = rng.choice(["ADVANCE", "ADVANCE", "JUMP", "SETSTATE", "EXIT", "DEATH", "PARK"])
                target = rng.randrange(s + 1, 8) if forward else rng.randrange(6)  # also the room of an exit
                tests = [(f"c{rng.randrange(2)}", rng.choice(list(OPS)), rng.randrange(3))] if rng.random() < 0.4 else []
                atoms = [(f"r{rng.randrange(2)}", rng.choice(["==", "!="]), rng.randrange(2))] if rng.random() < 0.4 else []
                items = [f"i{rng.randrange(3)}"] if rng.random() < 0.3 else []
                writes = [(f"r{rng.randrange(2)}", rng.randrange(3)) for _ in range(rng.randrange(3))] if rng.random() < 0.4 else []
                gains = [(f"g{rng.randrange(2)}", rng.choice([1, -1]))] if rng.random() < 0.2 else []
                sets = [(f"c{rng.randrange(2)}", rng.choice(["set", "add" if adds else "set"]), rng.randrange(1, 3))] if rng.random() < 0.5 else []
                steps.append((f"m{m}", s, p, trans, target, tests, atoms, items, writes, gains, sets))
        domains += [(f"m{m}", "g0", v) for v in (0, 1)]
        entries += [(f"m{m}", e, rng.choice(states), [("r0", "==", 1)] if e == 1 else [], ["i9"] if e == 1 else [], [("c0", 1)] if e else []) for e in range(2)]
    return steps, entries, domains


def contradicts(atoms):
    return any(c == "==" and any(r2 == r and (c2 == "==" and v2 != v or c2 == "!=" and v2 == v) for r2, c2, v2 in atoms) for r, c, v in atoms)


def spelled(step, domains):
    out = [step]
    for register, delta in step[9]:
        known = sorted(v for m, r, v in domains if m == step[0] and r == register)
        if known:
            out = [(*s[:6], [*s[6], (register, "==", v)], s[7], [*s[8], (register, v + delta)], *s[9:]) for s in out for v in known]
    return [s for s in out if not contradicts(s[6])]


def holds(tests, counters):
    return all(c not in counters or OPS[op](counters[c], v) for c, op, v in tests)


def applied(counters, sets):
    out = dict(counters)
    for c, op, v in sets:
        if op == "set":
            out[c] = v
        elif c in out:
            out[c] += v
    return out


def landing(s):
    return {"ADVANCE": s[1] + 1, "JUMP": s[4], "SETSTATE": (s[4] or 0) + 1}.get(s[3])


def plain(steps, entries, domains):
    paths = {}
    for s in steps:
        for x in spelled(s, domains):
            paths.setdefault((s[0], s[1]), []).append(x)
    exits, deaths = set(), set()

    def walk(machine, entry, state, counters, atoms, items, writes, seen):
        there = sorted(s for m, s in paths if m == machine and s >= state)
        if not there:
            return
        state = there[0]
        for s in paths[machine, state]:
            if not holds(s[5], counters):
                continue
            a, i, w = atoms | set(s[6]), items | set(s[7]), writes + s[8]
            if contradicts(a):
                continue
            if s[3] == "EXIT":
                exits.add((machine, entry, s[4], frozenset(a), frozenset(i), frozenset(dict(w).items())))
            elif s[3] == "DEATH":
                deaths.add((machine, entry, frozenset(a), frozenset(i)))
            key, to, n = (state, tuple(sorted(counters.items()))), landing(s), applied(counters, s[10])
            key = (state, tuple(sorted(n.items())))
            if to is not None and key not in seen:
                walk(machine, entry, to, n, a, i, w, seen | {key})

    for m, e, state, atoms, items, counters in entries:
        walk(m, e, state, dict(counters), set(atoms), set(items), [], frozenset())
    return exits, deaths


@pytest.mark.parametrize("seed,forward", [(0, True), (1, False)])
def test_compiled_machines_equal_a_plain_walk(spark, seed, forward):
    steps, entries, domains = random_machines(random.Random(seed), 12, forward, adds=forward)
    got = A.compiled(spark.createDataFrame(steps, A.STEP), spark.createDataFrame(entries, A.ENTRY), spark.createDataFrame(domains, "machine string, register string, value int"), most_paths=10**9)
    exits, deaths = plain(steps, entries, domains)
    sets = lambda x: frozenset(tuple(y) for y in x)
    assert {(r["machine"], r["entry"], r["room"], sets(r["atoms"]), frozenset(r["items"]), sets(r["writes"])) for r in got["exits"].collect()} == exits
    assert {(r["machine"], r["entry"], sets(r["atoms"]), frozenset(r["items"])) for r in got["deaths"].collect()} == deaths
    assert got["truncated"].count() == 0 and exits and deaths


def test_truncation_is_reported_for_its_machine_alone(spark):
    loop = [("m", 0, p, "JUMP", 0, None, None, [f"i{p}"], None, None, [("c", "set", p)]) for p in range(6)] + [("m", 0, 9, "EXIT", 5, None, None, None, None, None, None), ("n", 0, 0, "EXIT", 7, None, None, None, None, None, None)]
    entries = [("m", 0, 0, None, None, None), ("n", 0, 0, None, None, None)]
    got = A.compiled(spark.createDataFrame(loop, A.STEP), spark.createDataFrame(entries, A.ENTRY), most_paths=30)
    assert {tuple(r) for r in got["truncated"].collect()} == {("m", "paths")}
    assert {(r["machine"], r["room"]) for r in got["exits"].collect()} == {("m", 5), ("n", 7)}
    deep = [("m", s, 0, "ADVANCE", None, None, None, None, None, None, None) for s in range(9)] + [("m", 9, 0, "EXIT", 1, None, None, None, None, None, None)]
    far = A.compiled(spark.createDataFrame(deep, A.STEP), spark.createDataFrame(entries[:1], A.ENTRY), deepest=4)
    assert far["exits"].count() == 0 and {tuple(r) for r in far["truncated"].collect()} == {("m", "depth")}


def test_no_machines(spark):
    none, ways = spark.createDataFrame([], A.STEP), spark.createDataFrame([], A.ENTRY)
    got = A.compiled(none, ways)
    assert [got[k].count() for k in ("exits", "deaths", "truncated")] == [0, 0, 0]
    assert A.state_musts(none, ways, spark.createDataFrame([], "machine string, state int, path int, register string, values array<int>")).count() == 0


def saturated(counters, limits):
    return tuple(sorted((c, max(-limits[c], min(limits[c], v))) for c, v in counters.items() if c in limits))


def plain_musts(steps, entries, allowed):
    """By paths: every walk without a repeated pair of arcs is more than enough for a meet of sets that only intersect and forget."""
    out = {}
    for machine in {s[0] for s in steps}:
        own = [s for s in steps if s[0] == machine]
        limits = {}
        for s in own:
            for c, _, v in s[5]:
                limits[c] = max(limits.get(c, 0), abs(v) + 1)
        work = [(st, saturated(dict(cs), limits), ()) for m, _, st, _, _, cs in entries if m == machine]
        seen = set(work)
        while work:
            state, counters, facts = work.pop()
            node = (machine, state, counters)
            known = dict(facts)
            out.setdefault(node, []).append(known)
            for s in own:
                if s[1] != state or landing(s) is None or not holds(s[5], dict(counters)):
                    continue
                nxt = dict(known)
                for register, values in allowed.get((machine, state, s[2]), {}).items():
                    nxt[register] = nxt[register] & values if register in nxt else values
                for register, _ in s[8]:
                    nxt.pop(register, None)
                to = (landing(s), saturated(applied(dict(counters), s[10]), limits), tuple(sorted(nxt.items(), key=str)))
                if to not in seen:
                    seen.add(to)
                    work.append(to)
    return {(*node, register): frozenset().union(*(k[register] for k in paths)) for node, paths in out.items() for register in set.intersection(*(set(k) for k in paths))}


@pytest.mark.parametrize("seed", range(2))
def test_musts_equal_the_meet_over_all_paths(spark, seed):
    rng = random.Random(40 + seed)
    steps, entries, _ = random_machines(rng, 10)
    allowed = {(s[0], s[1], s[2]): {r: frozenset(rng.sample(range(4), rng.randrange(1, 4))) for r in rng.sample(["r0", "r1", "r2"], rng.randrange(1, 3))} for s in steps if rng.random() < 0.7}
    rules = [(m, s, p, r, sorted(v)) for (m, s, p), of in allowed.items() for r, v in of.items()]
    got = A.state_musts(spark.createDataFrame(steps, A.STEP), spark.createDataFrame(entries, A.ENTRY), spark.createDataFrame(rules, "machine string, state int, path int, register string, values array<int>"))
    found = {(r["machine"], r["state"], tuple((c["counter"], c["value"]) for c in r["counters"]), r["register"]): frozenset(r["values"]) for r in got.collect()}
    assert found == plain_musts(steps, entries, allowed) and found


def test_a_counter_that_only_grows_does_not_keep_the_walk_going(spark):
    steps = [("m", 0, 0, "ADVANCE", None, None, None, None, None, None, [("c", "add", 1), ("d", "add", 1)]), ("m", 1, 0, "JUMP", 0, [("c", "<", 3)], None, None, None, None, None), ("m", 1, 1, "ADVANCE", None, [("c", ">=", 3)], None, None, None, None, None), ("m", 2, 0, "JUMP", 0, None, None, None, None, None, None)]
    rules = [("m", 1, 1, "r", [1, 2]), ("m", 0, 0, "s", [4])]
    got = A.state_musts(spark.createDataFrame(steps, A.STEP), spark.createDataFrame([("m", 0, 0, None, None, [("c", 0), ("d", 0)])], A.ENTRY), spark.createDataFrame(rules, "machine string, state int, path int, register string, values array<int>"))
    rows = {(r["state"], r["counters"][0]["value"], r["register"]): r["values"] for r in got.collect()}
    assert rows[2, 3, "r"] == [1, 2] and rows[1, 1, "s"] == [4] and all(v <= 4 for _, v, _ in rows)


def plain_costs(writes, deps):
    own = {w: set(i) for w, _, _, i in writes}
    of = {w: (r, v) for w, r, v, _ in writes}

    def cost(register, value):
        ways = [own[w] for w, rv in of.items() if rv == (register, value)]
        return set.intersection(*ways) if ways and value != 0 else set()

    changed = True
    while changed:
        changed = False
        for w, register, values in deps:
            if register == of[w][0]:
                continue
            more = set.intersection(*(cost(register, v) for v in values))
            if not more <= own[w]:
                own[w] |= more
                changed = True
    return own, cost


@pytest.mark.parametrize("seed", range(2))
def test_costs_flow_along_chains(spark, seed):
    rng = random.Random(70 + seed)
    writes = [(k, f"r{rng.randrange(8)}", rng.randrange(3), sorted({f"i{rng.randrange(5)}" for _ in range(rng.randrange(3))})) for k in range(30)]
    deps = list({(k, r): (k, r, rng.sample(range(3), rng.randrange(1, 3))) for k in range(30) for r in [f"r{rng.randrange(8)}"] if rng.random() < 0.8}.values())
    w, d = spark.createDataFrame(writes, "write int, register string, value int, items array<string>"), spark.createDataFrame(deps, "write int, register string, values array<int>")
    asked = costs.chained(w, d)
    own, cost = plain_costs(writes, deps)
    got = {k: set() for k in own}
    for r in asked.collect():
        got[r["write"]].add(r["item"])
    assert got == own
    wanted = [(n, f"r{n % 8}", [1, 2] if n % 3 else [n % 2 + 1]) for n in range(16)]
    found = costs.register_costs(w, asked, spark.createDataFrame(wanted, "want int, register string, values array<int>"))
    assert {tuple(r) for r in found.collect()} == {(n, i) for n, r, vs in wanted for i in set.intersection(*(cost(r, v) for v in vs))}
    units = spark.createDataFrame([("u", ["i0", "i1"]), ("v", ["i4"])], "unit string, items array<string>")
    out = {tuple(r) for r in costs.unreachable(found, units).collect()}
    assert out == {(u, n) for u, items in (("u", {"i0", "i1"}), ("v", {"i4"})) for n, i in ((r["want"], r["item"]) for r in found.collect()) if i in items}


def test_a_chain_of_three_registers(spark):
    writes = [(1, "a", 1, ["scarf"]), (2, "b", 1, []), (3, "c", 1, ["lamp"]), (4, "d", 1, []), (5, "d", 1, ["lamp", "rope"])]
    deps = [(2, "a", [1]), (3, "b", [1]), (4, "c", [1]), (1, "a", [1])]
    w, d = spark.createDataFrame(writes, "write int, register string, value int, items array<string>"), spark.createDataFrame(deps, "write int, register string, values array<int>")
    asked = costs.chained(w, d).groupBy("write").agg(F.sort_array(F.collect_set("item")).alias("i"))
    assert {r["write"]: r["i"] for r in asked.collect()} == {1: ["scarf"], 2: ["scarf"], 3: ["lamp", "scarf"], 4: ["lamp", "scarf"], 5: ["lamp", "rope"]}
    first = costs.chained(w, d, rounds=1)
    assert {(r["write"], r["item"]) for r in first.collect()} >= {(2, "scarf"), (3, "lamp")} and not first.where("write = 3 and item = 'scarf'").count()
    want = costs.register_costs(w, costs.chained(w, d), spark.createDataFrame([("x", "d", [1]), ("y", "d", [0, 1]), ("z", "q", [3])], "want string, register string, values array<int>"))
    assert {tuple(r) for r in want.collect()} == {("x", "lamp")}
