"""Facts of programs against a plain walk over the trees, on written and on random programs."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from karst.operators import extract, guard_trees
from karst.operators.world import World
from karst.sources import ir
from karst.sources.programs import node, number, send, variable

EGO, SELF, INV = variable(0), node("Object", name="self"), node("Object", name="Inv")
V = extract.Vocabulary()
move = lambda r: send(SELF, "newRoom", number(r))
take = lambda i: send(EGO, "get", number(i))
has = lambda i: send(EGO, "has", number(i))
setg = lambda r, v: node("Assignment", variable(r), number(v))
at = lambda i: send(INV, "at", number(i))


def script(n, methods=(), procedures=()):
    objects = [{"name": f"obj{n}", "isClass": False, "species": 1, "super": 2, "properties": [], "methods": [{"sel": k, "name": name, "ast": ast} for k, (name, ast) in enumerate(methods)]}]
    return {"number": n, "locals": [], "procedures": [{"name": name, "ast": ast} for name, ast in procedures], "exports": [], "objects": objects}


def nodes_of(spark, folder, scripts):
    (folder / "p.json").write_text(json.dumps({"game": "x", "selectors": [], "scripts": scripts}))
    return ir.read_ir(spark, str(folder))["node"]


# -- a plain walk -----------------------------------------------------------------------------------------------------------------------


def numbered(ast):
    """The tree with places as the flattened table counts them."""
    count = [0]

    def visit(n):
        n = dict(n, at=count[0])
        count[0] += 1
        n["kids"] = [visit(k) for k in n.get("kids", []) if k]
        return n

    return visit(ast)


def walk(n, conds, leaf):
    """Calls leaf(node, conds) for every node that runs; conds: (place of the test, whether it holds)."""
    t, kids = n["t"], n["kids"]
    leaf(n, conds)
    if t == "If":
        walk(kids[0], conds, leaf)
        for k, holds in ((1, True), (2, False)):
            if len(kids) > k:
                walk(kids[k], [*conds, (kids[0]["at"], holds)], leaf)
    elif t in ("Cond", "Switch"):
        priors = []
        for c in kids:
            guards = c["t"] == "Case" and (t == "Cond" or (kids[0].get("vtype") == "Global" and c["kids"][0]["t"] == "Number"))
            if c["t"] == "Case":
                walk(c["kids"][0], conds, leaf)
                walk(c["kids"][1], conds + (priors + [(c["kids"][0]["at"], True)] if guards else []), leaf)
            elif c["t"] == "Else":
                walk(c["kids"][0], conds + priors, leaf)
            if guards:
                priors = [*priors, (c["kids"][0]["at"], False)]
    else:
        for k in kids:
            walk(k, conds, leaf)


def plain(scripts):
    """(room, kind, item, register, value, conditions) of every effect in every context."""
    bodies = {}
    for s in scripts:
        for o in s["objects"]:
            for m in o["methods"]:
                bodies[s["number"], o["name"], m["name"]] = numbered(m["ast"])
        for p in s["procedures"]:
            bodies[s["number"], "", p["name"]] = numbered(p["ast"])
    found = set()

    def run(room, key, held, seen):
        def leaf(n, conds):
            conds = held | {(*key, t, h) for t, h in conds}
            if n["t"] in ("LocalCall", "PublicCall"):
                to = (n.get("index", key[0]) if n["t"] == "PublicCall" else key[0], "", n["name"])
                if to in bodies and to not in seen:
                    run(room, to, conds, seen | {to})
            kids = n["kids"]
            emit = lambda kind, item=None, register=None, value=None: found.add((room, kind, item, register, value, frozenset(conds)))
            if n["t"] == "Send":
                r = kids[0]
                for m in kids[1:]:
                    sel, p = m["kids"][0]["name"], [k for k in m["kids"][1:]]
                    ego = r.get("vtype") == "Global" and r.get("index") == 0
                    if sel == "newRoom" and p[0]["t"] == "Number" and p[0]["value"] not in (0, 65535):
                        emit("move", value=p[0]["value"])
                    if sel == "get" and ego:
                        emit("take", item=p[0]["value"])
                    if sel == "put" and ego:
                        emit("put", item=p[0]["value"], value=p[1]["value"] if len(p) > 1 else None)
                    if sel == "loop" and r["t"] == "Send" and r["kids"][1]["kids"][0]["name"] == "at":
                        emit("prop", r["kids"][1]["kids"][1]["value"], "loop", p[0]["value"] if p[0]["t"] == "Number" else None)
            if n["t"] == "Assignment" and kids[0].get("vtype") == "Global":
                if kids[0]["index"] == 13:
                    if kids[1]["value"]:
                        emit("pending", value=kids[1]["value"])
                else:
                    emit("set", register=f"r{kids[0]['index']}", value=kids[1]["value"])

        walk(bodies[key], [], leaf)

    for key in bodies:
        if key[1]:
            run(key[0], key, frozenset(), frozenset())
    return found


def rows(df):
    return {(r["room"], r["kind"], r["item"], r["register"], r["value"], frozenset((c["script"], c["owner"], c["body"], c["test"], c["holds"]) for c in r["conditions"])) for r in df.collect()}


def scopes_of(spark, nodes, scripts):
    return extract.room_scopes(nodes, spark.createDataFrame([(s["number"], s["number"]) for s in scripts], "script int, room int"))


def random_program(rng):
    def test(depth):
        k = rng.randrange(8 if depth else 5)
        if k == 0:
            return has(rng.randrange(4))
        if k == 1:
            return node("Eq", variable(20), number(rng.randrange(3)))
        if k == 2:
            return node("Lt", number(1), variable(21))
        if k == 3:
            return send(at(rng.randrange(3)), "ownedBy", number(rng.randrange(1, 4)))
        if k == 4:
            return rng.choice([node("Property", name="x"), variable(20), node("Said"), number(1), number(0), variable(2, "Local")])
        if k == 5:
            return node("Not", test(depth - 1))
        return node("And" if k == 6 else "Or", *(test(depth - 1) for _ in range(rng.randrange(1, 4))))

    def statement(depth):
        k = rng.randrange(11 if depth else 7)
        if k < 7:
            return [move(rng.randrange(0, 4)), take(rng.randrange(4)), setg(20, rng.randrange(3)), setg(13, rng.randrange(3)), send(EGO, "put", number(2), number(3)), send(at(1), "loop", rng.choice([number(2), node("Add", number(1), number(1))])), node("LocalCall", name=f"p{rng.randrange(3)}")][k]
        if k == 7:
            return node("List", *(statement(depth - 1) for _ in range(rng.randrange(4))))
        if k == 8:
            return node("If", test(2), *(statement(depth - 1) for _ in range(rng.randrange(1, 3))))
        cases = lambda label: [node("Case", label(), statement(depth - 1)) for _ in range(rng.randrange(1, 4))] + ([node("Else", statement(depth - 1))] if rng.random() < 0.5 else [])
        if k == 9:
            return node("Cond", *cases(lambda: test(1)))
        return node("Switch", rng.choice([variable(21), variable(1, "Local")]), *cases(lambda: number(rng.randrange(3))))

    body = lambda: node("List", *(statement(3) for _ in range(rng.randrange(1, 4))))
    return [script(s, [("doit", body()), ("changeState", body())], [(f"p{k}", body()) for k in range(3)]) for s in (1, 2, 3)]


@pytest.mark.parametrize("seed", range(2))
def test_random_programs_equal_the_plain_walk(spark, tmp_path, seed):
    scripts = random_program(random.Random(seed))
    nodes = nodes_of(spark, tmp_path, scripts).cache()
    assert rows(extract.facts(nodes, scopes_of(spark, nodes, scripts), V)) == plain(scripts)


def test_guards_of_random_programs_hold_as_their_tests_do(spark, tmp_path):
    """Each guard tree is evaluated against its tests read from the JSON, in random worlds."""
    rng = random.Random(11)
    scripts = random_program(rng)
    nodes = nodes_of(spark, tmp_path, scripts).cache()
    found = extract.facts(nodes, scopes_of(spark, nodes, scripts), V)
    roots = found.select(F.explode("conditions").alias("c")).select("c.file", "c.script", "c.owner", "c.body", "c.test").distinct()
    read = extract.tests(nodes, roots, V)
    trees = {}
    for r in extract.guard_trees_of(found, read).collect():
        trees.setdefault(r["guard"], {})[r["node"]] = r
    bodies = {}
    for s in scripts:
        for o in s["objects"]:
            for m in o["methods"]:
                bodies[s["number"], o["name"], m["name"]] = numbered(m["ast"])
        for p in s["procedures"]:
            bodies[s["number"], "", p["name"]] = numbered(p["ast"])

    def find(n, place):
        return n if n["at"] == place else next((x for k in n["kids"] for x in [find(k, place)] if x), None)

    def label_of(n, place):
        if n["t"] == "Switch" and any(c["kids"][0]["at"] == place for c in n["kids"][1:]):
            return n["kids"][0]
        return next((x for k in n["kids"] for x in [label_of(k, place)] if x), None)

    def truth(n, w):
        t, k = n["t"], n["kids"]
        if t in ("And", "Or", "Not"):
            return all(truth(x, w) for x in k) if t == "And" else any(truth(x, w) for x in k) if t == "Or" else not truth(k[0], w)
        if t == "Eq":
            return w["r", k[0]["index"]] == k[1]["value"]
        if t == "Lt":
            return k[0]["value"] < w["r", k[1]["index"]]
        if t == "Send" and k[1]["kids"][0]["name"] == "has":
            return w["own", k[1]["kids"][1]["value"]]
        if t == "Send":
            return w["loc", k[0]["kids"][1]["kids"][1]["value"]] == k[1]["kids"][1]["value"]
        if t == "Variable":
            return w["r" if n["vtype"] == "Global" else "l", n["index"]] != 0
        if t == "Number" and n["value"]:
            return True
        return w["odd"]

    def holds(tree, at, w):
        r, kids = tree[at], [x for x in tree.values() if x["parent"] == at]
        if r["op"] == "AND":
            return all(holds(tree, x["node"], w) for x in kids)
        if r["op"] == "OR":
            return any(holds(tree, x["node"], w) for x in kids)
        if r["op"] == "NOT":
            return not holds(tree, kids[0]["node"], w)
        n = int(r["var"][1:]) if r["var"] else None
        if r["kind"] in ("CMP", "CTR"):
            x = w["r" if r["kind"] == "CMP" else "l", n]
            return {"==": x == r["value"], "!=": x != r["value"], "<": x < r["value"], ">": x > r["value"]}[r["cmp"]]
        return w["own", n] if r["kind"] == "OWN" else w["loc", n] == r["value"] if r["kind"] == "LOC" else w["odd"]

    many = 0
    for f in found.collect():
        for _ in range(6):
            w = {("r", 20): rng.randrange(3), ("r", 21): rng.randrange(4), ("l", 2): rng.randrange(2), ("l", 1): 0, "odd": rng.random() < 0.5}
            w |= {("own", i): rng.random() < 0.5 for i in range(4)} | {("loc", i): rng.randrange(1, 4) for i in range(4)}
            want = True
            for c in f["conditions"]:
                body = bodies[c["script"], c["owner"], c["body"]]
                head, n = label_of(body, c["test"]), find(body, c["test"])
                got = w["r", head["index"]] == n["value"] if head is not None and head.get("vtype") == "Global" else truth(n, w)
                want &= got == c["holds"]
            assert holds(trees[f["guard"]], 0, w) == want
            many += 1
    assert many > 100


def test_alternatives_are_the_minimal_sets(spark):
    rng, nodes, want = random.Random(2), [], {}

    def grow(guard, parent, depth, place):
        at = place[0]
        place[0] += 1
        k = rng.choice(["AND", "OR", "NOT", "OWN", "OWN", "CMP"]) if depth else rng.choice(["OWN", "CMP"])
        if k in ("OWN", "CMP"):
            var = f"i{rng.randrange(4)}" if k == "OWN" else "r1"
            nodes.append((guard, at, parent, "ATOM", k, var, None if k == "OWN" else "==", None if k == "OWN" else 1))
            return ("ATOM", k, var)
        nodes.append((guard, at, parent, k, None, None, None, None))
        return (k, [grow(guard, at, depth - 1, place) for _ in range(1 if k == "NOT" else rng.randrange(1, 4))])

    def sets(t, positive):
        if t[0] == "ATOM":
            return {frozenset([t[2]])} if t[1] == "OWN" and positive else {frozenset()}
        kids = [sets(x, positive != (t[0] == "NOT")) for x in t[1]]
        if t[0] == "NOT":
            return kids[0]
        if (t[0] == "AND") == positive:
            out = {frozenset()}
            for k in kids:
                out = {a | b for a in out for b in k}
            return out
        return set().union(*kids)

    for g in range(60):
        every = sets(grow(g, None, 3, [0]), True)
        want[g] = {a for a in every if not any(b < a for b in every)}
    levelled = guard_trees.levels(spark.createDataFrame(nodes, "guard long, node long, parent long, op string, kind string, var string, cmp string, value int"))
    got = {r["guard"]: {frozenset(a) for a in r["alts"]} for r in extract.alternatives(levelled).collect()}
    assert got == want


def test_written_program_runs_as_a_world(spark, tmp_path):
    """Room 2 opens once the lever is set, room 3 needs the lamp; the lamp lies in room 2, and room 9 is only dreamt of elsewhere."""
    scripts = [
        script(1, [("doit", node("List", node("If", node("Eq", variable(20), number(1)), move(2)), node("If", has(5), node("LocalCall", name="down")), node("If", node("Eq", variable(11), number(7)), move(9)))), ("handle", setg(20, 1))], [("down", node("List", node("If", node("Property", name="asleep"), node("LocalCall", name="down")), move(3)))]),
        script(2, [("doit", node("List", take(5), node("Assignment", variable(0, "Local"), number(1)), send(SELF, "newRoom", variable(0, "Local"))))]),
        script(3, [("doit", node("List", node("If", node("PublicCall", variable(20), number(1), number(2), name="oneOf", index=0), send(EGO, "put", number(5), number(3))), node("Assignment", node("Property", name="north"), number(1)))), ("changeState", move(4))]),
    ]
    nodes = nodes_of(spark, tmp_path, scripts)
    program = extract.extract(nodes, scopes_of(spark, nodes.cache(), scripts))
    edges = {(r["room"], r["dst"], r["kind"], r["movement"]) for r in program.edges.collect()}
    assert edges == {(1, 2, "move", True), (1, 3, "move", True), (2, 1, "move", True), (3, 1, "exit", True), (3, 4, "move", False)}
    assert {tuple(r) for r in program.needs.collect()} == {("i5", 1)}
    put = program.puts.join(guard_trees.asserted(program.levelled), "guard").select("room", "var", "value").collect()
    assert {tuple(r) for r in put} == {(3, "r20", 1), (3, "r20", 2)}
    ways, frame = program.ways(["r20"]), lambda data, schema: spark.createDataFrame(data, schema)
    assert {(r["src"], r["dst"], r["req_r20"], tuple(map(tuple, r["alts"]))) for r in ways.collect()} == {(1, 2, 1, ((),)), (1, 3, None, (("i5",),)), (2, 1, None, ((),)), (3, 1, None, ((),))}
    none = frame([], "register string, room long, frm int, to int, cost array<string>")
    long = lambda df: df.select("item", F.col("room").cast("long").alias("room"))
    world = World(ways, program.costs(), none, long(program.takes), long(program.needs), frame([(1,)], "room long"), frame([], "room long"), frame([], "item string, room long"), (("r20",),))
    assert {tuple(r) for r in world.values(world.states(("r20",)), ("r20",)).select("room", "r20").collect()} == {(1, 0), (1, 1), (2, 1), (3, 0), (3, 1)}
    lone = frame([("i5", ["i5"])], "unit string, items array<string>")
    assert {r["room"] for r in world.reach_without(lone).collect()} == {1, 2}


def test_temporary_variables_stay_in_their_body_and_globals_go_everywhere(spark, tmp_path):
    to = lambda kind: send(SELF, "newRoom", variable(30, kind))
    put = lambda kind, r: node("Assignment", variable(30, kind), number(r))
    scripts = [
        script(1, [("doit", node("List", node("If", has(1), put("Temp", 5)), to("Temp"))), ("other", put("Temp", 6))]),
        script(2, [("doit", to("Local")), ("other", node("If", node("Eq", variable(20), number(3)), put("Local", 7)))]),
        script(3, [("doit", to("Global"))]), script(4, [("doit", node("List", put("Global", 8), put("Global", 0)))]),
    ]
    nodes = nodes_of(spark, tmp_path, scripts).cache()
    found = extract.facts(nodes, scopes_of(spark, nodes, scripts), V).where("kind = 'move'").collect()
    assert {(r["room"], r["value"], len(r["conditions"])) for r in found} == {(1, 5, 1), (2, 7, 1), (3, 8, 0)}


def test_no_programs(spark):
    nodes = spark.createDataFrame([], ir.NODE)
    program = extract.extract(nodes, extract.room_scopes(nodes, spark.createDataFrame([], "script int, room int")))
    assert program.edges.count() == program.needs.count() == program.ways(["r1"]).count() == program.costs().count() == 0


def test_moves_to_temporary_variables_meet_only_assignments_of_their_body(spark, tmp_path):
    nodes = nodes_of(spark, tmp_path, [script(1, [("a", node("List", send(node("Object", name="self"), "newRoom", variable(1, "Temp"))))])])
    plan = extract.effects(nodes, V)._jdf.queryExecution().executedPlan().toString()
    keys = [re.findall(r"(\w+)#", k) for k in re.findall(r"Join \[([^\]]*)\]", plan)]
    assert any({"body", "vtype", "idx"} <= set(k) for k in keys)
