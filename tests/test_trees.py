"""Trees, guards, machines, surfaces and streams on small hand-written inputs and random ones."""

import json

from karst.operators import machines as M
from karst.operators import surface as S
from karst.operators import tree
from karst.sources import ir
from karst.streaming import events as E
from pyspark.sql import functions as F


def n(t, *kids, **more):
    return {"t": t, **more, "kids": list(kids)}


GLOBAL = n("Variable", vtype="Global", index=9)
num = lambda v: n("Number", value=v)
leaf = lambda name: n("Send", n("Object", name=name), n("SendMessage", n("Selector", name="do"), num(1)))
BODY = n(
    "List",
    n("If", n("Eq", GLOBAL, num(1)), leaf("a"), leaf("b")),
    n("Cond", n("Case", n("Property", name="p"), leaf("c")), n("Case", n("Property", name="q"), leaf("d")), n("Else", leaf("e"))),
    n("Switch", GLOBAL, n("Case", num(5), leaf("f")), n("Case", num(6), leaf("g")), n("Else", leaf("h"))),
    None,
)
PROGRAM = {
    "game": "x", "selectors": ["do"],
    "scripts": [{"number": 3, "locals": [{"index": 0, "value": 7}], "procedures": [{"name": "proc", "ast": n("List")}], "exports": ["obj", None],
                 "objects": [{"name": "obj", "isClass": False, "species": 1, "super": 2, "properties": [{"name": "p", "sel": 4, "value": 5}], "methods": [{"sel": 1, "name": "doit", "ast": BODY}]}]}],
}


def test_ir_relations_and_path_conditions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(PROGRAM))
    read = ir.read_ir(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in read["local"].collect()] == [(3, 0, 7)]
    assert [tuple(r)[1:] for r in read["export"].collect()] == [(3, 0, "obj"), (3, 1, None)]
    assert [tuple(r)[1:] for r in read["property"].collect()] == [(3, "obj", "p", 4, 5)]
    nodes = read["node"].where("body = 'doit'").cache()
    rows = {r["node"]: r for r in nodes.collect()}
    assert all(r["parent"] is None or rows[r["parent"]]["node"] < k <= rows[r["parent"]]["post"] for k, r in rows.items())
    sub = tree.subtree(nodes, nodes.where("t = 'Cond'").select(*tree.BODY, F.col("node").alias("root"))).count()
    assert sub == 1 + 2 * 7 + 6
    sends = tree.send_pairs(nodes).collect()
    names = {r["send"]: rows[r["receiver"]]["name"] for r in sends}
    assert sorted(names.values()) == list("abcdefgh") and {r["selector"] for r in sends} == {"do"}
    show = lambda r: {"Eq": "=1", "Property": r["name"], "Number": str(r["value"])}[r["t"]]
    got = {k: set() for k in "abcdefgh"}
    for r in tree.path_conditions(nodes, nodes.where("t = 'Send'").select(*tree.BODY, F.col("node").alias("leaf"))).collect():
        got[names[r["leaf"]]].add(("" if r["holds"] else "not ") + show(rows[r["test"]]))
    assert got == {"a": {"=1"}, "b": {"not =1"}, "c": {"p"}, "d": {"q", "not p"}, "e": {"not p", "not q"}, "f": {"5"}, "g": {"6", "not 5"}, "h": {"not 5", "not 6"}}
    kids = {r["parent"]: r["kids"] for r in tree.children(nodes).collect()}
    assert all(rows[c]["parent"] == p for p, cs in kids.items() for c in cs)


def test_forms(spark, tmp_path):
    text = '(method (doit x) ; note\n  (if (== x $1f) {said} "a\\"b") -5)\n'
    (tmp_path / "a.sc").write_text(text)
    rows = ir.read_forms(spark, str(tmp_path)).collect()
    assert [(r["kind"], r["token"]) for r in rows if r["kind"] != "list"] == [("symbol", "method"), ("symbol", "doit"), ("symbol", "x"), ("symbol", "if"), ("symbol", "=="), ("symbol", "x"), ("int", "$1f"), ("string", "{said}"), ("string", '"a\\"b"'), ("int", "-5")]
    assert text[rows[0]["first"] : rows[0]["last"]] == text.strip()


def test_cues_are_carried_and_chains_collapse(spark):
    rows = [("m", 0, 0, "ADVANCE", None, 3, 1, 0), ("m", 1, 0, "PARK", None, 0, 0, 0), ("m", 2, 0, "PARK", None, 0, 0, 0), ("m", 3, 0, "PARK", None, 0, 1, 0), ("m", 4, 0, "EXIT", None, 0, 1, 0), ("n", 0, 0, "ADVANCE", None, 1, 1, 0), ("n", 1, 0, "PARK", None, 0, 0, 0)]
    steps = spark.createDataFrame(rows, "machine string, state long, path long, trans string, target long, cues long, effects long, guards long")
    done = M.carried(steps)
    assert {(r["machine"], r["state"]): r["trans"] for r in done.collect()} == {("m", 0): "ADVANCE", ("m", 1): "ADVANCE", ("m", 2): "ADVANCE", ("m", 3): "PARK", ("m", 4): "EXIT", ("n", 0): "ADVANCE", ("n", 1): "PARK"}
    entries = spark.createDataFrame([("m", 0), ("n", 0)], "machine string, state long")
    got = {(r["machine"], r["state"]): (r["trans"], r["target"]) for r in M.compressed(done, entries).collect()}
    assert got["m", 0] == ("JUMP", 3) and got["m", 1] == ("JUMP", 3) and got["n", 0] == ("ADVANCE", None)
    asked = spark.createDataFrame([("m", 0, 0, ["a", "b"]), ("m", 1, 2, ["b"])], "machine string, entry long, state long, items array<string>")
    need = {(r["state"], r["item"]) for r in M.needed_by_all(done, asked).collect()}
    assert need == {(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "b"), (3, "b")}


def test_surface_compare(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "x"), (3, "y"), (3, "y")], "k int, v string")
    one, two = S.surface({"d": a}), S.surface({"d": b})
    assert sorted(tuple(r) for r in S.compare(one, two).collect()) == [("d", '{"k":2,"v":null}', "gone"), ("d", '{"k":3,"v":"y"}', "new")]
    S.write_surface(two, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).count() == 3


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = run(E.windowed_counts(stream, "1 hour", "1 day"), "complete", "counts")
    assert got.agg(F.sum("n")).first()[0] == src.count()
    runs = run(E.longest_runs(stream), "update", "runs")
    from karst.operators import idioms

    want = idioms.runs(src, "user_id", ["ts", "event_id"], "event_type").groupBy("user_id").agg(F.max("length").alias("n"))
    assert {(r["user_id"], r["length"]) for r in runs.collect()} == {(r["user_id"], r["n"]) for r in want.collect()}


def test_reach_grows_with_arcs(spark):
    seen = []
    batch = E.growing_reach(spark.createDataFrame([(1,)], "room long"), lambda df, k: seen.append(sorted(r["room"] for r in df.collect())))
    for k, arcs in enumerate([[(2, 3)], [(1, 2)], [(3, 4), (9, 8)]]):
        batch(spark.createDataFrame(arcs, "src long, dst long"), k)
    assert seen == [[1], [1, 2, 3], [1, 2, 3, 4]]
