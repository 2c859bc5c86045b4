"""State machines compiled to exits and deaths, and what holds on every path to a state.

step: machine, state, path, trans (ADVANCE, JUMP, SETSTATE, PARK, EXIT, DEATH), target, and what a path through the state asks and does:
tests (counter, cmp, value), atoms (register, cmp, value), items, writes (register, value), gains (register, delta) and sets
(counter, op: set or add, value). entry: machine, entry, state, atoms, items, counters (counter, value). Arrays may be null.

Counters are a machine's own and are resolved while a walk knows them: one that nothing has set is unknown, and an unknown counter allows
either way. Registers belong to the world: what is asked of them stays on the path. All machines walk together, one join for each step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.operators.guard_trees import compared
from karst.plans.fixpoint import written

TESTS = "array<struct<counter:string,cmp:string,value:int>>"
ATOMS = "array<struct<register:string,cmp:string,value:int>>"
WRITES = "array<struct<register:string,value:int>>"
GAINS = "array<struct<register:string,delta:int>>"
SETS = "array<struct<counter:string,op:string,value:int>>"
COUNTERS = "array<struct<counter:string,value:int>>"
STEP = f"machine string, state int, path int, trans string, target int, tests {TESTS}, atoms {ATOMS}, items array<string>, writes {WRITES}, gains {GAINS}, sets {SETS}"
ENTRY = f"machine string, entry int, state int, atoms {ATOMS}, items array<string>, counters {COUNTERS}"


def _array(df: DataFrame, column: str, kind: str) -> Column:
    return (F.coalesce(F.col(column), F.array().cast(kind)) if column in df.columns else F.array().cast(kind)).cast(kind).alias(column)


def _full(steps: DataFrame) -> DataFrame:
    arrays = (("tests", TESTS), ("atoms", ATOMS), ("items", "array<string>"), ("writes", WRITES), ("gains", GAINS), ("sets", SETS))
    return steps.select("machine", F.col("state").cast("int"), F.col("path").cast("int"), "trans", F.col("target").cast("int"), *(_array(steps, c, k) for c, k in arrays))


def contradicts(atoms: Column) -> Column:
    """Whether conditions, taken together, ask a register to equal two values, or one that it must not equal."""
    equal = F.filter(atoms, lambda a: a["cmp"] == "==")
    return F.exists(equal, lambda a: F.exists(atoms, lambda b: (b["register"] == a["register"]) & (((b["cmp"] == "==") & (b["value"] != a["value"])) | ((b["cmp"] == "!=") & (b["value"] == a["value"])))))


def last_writes(writes: Column) -> Column:
    """One write for each register, the last, in order of the registers."""
    names = F.array_sort(F.array_distinct(F.transform(writes, lambda w: w["register"])))
    return F.transform(names, lambda r: F.element_at(F.filter(writes, lambda w: w["register"] == r), -1))


def step_paths(steps: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Steps with their gains spelled out: a step that adds to a register becomes one for each value that the register is known to have.

    domains: machine, register, value. Each such step asks for the value and writes the sum. A gain of a register without values is left out, and
    so are steps whose conditions then contradict each other.
    """
    found = _full(steps)
    if domains is None:
        return found.withColumn("gains", F.array().cast(GAINS)).where(~contradicts(F.col("atoms")))
    values = domains.groupBy("machine", "register").agg(F.sort_array(F.collect_set(F.col("value").cast("int"))).alias("v"))
    values = values.groupBy("machine").agg(F.map_from_entries(F.collect_list(F.struct("register", "v"))).alias("_domain"))
    found = found.join(values, "machine", "left")
    pair = "array<struct<atoms:" + ATOMS + ",writes:" + WRITES + ">>"

    def spread(branches: Column, gain: Column) -> Column:
        known = F.coalesce(F.try_element_at("_domain", gain["register"]), F.array().cast("array<int>"))
        one = lambda b, v: F.struct(
            F.array_append(b["atoms"], F.struct(gain["register"].alias("register"), F.lit("==").alias("cmp"), v.alias("value"))).alias("atoms"),
            F.array_append(b["writes"], F.struct(gain["register"].alias("register"), (v + gain["delta"]).alias("value"))).alias("writes"),
        )
        return F.when(F.size(known) == 0, branches).otherwise(F.flatten(F.transform(branches, lambda b: F.transform(known, lambda v: one(b, v)))).cast(pair))

    start = F.array(F.struct(F.col("atoms").alias("atoms"), F.col("writes").alias("writes"))).cast(pair)
    found = found.withColumn("_b", F.explode(F.aggregate("gains", start, spread))).withColumns({"atoms": F.col("_b.atoms"), "writes": F.col("_b.writes"), "gains": F.array().cast(GAINS)})
    return found.drop("_b", "_domain").where(~contradicts(F.col("atoms")))


def _value(counters: Column, name: Column) -> Column:
    """The value of a counter, null if nothing has set it."""
    return F.try_element_at(F.filter(counters, lambda c: c["counter"] == name), F.lit(1))["value"]


def tests_hold(tests: Column, counters: Column) -> Column:
    """No test fails; what is unknown fails none."""
    fails = lambda t: F.coalesce(~compared(_value(counters, t["counter"]), t["cmp"], t["value"]), F.lit(False))
    return ~F.exists(tests, fails)


def _applied(counters: Column, sets: Column) -> Column:
    """Counters after sets, in order of their names; adding to an unknown counter leaves it unknown."""

    def one(acc: Column, s: Column) -> Column:
        rest = F.filter(acc, lambda c: c["counter"] != s["counter"])
        new = F.when(s["op"] == "set", s["value"]).otherwise(_value(acc, s["counter"]) + s["value"])
        return F.when(new.isNull(), rest).otherwise(F.array_append(rest, F.struct(s["counter"].alias("counter"), new.alias("value")))).cast(COUNTERS)

    return F.array_sort(F.aggregate(sets, counters.cast(COUNTERS), one))


def _landing() -> Column:
    return F.when(F.col("trans") == "ADVANCE", F.col("state") + 1).when(F.col("trans") == "JUMP", F.col("target")).when(F.col("trans") == "SETSTATE", F.col("target") + 1)


def _present(steps: DataFrame) -> DataFrame:
    """machine, first, state: landings from first up to state come to rest in state, as states that are absent wait for the next one."""
    states = steps.select("machine", "state").distinct()
    before = F.lag("state").over(Window.partitionBy("machine").orderBy("state"))
    return states.select("machine", F.coalesce(before + 1, F.lit(-(1 << 30))).alias("first"), "state")


def compiled(steps: DataFrame, entries: DataFrame, domains: DataFrame | None = None, deepest: int = 160, most_paths: int = 4000) -> dict[str, DataFrame]:
    """exits (machine, entry, room, atoms, items, writes), deaths (machine, entry, atoms, items) and truncated (machine, why).

    Every path from every entry is walked, with what it asks and writes; a state is not entered again on a path with the same counters. A
    path that parks ends. A machine whose paths outnumber most_paths in all, or that goes deeper than deepest, is cut there and reported as
    truncated: its rows are some of its exits and must not be read as all.
    """
    paths = written(step_paths(steps, domains))
    rest = written(_present(paths))
    key = F.struct(F.col("state").alias("state"), F.col("counters").alias("counters"))
    seen = f"array<struct<state:int,counters:{COUNTERS}>>"
    own = entries.select("machine", F.col("entry").cast("int"), F.col("state").cast("int").alias("at"), _array(entries, "atoms", ATOMS), _array(entries, "items", "array<string>"), F.array_sort(_array(entries, "counters", COUNTERS)).alias("counters"))
    front = _rested(own.withColumns({"writes": F.array().cast(WRITES), "seen": F.array().cast(seen)}), rest)
    exits, deaths, cut = [], [], []
    total: DataFrame | None = None
    step = paths.select("machine", "state", "trans", "target", "tests", F.col("atoms").alias("_atoms"), F.col("items").alias("_items"), F.col("writes").alias("_writes"), "sets")
    for _ in range(deepest + 1):
        front = written(front.distinct())
        if front.isEmpty():
            break
        went = front.join(step, ["machine", "state"]).where(tests_hold(F.col("tests"), F.col("counters")))
        went = went.withColumns({"atoms": F.array_sort(F.array_union("atoms", "_atoms")), "items": F.array_sort(F.array_union("items", "_items")), "writes": F.concat("writes", "_writes")})
        went = written(went.where(~contradicts(F.col("atoms"))))
        exits.append(went.where("trans = 'EXIT'").select("machine", "entry", F.col("target").alias("room"), "atoms", "items", last_writes(F.col("writes")).alias("writes")))
        deaths.append(went.where("trans = 'DEATH'").select("machine", "entry", "atoms", "items"))
        on = went.withColumn("counters", _applied(F.col("counters"), F.col("sets"))).where(_landing().isNotNull() & ~F.array_contains("seen", key.cast(seen[6:-1])))
        on = on.select("machine", "entry", _landing().alias("at"), "atoms", "items", "writes", "counters", F.array_sort(F.array_append("seen", key.cast(seen[6:-1]))).alias("seen"))
        many = went.groupBy("machine").agg(F.count(F.lit(1)).alias("n"))
        total = written(many if total is None else total.unionAll(many).groupBy("machine").agg(F.sum("n").alias("n")))
        full = total.where(F.col("n") > most_paths).select("machine")
        cut.append(on.join(full, "machine", "left_semi").select("machine", F.lit("paths").alias("why")))
        front = _rested(on.join(full, "machine", "left_anti"), rest)
    else:
        cut.append(written(front.distinct()).select("machine", F.lit("depth").alias("why")))
    if not exits:
        none = front.join(step, ["machine", "state"])
        exits, deaths, cut = [none.select("machine", "entry", F.col("target").alias("room"), "atoms", "items", "writes")], [none.select("machine", "entry", "atoms", "items")], [none.select("machine", F.lit("").alias("why"))]
    put = lambda parts: reduce(DataFrame.unionAll, parts).distinct()
    return {"exits": put(exits), "deaths": put(deaths), "truncated": put(cut)}


def _rested(df: DataFrame, rest: DataFrame) -> DataFrame:
    """Landings (at) come to rest in the first state that is there; beyond the last one there is none."""
    return df.join(rest, "machine").where(F.col("at").between(F.col("first"), F.col("state"))).drop("at", "first")


def _projected(counters: Column, limits: Column) -> Column:
    """Counters that some test reads, up to just beyond the constants they are compared with: above those all values are alike."""
    kept = F.filter(counters, lambda c: F.array_contains(F.map_keys(limits), c["counter"]))
    return F.array_sort(F.transform(kept, lambda c: F.struct(c["counter"].alias("counter"), F.greatest(-F.element_at(limits, c["counter"]), F.least(F.element_at(limits, c["counter"]), c["value"])).alias("value"))))


def state_musts(steps: DataFrame, entries: DataFrame, allowed: DataFrame) -> DataFrame:
    """machine, state, counters, register, values: what every path from an entry to a state has established of a register, by counters.

    allowed: machine, state, path, register, values: the values that a step's conditions leave a register. A meet over all paths, as a
    fixpoint over all machines: along a step values are intersected with what it allows, and forgotten if it writes the register; where paths
    meet, a register stays known only if every one of them knows it, to the values of any. States are told apart by the counters that some test
    of their machine reads. An empty array is kept: no value is left. Entries know nothing.
    """
    full = written(_full(steps).where("trans in ('ADVANCE', 'JUMP', 'SETSTATE')"))
    tested = _full(steps).select("machine", F.explode("tests").alias("t")).groupBy("machine", "t.counter").agg((F.max(F.abs("t.value")) + 1).alias("most"))
    limits = written(tested.groupBy("machine").agg(F.map_from_entries(F.collect_list(F.struct("counter", "most"))).alias("_limits")))
    free = F.create_map().cast("map<string,int>")
    limited = lambda df: df.join(limits, "machine", "left").withColumn("counters", _projected(F.col("counters"), F.coalesce("_limits", free))).drop("_limits")
    seeds = limited(entries.select("machine", F.col("state").cast("int"), F.array_sort(_array(entries, "counters", COUNTERS)).alias("counters"))).distinct()
    front, every, arcs = written(seeds), [], []
    node = ["machine", "state", "counters"]
    while not front.isEmpty():
        every.append(front)
        went = front.join(full, ["machine", "state"]).where(tests_hold(F.col("tests"), F.col("counters")))
        went = went.withColumns({"to": _landing(), "after": _applied(F.col("counters"), F.col("sets"))}).select(*node, "path", "to", "after")
        went = written(limited(went.withColumnRenamed("counters", "_own").withColumnRenamed("after", "counters")).withColumnRenamed("counters", "after").withColumnRenamed("_own", "counters"))
        arcs.append(went)
        front = written(went.select("machine", F.col("to").alias("state"), F.col("after").alias("counters")).distinct().join(reduce(DataFrame.unionAll, every), node, "left_anti"))
    if not every:
        return seeds.select(*node, F.lit(None).cast("string").alias("register"), F.array().cast("array<int>").alias("values")).limit(0)
    numbered = written(reduce(DataFrame.unionAll, every).withColumn("node", F.monotonically_increasing_id()))
    to = numbered.select("machine", F.col("state").alias("to"), F.col("counters").alias("after"), F.col("node").alias("dst"))
    moves = reduce(DataFrame.unionAll, arcs).join(numbered.withColumnRenamed("node", "src"), node).join(to, ["machine", "to", "after"])
    moves = written(moves.select("machine", "state", "path", "src", "dst").withColumn("arc", F.monotonically_increasing_id()))
    rule = moves.join(allowed.select("machine", F.col("state").cast("int"), F.col("path").cast("int"), "register", F.col("values").cast("array<int>").alias("allow")), ["machine", "state", "path"]).select("arc", "dst", "register", "allow")
    kills = written(moves.join(full.select("machine", "state", "path", F.explode("writes").alias("w")), ["machine", "state", "path"]).select("arc", F.col("w.register").alias("register")).distinct())
    rule = written(rule.join(kills, ["arc", "register"], "left_anti"))
    ends = moves.select("src", "dst", "arc")
    start = written(numbered.join(seeds, node, "left_semi").select("node"))
    known, facts, size = start, written(start.select("node", F.lit(None).cast("string").alias("register"), F.array().cast("array<int>").alias("values")).limit(0)), None
    while True:
        live = written(ends.join(known.withColumnRenamed("node", "src"), "src", "left_semi"))
        carried = live.join(facts.withColumnRenamed("node", "src"), "src").join(kills, ["arc", "register"], "left_anti").select("arc", "dst", "register", "values")
        here = rule.join(live.select("arc"), "arc", "left_semi").withColumnRenamed("dst", "_dst")
        both = carried.join(here, ["arc", "register"], "full").select(F.coalesce("dst", "_dst").alias("dst"), "arc", "register", F.when(F.col("values").isNull(), F.col("allow")).when(F.col("allow").isNull(), F.col("values")).otherwise(F.array_intersect("values", "allow")).alias("values"))
        into = live.groupBy("dst").agg(F.count(F.lit(1)).alias("_in"))
        met = both.groupBy("dst", "register").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values")).join(into, "dst").where("_n = _in")
        facts = written(met.select(F.col("dst").alias("node"), "register", "values").join(start, "node", "left_anti"))
        known = written(known.unionAll(live.select(F.col("dst").alias("node"))).distinct())
        # once all nodes are known, facts can only go and their values only grow: as many of both as before are the same ones
        now = (known.count(), *facts.agg(F.count(F.lit(1)), F.sum(F.size("values"))).first())
        if now == size:
            return facts.join(numbered, "node").select(*node, "register", "values")
        size = now


def musts_at(musts: DataFrame, states: DataFrame) -> DataFrame:
    """machine, state, register, values: what holds in a state under every valuation of its counters that can be. states: machine, state, counters of all
    valuations that reach it (as state_musts walks them)."""
    many = states.groupBy("machine", "state").agg(F.count_distinct("counters").alias("_all"))
    found = musts.groupBy("machine", "state", "register").agg(F.count_distinct("counters").alias("_n"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"))
    return found.join(many, ["machine", "state"]).where("_n = _all").select("machine", "state", "register", "values")
