"""Facts of programs: what every effect of a body does, in which room, and under which tests.

Programs come as flattened trees (sources.ir: a node holds the interval of all its descendants). Bodies are read whole (operators.bodies); joined
is what crosses them:

contexts: a body runs in the room of its scope, and in every room from which it is called, directly or through other calls; the tests on
the way to a call belong to what the called body does. Calls are followed round by round over all programs together; a procedure is not
entered again on a way that has come through it.
conditions: the tests on the way to an effect, and those of its context.
guards: the tests as guard trees (operators.guard_trees), one tree for all effects with equal tests; what cannot be read is an OPAQUE atom.
alternatives: the items that each way to satisfy a guard asks for.

Effects whose guard asks for the player to be in another room, or for a register to be two things at once, never come about and are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions import guards as G
from karst.operators import guard_trees
from karst.operators.bodies import Bodies, bodies_of
from karst.operators.tree import BODY
from karst.plans.fixpoint import large, written

CONDITION = "struct<file:string,script:int,owner:string,body:string,test:int,holds:boolean,text:string>"
#: The guard of all effects without tests.
FREE = -1

@dataclass(frozen=True)
class Vocabulary:
    """What names and numbers of a program mean: globals by number, selectors and procedures by name."""

    ego: int = 0
    here: int = 11
    pending: int | None = 13
    inventory: str = "Inv"
    at: str = "at"
    moves: tuple[str, ...] = ("newRoom",)
    exits: tuple[str, ...] = ("north", "east", "south", "west")
    takes: tuple[str, ...] = ("get",)
    puts: tuple[str, ...] = ("put",)
    holds: tuple[str, ...] = ("has",)
    owned: tuple[str, ...] = ("ownedBy",)
    properties: tuple[str, ...] = ("loop", "cel")
    members: tuple[str, ...] = ("oneOf",)
    machine: str = "changeState"


def tests(nodes: DataFrame, roots: DataFrame, vocabulary: Vocabulary, read: Bodies | None = None) -> DataFrame:
    """The guard nodes of each test: the body columns, test, node, parent (null at the top), op, kind, var, cmp, value. roots: the body columns, test.

    An item held is OWN i<n>, a global compared CMP r<n>, a local or temporary one CTR, the place of an item LOC; a variable alone is compared
    with 0; a number alone is a constant (an AND of nothing where it holds); a membership test is the OR of its values; the label of a case
    compares the head of its switch. All else is OPAQUE.
    """
    return (read or bodies_of(nodes, vocabulary)).trees.join(roots.select(*BODY, "test").distinct(), [*BODY, "test"], "left_semi")


def _conditions() -> Column:
    at = [F.col(c) for c in BODY]
    return F.transform("tests", lambda x: F.struct(*at, x["test"].alias("test"), x["holds"].alias("holds"), x["text"].alias("text"))).cast(f"array<{CONDITION}>").alias("conditions")


def calls(read: Bodies) -> DataFrame:
    """The body columns, conditions, callee script and name: the calls whose procedure is in the table."""
    procedures = read.rows.where("kind = 'body' and owner = ''").select("file", F.col("script").alias("to_script"), F.col("body").alias("to_body"))
    sites = read.statements.where("kind = 'call'").select(*BODY, _conditions(), F.when(F.col("vtype") == "PublicCall", F.coalesce("idx", "script")).otherwise(F.col("script")).alias("to_script"), F.col("register").alias("to_body"))
    return sites.join(procedures, ["file", "to_script", "to_body"], "left_semi").select(*BODY, F.col("conditions").alias("_more"), "to_script", "to_body")


def contexts(scopes: DataFrame, read: Bodies) -> DataFrame:
    """room, the body columns, movement, conditions: every room in which a body runs, and the tests on the ways of calls to it.

    scopes: room, the body columns, movement (false where a machine owns the moves), conditions or none. Two ways with the same tests are one.
    """
    sites = written(calls(read))
    given = lambda c: F.struct(*(c[x].alias(x) for x in [*BODY, "test", "holds"]), F.concat_ws(":", *(c[x].cast("string") for x in [*BODY, "test"])).alias("text"))
    held = F.transform("conditions", given) if "conditions" in scopes.columns else F.array()
    seen = F.when(F.col("owner") == "", F.array(F.struct("script", "body"))).otherwise(F.array()).cast("array<struct<script:int,body:string>>")
    front = written(scopes.select("room", *BODY, "movement", held.cast(f"array<{CONDITION}>").alias("conditions"), seen.alias("_seen")).distinct())
    every = [front]
    while True:
        to = F.struct(F.col("to_script").alias("script"), F.col("to_body").alias("body"))
        step = front.join(sites, BODY).where(~F.array_contains("_seen", to))
        step = step.select("room", "file", F.col("to_script").alias("script"), F.lit("").alias("owner"), F.col("to_body").alias("body"), "movement", F.array_sort(F.array_union("conditions", "_more")).alias("conditions"), F.array_sort(F.array_append("_seen", to)).alias("_seen"))
        front = written(step.distinct())
        if front.isEmpty():
            return written(reduce(DataFrame.unionAll, every).drop("_seen").distinct())
        every.append(front)


def effects(nodes: DataFrame, vocabulary: Vocabulary, read: Bodies | None = None) -> DataFrame:
    """The body columns, leaf, kind, item, register, value, conditions: what each statement does, wherever it runs.

    move: to room value; exit, pending: a way to room value opened by a property, or by the global of the room to come; take: an item comes to
    the player; put: it comes to room value (null: nowhere); set: a register gets a value; prop: an item's property register gets a value (null:
    it is counted). A move to a variable goes to every room that some assignment gives it, under the tests of the assignment too: a global's
    assignments in its program, a local one's in its script, a temporary one's in its body.
    """
    rows = (read or bodies_of(nodes, vocabulary)).statements
    out = [rows.where("kind not in ('call', 'given', 'to variable')").select(*BODY, "leaf", "kind", "item", "register", "value", _conditions())]
    variable = rows.where("kind = 'to variable'").select(*BODY, "leaf", "vtype", "idx", _conditions())
    given = rows.where("kind = 'given'").select(*BODY, "vtype", "idx", F.col("value"), _conditions().alias("_extra"))
    for mine, scope in (("vtype = 'Global'", ["file"]), ("vtype = 'Local'", ["file", "script"]), ("vtype not in ('Global', 'Local')", BODY)):  # as keys: no send meets an assignment of another scope
        seen = given.where(mine).select(*scope, "vtype", "idx", "value", "_extra").distinct()
        met = variable.where(mine).join(seen, [*scope, "vtype", "idx"]).withColumn("conditions", F.array_union("conditions", "_extra"))
        out.append(met.select(*BODY, "leaf", F.lit("move").alias("kind"), F.lit(None).cast("int").alias("item"), F.lit(None).cast("string").alias("register"), "value", "conditions").distinct())
    return reduce(DataFrame.unionAll, out)


def facts(nodes: DataFrame, scopes: DataFrame, vocabulary: Vocabulary, read: Bodies | None = None) -> DataFrame:
    """room, the body columns, leaf, movement, kind, item, register, value, conditions: each effect in each context, numbered as guard."""
    read = read or bodies_of(nodes, vocabulary)
    where = contexts(scopes, read).withColumnRenamed("conditions", "_held")
    found = effects(nodes, vocabulary, read).join(large(where), BODY)
    found = found.withColumn("conditions", F.array_sort(F.array_union("_held", "conditions"))).drop("_held").distinct()
    return written(found.withColumn("guard", F.monotonically_increasing_id()))


def as_one(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The facts numbered anew, those with equal tests by one guard; and guard, conditions: the tests of one of them for each guard."""
    key = F.array_join(F.array_sort(F.array_distinct(F.transform("conditions", lambda c: F.concat(F.when(c["holds"], "+").otherwise("-"), c["text"])))), "\n")
    tested = found.where(F.size("conditions") > 0).withColumn("_key", key)
    one = written(tested.groupBy("_key").agg(F.min("guard").alias("_guard"), F.min_by("conditions", "guard").alias("conditions")))
    free = found.where(F.size("conditions") == 0).withColumn("guard", F.lit(FREE).cast("long"))
    tested = tested.join(one.select("_key", "_guard"), "_key").withColumn("guard", F.col("_guard")).select(*found.columns)
    free_one = one.sparkSession.range(1).select(F.lit(FREE).cast("long").alias("guard"), F.array().cast(f"array<{CONDITION}>").alias("conditions"))
    return written(tested.unionAll(free.select(*found.columns))), one.select(F.col("_guard").alias("guard"), "conditions").unionAll(free_one)


def guard_trees_of(found: DataFrame, read: DataFrame) -> DataFrame:
    """Guard nodes (see operators.guard_trees) of facts: an AND of their conditions, those that must fail under a NOT. read: tests()."""
    wide = lambda k, n: F.shiftleft(k.cast("long") + 1, 32) + n
    none = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("var", "string"), ("cmp", "string"), ("value", "int"))]
    root = found.select("guard", F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit("AND").alias("op"), *none)
    each = found.select("guard", F.posexplode("conditions").alias("k", "c")).select("guard", "k", *(F.col(f"c.{x}").alias(x) for x in [*BODY, "test", "holds"]))
    side = each.select("guard", wide(F.col("k"), 0).alias("node"), F.lit(0).cast("long").alias("parent"), F.when(F.col("holds"), "AND").otherwise("NOT").alias("op"), *none)
    inner = each.join(read, [*BODY, "test"])
    parent = F.coalesce(F.col("parent") + 1, F.lit(0))
    below = inner.select("guard", wide(F.col("k"), F.col("node") + 1).alias("node"), wide(F.col("k"), parent).alias("parent"), "op", "kind", "var", "cmp", "value")
    return root.unionAll(side).unionAll(below)


def alternatives(levelled: DataFrame) -> DataFrame:
    """guard, alts: the sets of items that the ways to satisfy each guard ask for, minimal; what is no item asks for none.

    Folded from the leaves up, level by level: where one child may hold (OR, or AND under a negation) the sets are put together, where
    all must hold each set is joined with each.
    """
    free = F.expr("array(cast(array() as array<string>))")
    own = (F.col("kind") == "OWN") & F.col("positive")
    leaf = guard_trees.atoms(levelled).select("guard", "node", "parent", "depth", F.when(F.coalesce(own, F.lit(False)), F.array(F.array("var"))).otherwise(free).alias("alts"))
    out, inner = written(leaf), levelled.where("op <> 'ATOM'")
    all_hold = ((F.col("op") == "AND") == F.col("positive")) | (F.col("op") == "NOT")
    for depth in range(levelled.agg(F.max("depth")).first()[0] or 0, -1, -1):
        kids = out.where(F.col("depth") == depth + 1).groupBy("guard", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("alts")).alias("_kids"))
        up = inner.where(F.col("depth") == depth).join(kids, ["guard", "node"], "left").withColumn("_kids", F.coalesce("_kids", F.array(free)))
        both = F.aggregate("_kids", free, G.conjoined)
        out = written(out.where(F.col("depth") <= depth).unionAll(up.select("guard", "node", "parent", "depth", F.when(all_hold, both).otherwise(G.minimal(F.flatten("_kids"))).alias("alts"))))
    return out.where("depth = 0").select("guard", "alts")


@dataclass(frozen=True)
class Program:
    """The relations that programs give, ready for a world (operators.world).

    edges: room, dst, kind, via, movement, guard. takes, puts: item, room, (value,) guard. writes: room, register, value, guard. needs: item, room.
    levelled: the guard trees. alts: guard, alts.
    """

    facts: DataFrame
    levelled: DataFrame
    alts: DataFrame

    @property
    def edges(self) -> DataFrame:
        return self.facts.where("kind in ('move', 'exit', 'pending')").select("room", F.col("value").alias("dst"), "kind", F.col("owner").alias("via"), "movement", "conditions", "guard")

    @property
    def takes(self) -> DataFrame:
        return self.facts.where("kind = 'take'").select(F.concat(F.lit("i"), "item").alias("item"), "room", "conditions", "guard")

    @property
    def puts(self) -> DataFrame:
        return self.facts.where("kind = 'put'").select(F.concat(F.lit("i"), "item").alias("item"), F.col("value").alias("room"), "conditions", "guard")

    @property
    def writes(self) -> DataFrame:
        return self.facts.where("kind = 'set'").select("room", "register", "value", "conditions", "guard")

    @property
    def needs(self) -> DataFrame:
        """item, room: what some effect asks for there, however else it can be had."""
        asked = guard_trees.required(self.levelled).withColumnRenamed("var", "item")
        return self.facts.select("guard", "room").distinct().join(asked, "guard").select("item", "room").distinct()

    def ways(self, registers: list[str]) -> DataFrame:
        """src, dst, alts and for each register req_<r> and set_<r>, as a world reads them: what equality each way asks of a register."""
        asks = guard_trees.must_equal(self.levelled).where(F.col("var").isin(*registers)).groupBy("guard").pivot("var", registers).agg(F.max("value"))
        found = self.edges.where("movement").join(self.alts, "guard").join(asks, "guard", "left")
        columns = [x for r in registers for x in (F.col(r).cast("int").alias(f"req_{r}"), F.lit(None).cast("int").alias(f"set_{r}"))]
        return found.select(F.col("room").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "alts", *columns).distinct()

    def costs(self) -> DataFrame:
        """register, room, value, cost: writes, one row for each way to satisfy their guard."""
        found = self.writes.join(self.alts, "guard").select("register", "room", "value", F.explode("alts").alias("cost"))
        return found.select("register", F.col("room").cast("long").alias("room"), "value", "cost").distinct()


def extract(nodes: DataFrame, scopes: DataFrame, vocabulary: Vocabulary = Vocabulary(), whole: bool = False) -> Program:  # noqa: B008
    """All facts of programs. nodes: see sources.ir; scopes: room, the body columns, movement; whole: no body lies in two partitions of nodes."""
    read = bodies_of(nodes, vocabulary, whole)
    found, guards = as_one(facts(nodes, scopes, vocabulary, read))
    roots = guards.select(F.explode("conditions").alias("c")).select(*(F.col(f"c.{x}").alias(x) for x in [*BODY, "test"])).distinct()
    levelled = guard_trees.levels(guard_trees_of(guards, tests(nodes, roots, vocabulary, read)))
    away = guard_trees.elsewhere(levelled, f"r{vocabulary.here}", found.select("guard", "room").distinct())
    kept = written(found.join(away, ["guard", "room"], "left_anti").join(guard_trees.contradictory(levelled), "guard", "left_anti"))
    levelled = written(levelled.join(kept.select("guard").distinct(), "guard", "left_semi"))
    return Program(kept, levelled, written(alternatives(levelled)))


def room_scopes(nodes: DataFrame, rooms: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """Scopes of the methods of rooms: each runs in the room of its script. rooms: script, room (a region's script has a row for each room that runs it)."""
    return nodes.where("parent is null and owner <> ''").select(*BODY).join(rooms, "script").select("room", *BODY, (F.col("body") != vocabulary.machine).alias("movement"))
