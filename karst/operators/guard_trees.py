"""Guards as trees in a table: folds from the leaves up, level by level, each one aggregation by parent.

guard_node: guard, node, parent, op (AND, OR, NOT, ATOM), kind, var, cmp, value. Levels are the depth of the trees, so a fold
takes as many rounds as the deepest guard is high, over all guards together. An AND or OR without children says nothing.

Kinds of atoms: OWN (an item is held), CMP (a register compared with a value), LOC (where an item is), CTR (a counter), POS (where
the player stands), OPAQUE and SAID (nothing known).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.plans.fixpoint import large, written

#: What a comparison asserts when it is negated.
OPPOSITE = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def _whole(batches, rows: int = 1 << 17):
    """Arrow batches that come sorted by guard, as tables of whole guards."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            guard = t["guard"].to_numpy()
            last = int(np.searchsorted(guard, guard[-1]))
            if last:
                yield t.slice(0, last)
            held = t.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _placed(batches):
    """The nodes of whole guards that hang below a root, with depth, positive, plain, spine and below."""
    for t in _whole(batches):
        of = np.unique(t["guard"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        top = np.array(t["parent"].is_null())
        names, place = np.unique(np.concatenate([t["node"].to_numpy(), t["parent"].fill_null(0).to_numpy()]), return_inverse=True)
        node, parent = of * len(names) + place[: len(of)], of * len(names) + place[len(of) :]
        order = np.argsort(node, kind="stable")
        above = order[np.minimum(np.searchsorted(node, parent, sorter=order), len(of) - 1)]
        hangs = ~top & (node[above] == parent)
        op = t["op"].to_numpy()
        inverts, conjoins, atom = op == "NOT", op == "AND", op == "ATOM"
        depth = np.where(top, 0, -1).astype(np.int32)
        positive, plain, spine = top.copy(), top.copy(), top.copy()
        level, front = 0, np.flatnonzero(hangs & (depth[above] == 0))
        while len(front):
            level, up = level + 1, above[front]
            depth[front] = level
            positive[front] = positive[up] ^ inverts[up]
            plain[front] = plain[up] & ~inverts[up]
            spine[front] = spine[up] & (conjoins[up] | (inverts[up] & atom[front]))
            front = np.flatnonzero(hangs & (depth < 0) & (depth[above] == level))
        found = np.flatnonzero(depth >= 0)
        below = np.bincount(above[found[depth[found] > 0]], minlength=len(of))
        more = {"depth": depth, "positive": positive, "plain": plain, "spine": spine, "below": below}
        for c, x in more.items():
            t = t.append_column(c, pa.array(x))
        yield from t.take(pa.array(found)).to_batches()


def levels(nodes: DataFrame) -> DataFrame:
    """Adds depth, positive (an even number of NOT above), plain (no NOT above), spine (only AND above, or a NOT right over the atom) and below, the number of children.

    A guard is read whole, so that the nodes move once, however deep the trees. Nodes that hang below no root are left out.
    """
    moved = nodes.repartition("guard").sortWithinPartitions("guard")
    shape = T.StructType([*nodes.schema.fields, *(T.StructField(c, t) for c, t in (("depth", T.IntegerType()), ("positive", T.BooleanType()), ("plain", T.BooleanType()), ("spine", T.BooleanType()), ("below", T.LongType())))])
    return written(moved.mapInArrow(_placed, shape))


def atoms(levelled: DataFrame, kind: str | None = None) -> DataFrame:
    """The atoms of the guards, of one kind if that is given."""
    return levelled.where("op = 'ATOM'") if kind is None else levelled.where((F.col("op") == "ATOM") & (F.col("kind") == kind))


def mentioned(levelled: DataFrame, kind: str = "OWN", positive: bool = True) -> DataFrame:
    """guard, var: what some atom of the guard asks for (or, under a negation, asks to be absent), wherever it stands."""
    return atoms(levelled, kind).where(F.col("positive") == positive).select("guard", "var").distinct()


def polarity(levelled: DataFrame, kind: str = "OWN") -> DataFrame:
    """guard, var, present, absent: whether the guard has the atom asked for, and whether it has it negated."""
    return atoms(levelled, kind).groupBy("guard", "var").agg(F.bool_or("positive").alias("present"), F.bool_or(~F.col("positive")).alias("absent"))


def literals(levelled: DataFrame) -> DataFrame:
    """guard, present, absent: the items that the guard asks for and those it asks to be absent, as sorted arrays."""
    own = atoms(levelled, "OWN")
    side = lambda p: F.sort_array(F.collect_set(F.when(p, F.col("var"))))
    return own.groupBy("guard").agg(side(F.col("positive")).alias("present"), side(~F.col("positive")).alias("absent"))


def folded(levelled: DataFrame, leaves: DataFrame) -> DataFrame:
    """guard, var, value: what holds whenever the guard does. leaves: guard, node, var, value, the values that an atom leaves a var.

    Where all children must hold (AND, or OR under a negation) a var keeps the values that every child constraining it allows; where
    one of them may (OR, or AND under a negation) it is constrained only if each child does, to the values of any. Rows of one
    level are joined to their parents and counted: no array of a node's children is ever built.
    """
    deepest = levelled.agg(F.max("depth")).first()[0]
    found = leaves.join(large(levelled.select("guard", "node", "parent", "depth")), ["guard", "node"])
    out = written(found.select("guard", "node", "parent", "depth", "var", "value"))
    inner = levelled.where("op <> 'ATOM'")
    all_hold = ((F.col("op") == "AND") == F.col("positive")) | (F.col("op") == "NOT")
    for depth in range(deepest or 0, 0, -1):
        up = out.where(F.col("depth") == depth)
        own = up.groupBy("guard", "parent", "var").agg(F.count_distinct("node").alias("constrain"))
        each = up.groupBy("guard", "parent", "var", "value").agg(F.count_distinct("node").alias("allow"))
        top = inner.where(F.col("depth") == depth - 1).select("guard", F.col("node").alias("parent"), F.col("parent").alias("_above"), all_hold.alias("all_hold"), "below")
        kept = each.join(own, ["guard", "parent", "var"]).join(large(top), ["guard", "parent"])
        kept = kept.where("if(all_hold, allow = constrain, constrain = below)")
        above = kept.select("guard", F.col("parent").alias("node"), F.col("_above").alias("parent"), F.lit(depth - 1).alias("depth"), "var", "value")
        out = written(out.where(F.col("depth") < depth).unionAll(above))
    return out.where("depth = 0").select("guard", "var", "value").distinct()


def required(levelled: DataFrame, kind: str = "OWN") -> DataFrame:
    """guard, var: what is held whenever the guard holds. AND unites and OR intersects, the other way round under NOT."""
    leaves = atoms(levelled, kind).where("positive").select("guard", "node", "var", F.lit(1).alias("value"))
    return folded(levelled, leaves).select("guard", "var")


def placed_required(levelled: DataFrame, placed: DataFrame) -> DataFrame:
    """guard, var: items that must have been put somewhere for the guard to hold. placed: var, value, where items are ever put."""
    leaves = atoms(levelled, "LOC").where("positive").join(placed, ["var", "value"], "left_semi").select("guard", "node", "var", F.lit(1).alias("value"))
    return folded(levelled, leaves).select("guard", "var")


def places(levelled: DataFrame) -> DataFrame:
    """guard, var, value: the places that the guard positively asks an item to be at."""
    return atoms(levelled, "LOC").where("positive").select("guard", "var", "value").distinct()


def comparisons(levelled: DataFrame) -> DataFrame:
    """guard, var, cmp, value, positive: every comparison of a register, wherever it stands."""
    return atoms(levelled, "CMP").select("guard", "var", "cmp", "value", "positive").distinct()


def spine(levelled: DataFrame) -> DataFrame:
    """guard, node, op: the top-level conjuncts, the nodes below ANDs alone that are no AND themselves (the root, if it is none)."""
    parents = large(levelled.where("op = 'AND'").select("guard", F.col("node").alias("parent"), F.col("op").alias("above"), F.col("spine").alias("straight")))
    found = levelled.where("op <> 'AND'").join(parents, ["guard", "parent"], "left")
    return found.where("parent is null or (straight and above = 'AND')").select("guard", "node", "op")


def _flipped() -> Column:
    """A comparison with the negations above it folded in."""
    pairs = F.create_map(*(F.lit(x) for pair in OPPOSITE.items() for x in pair))
    return F.when(F.col("positive"), F.col("cmp")).otherwise(F.try_element_at(pairs, F.col("cmp")))


def must_hold(levelled: DataFrame) -> DataFrame:
    """guard, var, cmp, value: what is asserted of registers on the AND spine, but for equality, with negations folded in."""
    held = atoms(levelled, "CMP").where("spine").select("guard", "var", _flipped().alias("cmp"), "value")
    return held.where("cmp <> '=='").distinct()


def must_equal(levelled: DataFrame) -> DataFrame:
    """guard, var, value: equalities on the AND spine, also as a negated inequality."""
    held = atoms(levelled, "CMP").where("spine").select("guard", "var", _flipped().alias("cmp"), "value")
    return held.where("cmp = '=='").select("guard", "var", "value").distinct()


def asserted(levelled: DataFrame) -> DataFrame:
    """guard, var, value: values that some atom asserts a register to equal, wherever it stands."""
    return atoms(levelled, "CMP").where(_flipped() == "==").select("guard", "var", "value").distinct()


def allowed_by_atoms(levelled: DataFrame, domain: DataFrame) -> DataFrame:
    """guard, node, var, value, spine: the values that each comparison leaves its register, with its negations folded in.

    domain: var, value, all values that a register can have. An equality allows its value, known or not. Other comparisons say
    nothing of a register without domain, nor if they exclude all of it or none.
    """
    held = atoms(levelled, "CMP").select("guard", "node", "var", "spine", _flipped().alias("cmp"), F.col("value").alias("against"))
    equal = held.where("cmp = '=='").select("guard", "node", "var", F.col("against").alias("value"), "spine")
    other = held.where("cmp <> '=='").join(domain, "var")
    holds = F.expr("case cmp when '!=' then value <> against when '<' then value < against when '<=' then value <= against when '>' then value > against when '>=' then value >= against end")
    size = domain.groupBy("var").agg(F.count_distinct("value").alias("all"))
    other = other.where(holds).select("guard", "node", "var", "value", "spine").distinct()
    some = other.groupBy("guard", "node", "var").agg(F.count(F.lit(1)).alias("n")).join(size, "var").where("n < all").select("guard", "node", "var")
    return equal.unionAll(other.join(some, ["guard", "node", "var"], "left_semi").select("guard", "node", "var", "value", "spine"))


def register_sets(levelled: DataFrame, domain: DataFrame) -> DataFrame:
    """guard, var, value: the values each register may have, all atoms read side by side: equalities from anywhere, the rest from the spine."""
    found = allowed_by_atoms(levelled, domain)
    return found.join(atoms(levelled, "CMP").select("guard", "node", _flipped().alias("as")), ["guard", "node"]).where("spine or as = '=='").select("guard", "var", "value").distinct()


def structural_sets(levelled: DataFrame, domain: DataFrame) -> DataFrame:
    """guard, var, value: the values each register has whenever the guard holds, by the structure of the tree."""
    return folded(levelled, allowed_by_atoms(levelled, domain).select("guard", "node", "var", "value"))


def contradictory(levelled: DataFrame) -> DataFrame:
    """guard: asks on its spine that one register equal two values, or a value that it must not equal."""
    held = atoms(levelled, "CMP").where("spine and cmp = '=='")
    equal, never = held.where("positive"), held.where("not positive").select("guard", "var", "value")
    twice = equal.groupBy("guard", "var").agg(F.count_distinct("value").alias("n")).where("n > 1").select("guard")
    return twice.union(equal.join(never, ["guard", "var", "value"]).select("guard")).distinct()


def opaque(levelled: DataFrame, known: tuple[str, ...] = ("OWN", "CMP", "LOC", "IPROP", "POS")) -> DataFrame:
    """guard: holds an atom that is not modelled, and so can't be negated safely."""
    return atoms(levelled).where(~F.col("kind").isin(*known)).select("guard").distinct()


def about(levelled: DataFrame, variables: DataFrame, kind: str = "CMP") -> DataFrame:
    """guard: tests one of the given variables (var), for instance those of a debugger."""
    return atoms(levelled, kind).join(variables, "var", "left_semi").select("guard").distinct()


def negated(levelled: DataFrame) -> DataFrame:
    """The same trees negated: AND and OR change places where no NOT stands above.

    A NOT that is reached so gives its place to its child, as that was; an atom that is reached so gets a NOT over it (numbered
    below 0), so no two NOTs come to stand over each other.
    """
    gone = levelled.where("plain and op = 'NOT'").select("guard", F.col("node").alias("parent"), F.col("parent").alias("_up"), F.lit(True).alias("_lifted"))
    left = levelled.where("not (plain and op = 'NOT')").join(gone, ["guard", "parent"], "left")
    over, lifted = F.col("plain") & (F.col("op") == "ATOM"), F.col("_lifted").isNotNull()
    parent = F.when(over, -F.col("node") - 1).when(lifted, F.col("_up")).otherwise(F.col("parent"))
    op = F.when(F.col("plain") & (F.col("op") == "AND"), "OR").when(F.col("plain") & (F.col("op") == "OR"), "AND").otherwise(F.col("op"))
    own = left.select("guard", "node", parent.alias("parent"), op.alias("op"), "kind", "var", "cmp", "value")
    none = [F.lit(None).cast(t).alias(c) for c, t in levelled.select("kind", "var", "cmp", "value").dtypes]
    return own.unionAll(left.where(over).select("guard", (-F.col("node") - 1).alias("node"), "parent", F.lit("NOT").alias("op"), *none))


def texts(levelled: DataFrame) -> DataFrame:
    """guard, node, text: each subtree as one text, its children in order of their texts, so that equal guards have equal texts."""
    shown = F.concat_ws(" ", "kind", "var", "cmp", F.col("value").cast("string"))
    done = written(levelled.where("op = 'ATOM'").select("guard", "node", "parent", "depth", F.concat(F.lit("("), shown, F.lit(")")).alias("text")))
    inner = levelled.where("op <> 'ATOM'")
    for depth in range(levelled.agg(F.max("depth")).first()[0] or 0, -1, -1):
        kids = done.where(F.col("depth") == depth + 1).groupBy("guard", F.col("parent").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("kids"))
        own = inner.where(F.col("depth") == depth).join(kids, ["guard", "node"], "left")
        done = written(done.unionAll(own.select("guard", "node", "parent", "depth", F.concat(F.lit("("), F.lower("op"), F.lit(" "), F.coalesce("kids", F.lit("")), F.lit(")")).alias("text"))))
    return done.select("guard", "node", "text")


def complementary(levelled: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b of guards) of which one is the NOT of the other, as written."""
    whole = texts(levelled).join(levelled.select("guard", "node", "parent", "op"), ["guard", "node"])
    root = whole.where("parent is null").select("guard", "node", "op", "text")
    below = whole.select("guard", F.col("parent").alias("node"), F.col("text").alias("kid"))
    nots = root.where("op = 'NOT'").join(below, ["guard", "node"]).select("guard", "kid")
    one = pairs.join(root.select(F.col("guard").alias("a"), F.col("text").alias("kid")), "a").join(nots.withColumnRenamed("guard", "b"), ["b", "kid"])
    two = pairs.join(root.select(F.col("guard").alias("b"), F.col("text").alias("kid")), "b").join(nots.withColumnRenamed("guard", "a"), ["a", "kid"])
    return one.select("a", "b").union(two.select("a", "b")).distinct()


def exclusive(levelled: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of guards of which one asks on its spine for an atom that the other's spine negates."""
    held = atoms(levelled).where("spine").select("guard", "positive", "kind", "var", "cmp", "value")
    key = ["kind", "var", "cmp", "value"]
    plus, minus = held.where("positive").drop("positive"), held.where("not positive").drop("positive")

    def clash(p: str, m: str) -> DataFrame:
        left = pairs.join(plus.withColumnRenamed("guard", p), p).alias("l")
        right = minus.withColumnRenamed("guard", m).alias("r")
        same = reduce(lambda x, y: x & y, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key), F.col(f"l.{m}") == F.col(f"r.{m}"))
        return left.join(right, same, "left_semi").select("a", "b")

    return clash("a", "b").union(clash("b", "a")).distinct()


def falsified(levelled: DataFrame, writes: DataFrame) -> DataFrame:
    """guard: has a conjunct on its spine, an equality or inequality, that no value written to its register satisfies.

    writes: guard, var, value, everything that is written before the guard is met. Registers that are not written decide nothing.
    """
    held = atoms(levelled, "CMP").where("spine").select("guard", "node", "var", _flipped().alias("cmp"), F.col("value").alias("against")).where("cmp in ('==', '!=')")
    met = held.join(writes, ["guard", "var"]).groupBy("guard", "node").agg(F.bool_or((F.col("value") == F.col("against")) == (F.col("cmp") == "==")).alias("can"))
    return met.where("not can").select("guard").distinct()


def counters_contradict(levelled: DataFrame, known: DataFrame) -> DataFrame:
    """guard: demands of a counter, where all its conjuncts must hold, what its known value is not. known: guard, var, value."""
    held = atoms(levelled, "CTR").where("spine and cmp in ('==', '!=')").select("guard", "var", _flipped().alias("cmp"), F.col("value").alias("against"))
    return held.join(known, ["guard", "var"]).where("(value = against) <> (cmp = '==')").select("guard").distinct()


def counters_hold(tests: DataFrame, counters: DataFrame, unknown: bool = True) -> DataFrame:
    """tests with holds: whether each comparison of a counter holds. tests: run, var, cmp, against; counters: run, var, value, written.

    A counter that the run never wrote is 0; one that it wrote with a value that can't be told (null) answers ``unknown``.
    """
    found = tests.join(counters.select("run", "var", "value", F.lit(True).alias("_there")), ["run", "var"], "left")
    now = F.when(F.col("_there").isNull(), F.lit(0)).otherwise(F.col("value"))
    holds = compared(now, F.col("cmp"), F.col("against"))
    return found.withColumn("holds", F.when(now.isNull(), F.lit(unknown)).otherwise(holds)).drop("value", "_there")


def compared(left: Column, cmp: Column, right: Column) -> Column:
    """A comparison named by a text; an unknown name is true."""
    out = F.lit(True)
    for name, test in (("==", left == right), ("!=", left != right), ("<", left < right), ("<=", left <= right), (">", left > right), (">=", left >= right)):
        out = F.when(cmp == name, test).otherwise(out)
    return out


def room_demands(levelled: DataFrame, here: str) -> DataFrame:
    """guard, value: the rooms in one of which the player must be for the guard to hold, read from equalities of the register ``here``.

    An OR tells rooms only if each child does, an AND by the children that do, and a NOT tells nothing.
    """
    below_not = atoms(levelled, "CMP").where((F.col("var") == here) & (F.col("cmp") == "==") & F.col("plain"))
    return folded(levelled.withColumn("positive", F.lit(True)), below_not.select("guard", "node", "var", "value")).select("guard", "value")


def elsewhere(levelled: DataFrame, here: str, rooms: DataFrame) -> DataFrame:
    """guard, room: the guard can't hold in a room, as it asks to be in others. rooms: guard, room, where each guard was met."""
    asks = room_demands(levelled, here)
    return rooms.join(asks.select("guard").distinct(), "guard", "left_semi").join(asks.withColumnRenamed("value", "room"), ["guard", "room"], "left_anti").distinct()


def fold_demands(levelled: DataFrame, placed: DataFrame) -> DataFrame:
    """guard, node, var, value: negated places on the spine, as groups (by node) of which one is demanded of whoever arrives.

    A group is a NOT over a place, or over an OR of places alone; each place must be one where its item is ever put (placed: var, value).
    """
    tops = spine(levelled).where("op = 'NOT'").select("guard", "node")
    kid = large(levelled.where("parent is not null").select("guard", F.col("node").alias("kid"), F.col("parent").alias("node"), "op", "kind", "var", "value"))
    one = tops.join(kid, ["guard", "node"])
    direct = one.where("op = 'ATOM'").select("guard", "node", "kind", "var", "value")
    several = one.where("op = 'OR'").select("guard", F.col("node").alias("top"), F.col("kid").alias("node"))
    several = large(several).join(kid.select("guard", "node", F.col("op").alias("_op"), "kind", "var", "value"), ["guard", "node"])
    several = several.select("guard", F.col("top").alias("node"), F.when(F.col("_op") == "ATOM", F.col("kind")).otherwise("-").alias("kind"), "var", "value")
    each = direct.unionAll(several).join(placed.select("var", "value", F.lit(True).alias("_put")).distinct(), ["var", "value"], "left")
    good = each.groupBy("guard", "node").agg(F.bool_and((F.col("kind") == "LOC") & F.col("_put").isNotNull()).alias("good")).where("good").select("guard", "node")
    return each.join(large(good), ["guard", "node"], "left_semi").select("guard", "node", "var", "value").distinct()


def satisfiable(levelled: DataFrame, facts: DataFrame) -> DataFrame:
    """guard, holds: whether the guard can hold, where unknown atoms may be either.

    facts: guard, node, holds (null: unknown) for each atom. Unknown stays unknown under NOT, drops out of AND and makes OR true; what is
    unknown at the root can hold. That is not SQL's NULL, under which an OR of false and unknown would not be true.
    """
    leaf = atoms(levelled).join(facts, ["guard", "node"], "left")
    value = F.when(F.col("holds").isNull(), "?").when(F.col("holds") == F.col("positive"), "1").otherwise("0")
    out = written(leaf.select("guard", "node", "parent", "depth", value.alias("is")))
    inner = levelled.where("op <> 'ATOM'")
    both = (F.col("op") == "AND") == F.col("positive")
    for depth in range(levelled.agg(F.max("depth")).first()[0] or 0, 0, -1):
        kids = out.where(F.col("depth") == depth).groupBy("guard", F.col("parent").alias("node")).agg(F.bool_or(F.col("is") == "0").alias("false"), F.bool_or(F.col("is") != "0").alias("open"), F.first("is").alias("only"))
        own = inner.where(F.col("depth") == depth - 1).join(kids, ["guard", "node"], "left")
        up = F.when(F.col("op") == "NOT", F.coalesce("only", F.lit("?"))).when(both, F.when(F.col("false"), "0").otherwise("1")).otherwise(F.when(F.col("open"), "1").otherwise("0"))
        out = written(out.where(F.col("depth") < depth).unionAll(own.select("guard", "node", "parent", "depth", up.alias("is"))))
    return out.where("depth = 0").select("guard", (F.col("is") != "0").alias("holds"))


def any_of_guards(sites: DataFrame) -> DataFrame:
    """site, free, guards: the alternatives of a site, sorted; free (and none) if it has no condition or one of them asks nothing (null)."""
    found = sites.groupBy("site").agg(F.bool_or(F.col("guard").isNull()).alias("free"), F.sort_array(F.collect_set("guard")).alias("guards"))
    return found.select("site", "free", F.when(F.col("free"), F.array().cast(dict(found.dtypes)["guards"])).otherwise(F.col("guards")).alias("guards"))
