"""Guards as arrays: a guard is an array of alternatives, an alternative an array of the items it asks for.

No alternative at all means that nothing is known, and a guard of which nothing is known is open; an empty alternative is free.
Arrays in results are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body) -> Column:
    """body(value), with the value computed once: an expression that stands at several places, or inside a lambda, is computed at each of them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocked(alts: Column, banned: Column) -> Column:
    """Whether every alternative asks for a banned item; false without alternatives, or where the guard is null."""
    return F.coalesce((F.size(alts) > 0) & F.forall(alts, lambda a: F.arrays_overlap(a, banned)), F.lit(False))


def within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def minimal(alts: Column) -> Column:
    """The alternatives that hold no other one: what absorbs the rest."""
    return once(F.array_distinct(F.transform(alts, lambda a: F.array_sort(a))), lambda alts: F.array_sort(F.filter(alts, lambda a: ~F.exists(alts, lambda b: (b != a) & within(b, a)))))


def common(alts: Column) -> Column:
    """The items that every alternative asks for."""
    return F.array_sort(F.aggregate(F.slice(alts, 2, F.greatest(F.size(alts), F.lit(1))), F.element_at(alts, 1), lambda x, a: F.array_intersect(x, a)))


def residue(alts: Column) -> Column:
    """The alternatives without what is common to all."""
    return once(alts, lambda alts: once(common(alts), lambda shared: F.array_sort(F.array_distinct(F.transform(alts, lambda a: F.array_sort(F.array_except(a, shared)))))))


def mentioned(alts: Column) -> Column:
    """The items that some alternative asks for."""
    return F.array_sort(F.array_distinct(F.flatten(alts)))


def conjoined(left: Column, right: Column) -> Column:
    """Both guards: the union of each pair of alternatives, minimal."""
    return minimal(F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.array_union(a, b)))))


def all_of(values: Column) -> Column:
    """Conjunction of three-valued conditions (null: unknown): what is unknown drops out, so it is true unless something is false."""
    return ~F.exists(values, lambda v: F.coalesce(~v, F.lit(False)))


def any_of(values: Column) -> Column:
    """Disjunction of three-valued conditions: anything unknown makes it true."""
    return F.exists(values, lambda v: F.coalesce(v, F.lit(True)))


def absorbed(alts: Column) -> Column:
    """Alternatives (present, absent) without the absences that an ordered choice leaves behind: of items that another one asks for."""
    asked = lambda alts: F.flatten(F.transform(alts, lambda a: a["present"]))
    left = lambda asked: lambda a: F.struct(F.array_sort(a["present"]).alias("present"), F.array_sort(F.array_except(a["absent"], asked)).alias("absent"))
    return once(alts, lambda alts: once(asked(alts), lambda said: F.transform(alts, left(said))))


def factored(alts: Column) -> Column:
    """present, absent: what all alternatives have in common once absorbed; rest: what else each has, sorted, without those that have nothing."""
    side = lambda alts, name: common(F.transform(alts, lambda a: a[name]))

    def parts(alts: Column, shared: Column) -> Column:
        left = F.transform(alts, lambda a: F.struct(*(F.array_sort(F.array_except(a[c], shared[c])).alias(c) for c in ("present", "absent"))))
        rest = F.array_sort(F.array_distinct(F.filter(left, lambda r: (F.size(r["present"]) > 0) | (F.size(r["absent"]) > 0))))
        return F.struct(shared["present"].alias("present"), shared["absent"].alias("absent"), rest.alias("rest"))

    return once(absorbed(alts), lambda alts: once(F.struct(*(side(alts, c).alias(c) for c in ("present", "absent"))), lambda shared: parts(alts, shared)))


def _joined(terms: Column, word: str) -> Column:
    return once(terms, lambda terms: F.when(F.size(terms) == 1, F.try_element_at(terms, F.lit(1))).otherwise(F.concat(F.lit(f"({word} "), F.array_join(terms, " "), F.lit(")"))))


def rendered(parts: Column, holds: str) -> Column:
    """A factored guard as a symbolic expression; null if it asks nothing. holds: how the test of one item is spelled."""
    before, after = (F.lit(x) for x in holds.split("{}"))
    has = lambda items: F.transform(items, lambda x: F.concat(before, x, after))
    lacks = lambda items: F.transform(items, lambda x: F.concat(F.lit("(not "), before, x, after, F.lit(")")))

    def whole(parts: Column) -> Column:
        ways = F.array_sort(F.array_distinct(F.transform(parts["rest"], lambda r: _joined(F.concat(has(r["present"]), lacks(r["absent"])), "and"))))
        either = once(ways, lambda ways: F.when(F.size(ways) > 0, F.array(_joined(ways, "or"))).otherwise(F.array().cast("array<string>")))
        return once(F.concat(has(parts["present"]), lacks(parts["absent"]), either), lambda terms: F.when(F.size(terms) > 0, _joined(terms, "and")))

    return once(parts, whole)


def in_rectangle(x: Column, y: Column, left: Column, top: Column, right: Column, bottom: Column, width: int = 320, height: int = 190) -> Column:
    """Whether a point lies in a rectangle; a side at or beyond the screen's border bounds nothing."""
    return ((left <= 0) | (x >= left)) & ((right >= width - 1) | (x <= right)) & ((top <= 0) | (y >= top)) & ((bottom >= height - 1) | (y <= bottom))


def at_edge(x: Column, y: Column, code: Column, margin: int = 4, width: int = 320, height: int = 190) -> Column:
    """Whether a point is at the edge of the screen that a code names (1 top, 2 right, 3 bottom, 4 left); other codes may be anywhere."""
    near = F.when(code == 1, y <= margin).when(code == 2, x >= width - margin).when(code == 3, y >= height - margin)
    return near.when(code == 4, x <= margin).otherwise(F.lit(True))


def membership(tests):
    """guard nodes for (guard, var, values): the register is one of the values: an OR of equalities, or one equality alone."""
    none = [F.lit(None).cast("string").alias(c) for c in ("kind", "var", "cmp")] + [F.lit(None).cast("int").alias("value")]
    alone = F.size("values") == 1
    top = tests.where(~alone).select("guard", F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit("OR").alias("op"), *none)
    each = tests.select("guard", "var", alone.alias("alone"), F.posexplode("values").alias("k", "value"))
    parent = F.when(~F.col("alone"), F.lit(0)).cast("long").alias("parent")
    return top.unionAll(each.select("guard", (F.col("k") + 1).cast("long").alias("node"), parent, F.lit("ATOM").alias("op"), F.lit("CMP").alias("kind"), "var", F.lit("==").alias("cmp"), F.col("value").cast("int").alias("value")))
