"""Readings of guards over the guard trees of the derived model, and the SQL that gives the same rows.

The SQL knows the shape of the trees (see sources.star.guard_nodes) and folds them by hand: atoms g, f, kind, var, cmp, val.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions import guards
from karst.operators import guard_trees as T
from karst.plans.fixpoint import shared
from karst.plans.registry import query
from karst.sources import star

_ATOMS = """
raw AS (SELECT DISTINCT l_orderkey g, l_returnflag f,
  CASE WHEN l_linenumber <= 2 THEN 'OWN' WHEN l_linenumber <= 5 THEN 'CMP' WHEN l_linenumber = 6 THEN 'LOC' WHEN l_linestatus = 'F' THEN 'OPAQUE' ELSE 'CTR' END kind,
  CASE WHEN l_linenumber <= 2 OR l_linenumber = 6 THEN 'i' || (l_partkey % 9) WHEN l_linenumber <= 5 THEN 'r' || (l_suppkey % 3) WHEN l_linestatus <> 'F' THEN 'c' || (l_suppkey % 2) END var,
  CASE WHEN l_linenumber = 3 THEN '==' WHEN l_linenumber = 4 THEN '!=' WHEN l_linenumber = 5 THEN CASE WHEN l_suppkey % 2 = 0 THEN '<' ELSE '>=' END WHEN l_linenumber = 6 THEN 'ownedBy' WHEN l_linenumber > 6 AND l_linestatus <> 'F' THEN '==' END cmp,
  (CASE WHEN l_linenumber = 6 THEN l_suppkey % 5 WHEN l_linenumber BETWEEN 3 AND 5 OR l_linenumber > 6 AND l_linestatus <> 'F' THEN l_quantity::BIGINT % 4 END)::INT val FROM lineitem),
counted AS (SELECT *, f <> 'R' pos, count(*) OVER (PARTITION BY g, f) many FROM raw),
atom AS (SELECT *, g % 2 = 0 AND (f = 'N' OR f = 'R' AND many = 1) spine,
  CASE WHEN pos THEN cmp ELSE CASE cmp WHEN '==' THEN '!=' WHEN '!=' THEN '==' WHEN '<' THEN '>=' WHEN '>=' THEN '<' END END fc FROM counted),
dom AS (SELECT DISTINCT var, val v FROM raw WHERE kind = 'CMP'),
some_ AS (SELECT a.*, d.v FROM atom a JOIN dom d USING (var) WHERE kind = 'CMP' AND CASE fc WHEN '!=' THEN d.v <> val WHEN '<' THEN d.v < val WHEN '>=' THEN d.v >= val END),
allowed AS (SELECT g, f, cmp, val, var, val v, spine, fc FROM atom WHERE kind = 'CMP' AND fc = '=='
  UNION ALL SELECT g, f, cmp, val, var, v, spine, fc FROM some_ WHERE fc <> '==' AND (g, f, cmp, val, var) IN (SELECT (g, f, cmp, val, var) FROM (SELECT g, f, cmp, val, var, count(*) n FROM some_ GROUP BY ALL) JOIN (SELECT var, count(*) whole FROM dom GROUP BY var) USING (var) WHERE n < whole)),
put AS (SELECT DISTINCT 'i' || (l_partkey % 9) var, (l_suppkey % 5)::INT val FROM lineitem WHERE l_quantity = 7 AND l_suppkey % 5 < 2)
"""


def _folded(leaf: str, groups: str = "f = 'A'") -> str:
    """Relations that fold leaf(g, f, cmp, val, var, v) to fold(g, var, v); groups: those where any child may hold."""
    return f""", leaf AS ({leaf}),
    per AS (SELECT g, f, var, v, count(DISTINCT (cmp, val)) allow FROM leaf GROUP BY ALL),
    own AS (SELECT g, f, var, count(DISTINCT (cmp, val)) cons FROM leaf GROUP BY ALL),
    grp AS (SELECT g, f, count(*) kids FROM raw GROUP BY ALL),
    gv AS (SELECT g, f, var, v FROM per JOIN own USING (g, f, var) JOIN grp USING (g, f) WHERE CASE WHEN {groups} THEN cons = kids ELSE allow = cons END),
    fold AS (SELECT g, var, v FROM (SELECT g, var, v, count(*) allow FROM gv GROUP BY ALL) JOIN (SELECT g, var, count(DISTINCT f) cons FROM gv GROUP BY ALL) USING (g, var) JOIN (SELECT g, count(*) kids FROM grp GROUP BY ALL) USING (g)
      WHERE CASE WHEN g % 2 = 0 THEN allow = cons ELSE cons = kids END) """


def _levelled(spark, d) -> DataFrame:
    return shared(spark, d, "guards", lambda: T.levels(star.guard_nodes(spark, d)))


def _domain(levelled: DataFrame) -> DataFrame:
    return T.atoms(levelled, "CMP").select("var", "value").distinct()


def _placed(spark, d) -> DataFrame:
    items = star.table(spark, d, "lineitem").where("l_quantity = 7 and l_suppkey % 5 < 2")
    return items.select(F.concat(F.lit("i"), (F.col("l_partkey") % 9).cast("string")).alias("var"), (F.col("l_suppkey") % 5).cast("int").alias("value")).distinct()


@query("SELECT DISTINCT g AS guard, var FROM atom WHERE kind = 'OWN' AND pos", _ATOMS)
def guard_mentions(spark, d):
    return T.mentioned(_levelled(spark, d))


@query("SELECT DISTINCT g AS guard, var FROM atom WHERE kind = 'OWN' AND NOT pos", _ATOMS)
def guard_absences(spark, d):
    return T.mentioned(_levelled(spark, d), positive=False)


@query("SELECT g AS guard, var, bool_or(pos) present, bool_or(NOT pos) AS absent FROM atom WHERE kind = 'OWN' GROUP BY 1, 2", _ATOMS)
def guard_polarity(spark, d):
    return T.polarity(_levelled(spark, d))


@query("SELECT g AS guard, array_to_string(list_sort(coalesce(list(DISTINCT var) FILTER (WHERE pos), [])), ',') present, array_to_string(list_sort(coalesce(list(DISTINCT var) FILTER (WHERE NOT pos), [])), ',') AS absent FROM atom WHERE kind = 'OWN' GROUP BY 1", _ATOMS)
def guard_literals(spark, d):
    return T.literals(_levelled(spark, d)).select("guard", F.array_join("present", ",").alias("present"), F.array_join("absent", ",").alias("absent"))


@query("SELECT DISTINCT g AS guard, var FROM fold", _ATOMS + _folded("SELECT g, f, coalesce(cmp, '') cmp, coalesce(val, 0) || var val, var, 1 v FROM atom WHERE kind = 'OWN' AND pos"))
def guard_requirements(spark, d):
    return T.required(_levelled(spark, d))


@query("SELECT DISTINCT g AS guard, var FROM fold", _ATOMS + _folded("SELECT g, f, cmp, val || var val, var, 1 v FROM atom WHERE kind = 'LOC' AND pos AND (var, val) IN (SELECT (var, val) FROM put)"))
def guard_placements(spark, d):
    return T.placed_required(_levelled(spark, d), _placed(spark, d))


@query("SELECT DISTINCT g AS guard, var, val AS value FROM atom WHERE kind = 'LOC' AND pos", _ATOMS)
def guard_places(spark, d):
    return T.places(_levelled(spark, d))


@query("SELECT DISTINCT g AS guard, var, cmp, val AS value, pos positive FROM atom WHERE kind = 'CMP'", _ATOMS)
def guard_comparisons(spark, d):
    return T.comparisons(_levelled(spark, d))


@query(
    """SELECT guard, op, count(*) n FROM (SELECT DISTINCT g AS guard, 'OR' op, '' x FROM raw WHERE g % 2 = 1 UNION ALL SELECT DISTINCT g, CASE f WHEN 'A' THEN 'OR' ELSE 'NOT' END, f FROM raw WHERE g % 2 = 0 AND f <> 'N'
    UNION ALL SELECT g, 'ATOM', '' FROM raw WHERE g % 2 = 0 AND f = 'N') GROUP BY 1, 2""",
    _ATOMS,
)
def guard_spine(spark, d):
    return T.spine(_levelled(spark, d)).groupBy("guard", "op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT g AS guard, var, fc cmp, val AS value FROM atom WHERE kind = 'CMP' AND spine AND fc <> '=='", _ATOMS)
def guard_must_hold(spark, d):
    return T.must_hold(_levelled(spark, d))


@query("SELECT DISTINCT g AS guard, var, val AS value FROM atom WHERE kind = 'CMP' AND spine AND fc = '=='", _ATOMS)
def guard_must_equal(spark, d):
    return T.must_equal(_levelled(spark, d))


@query("SELECT DISTINCT g AS guard, var, val AS value FROM atom WHERE kind = 'CMP' AND fc = '=='", _ATOMS)
def guard_asserts(spark, d):
    return T.asserted(_levelled(spark, d))


@query("SELECT DISTINCT g AS guard, var, v AS value FROM allowed WHERE spine OR fc = '=='", _ATOMS)
def register_demands(spark, d):
    levelled = _levelled(spark, d)
    return T.register_sets(levelled, _domain(levelled))


@query("SELECT DISTINCT g AS guard, var, v AS value FROM fold", _ATOMS + _folded("SELECT DISTINCT g, f, cmp, val || var val, var, v FROM allowed"))
def structural_demands(spark, d):
    levelled = _levelled(spark, d)
    return T.structural_sets(levelled, _domain(levelled))


@query(
    """SELECT g AS guard FROM atom WHERE kind = 'CMP' AND cmp = '==' AND spine AND pos GROUP BY g, var HAVING count(DISTINCT val) > 1
    UNION SELECT a.g FROM atom a JOIN atom b ON a.g = b.g AND a.var = b.var AND a.val = b.val AND a.kind = 'CMP' AND b.kind = 'CMP' AND a.cmp = '==' AND b.cmp = '==' AND a.spine AND b.spine AND a.pos AND NOT b.pos""",
    _ATOMS,
)
def contradictory_guards(spark, d):
    return T.contradictory(_levelled(spark, d))


@query("SELECT DISTINCT g AS guard FROM raw WHERE kind IN ('OPAQUE', 'CTR')", _ATOMS)
def opaque_guards(spark, d):
    return T.opaque(_levelled(spark, d))


@query("SELECT DISTINCT g AS guard FROM raw WHERE kind = 'CMP' AND var = 'r0'", _ATOMS)
def debug_guards(spark, d):
    return T.about(_levelled(spark, d), spark.createDataFrame([("r0",)], "var string"))


@query("SELECT DISTINCT g AS guard FROM raw WHERE kind = 'CMP' AND var = 'r1' AND cmp = '==' AND val IN (1, 3)", _ATOMS)
def edge_code_guards(spark, d):
    levelled = _levelled(spark, d)
    return T.about(levelled.where("cmp = '==' and value in (1, 3)"), spark.createDataFrame([("r1",)], "var string"))


@query(
    """SELECT guard, op, count(*) n FROM (SELECT DISTINCT g AS guard, CASE WHEN g % 2 = 0 THEN 'OR' ELSE 'AND' END op, 0 x, '' y, '' z FROM raw
    UNION ALL SELECT DISTINCT g, CASE f WHEN 'A' THEN 'AND' WHEN 'N' THEN 'OR' ELSE CASE many WHEN 1 THEN '-' ELSE 'OR' END END, 0, f, '' FROM counted
    UNION ALL SELECT g, 'NOT', 0, '', '' FROM raw WHERE f <> 'R' UNION ALL SELECT g, 'ATOM', 0, '', '' FROM raw) WHERE op <> '-' GROUP BY 1, 2""",
    _ATOMS,
)
def negated_guards(spark, d):
    return T.negated(_levelled(spark, d)).groupBy("guard", "op").agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark, d) -> DataFrame:
    keys = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("a"))
    return keys.join(keys.select((F.col("a") - 2).alias("a")), "a").select("a", (F.col("a") + 2).alias("b"))


@query(
    """SELECT DISTINCT x.g a, y.g b FROM atom x JOIN atom y ON abs(x.g - y.g) = 2 AND x.spine AND y.spine AND x.pos AND NOT y.pos AND x.kind = y.kind AND x.var IS NOT DISTINCT FROM y.var AND x.cmp IS NOT DISTINCT FROM y.cmp AND x.val IS NOT DISTINCT FROM y.val WHERE x.g < y.g AND x.g IN (SELECT o_orderkey FROM orders) AND y.g IN (SELECT o_orderkey FROM orders)
    UNION SELECT DISTINCT y.g, x.g FROM atom x JOIN atom y ON abs(x.g - y.g) = 2 AND x.spine AND y.spine AND x.pos AND NOT y.pos AND x.kind = y.kind AND x.var IS NOT DISTINCT FROM y.var AND x.cmp IS NOT DISTINCT FROM y.cmp AND x.val IS NOT DISTINCT FROM y.val WHERE y.g < x.g AND x.g IN (SELECT o_orderkey FROM orders) AND y.g IN (SELECT o_orderkey FROM orders)""",
    _ATOMS,
)
def exclusive_guards(spark, d):
    return T.exclusive(_levelled(spark, d), _pairs(spark, d))


@query(
    """SELECT DISTINCT g AS guard FROM (SELECT a.g, a.f, a.cmp, a.val, a.var, bool_or((w.v = a.val) = (a.fc = '==')) can FROM atom a JOIN (SELECT DISTINCT l_orderkey g, 'r' || (l_partkey % 3) var, l_linenumber % 4 v FROM lineitem) w ON w.g = a.g AND w.var = a.var
    WHERE a.kind = 'CMP' AND a.spine AND a.fc IN ('==', '!=') GROUP BY ALL) WHERE NOT can""",
    _ATOMS,
)
def falsified_guards(spark, d):
    writes = star.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("guard"), F.concat(F.lit("r"), (F.col("l_partkey") % 3).cast("string")).alias("var"), (F.col("l_linenumber") % 4).alias("value")).distinct()
    return T.falsified(_levelled(spark, d), writes)


@query("SELECT DISTINCT g AS guard FROM atom WHERE kind = 'CTR' AND spine AND (g % 3 = val) <> (fc = '==')", _ATOMS)
def counter_contradictions(spark, d):
    levelled = _levelled(spark, d)
    known = levelled.select("guard").distinct().select("guard", F.explode(F.array(F.lit("c0"), F.lit("c1"))).alias("var"), (F.col("guard") % 3).cast("int").alias("value"))
    return T.counters_contradict(levelled, known)


@query(
    """SELECT e.event_id, CASE WHEN c.user_id IS NOT NULL AND c.v IS NULL THEN true ELSE CASE e.event_id % 6 WHEN 0 THEN coalesce(c.v, 0) = e.event_id % 3 WHEN 1 THEN coalesce(c.v, 0) <> e.event_id % 3 WHEN 2 THEN coalesce(c.v, 0) < e.event_id % 3 WHEN 3 THEN coalesce(c.v, 0) <= e.event_id % 3 WHEN 4 THEN coalesce(c.v, 0) > e.event_id % 3 ELSE coalesce(c.v, 0) >= e.event_id % 3 END END holds
    FROM events e LEFT JOIN (SELECT user_id, event_type, CASE WHEN count(*) % 5 > 0 THEN count(*) % 3 END v FROM events WHERE event_type <> 'view' GROUP BY 1, 2) c ON c.user_id = e.user_id AND c.event_type = e.event_type"""
)
def counter_tests(spark, d):
    events = star.table(spark, d, "events").select("event_id", F.col("user_id").alias("run"), F.col("event_type").alias("var"))
    names = F.array(*(F.lit(x) for x in ("==", "!=", "<", "<=", ">", ">=")))
    tests = events.withColumn("cmp", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int"))).withColumn("against", F.col("event_id") % 3)
    counters = events.where("var <> 'view'").groupBy("run", "var").agg(F.count(F.lit(1)).alias("n"))
    counters = counters.select("run", "var", F.when(F.col("n") % 5 > 0, F.col("n") % 3).alias("value"))
    return T.counters_hold(tests, counters).select("event_id", "holds")


_ROOMS = _ATOMS + _folded("SELECT g, f, cmp, val || var val, var, val v FROM atom WHERE kind = 'CMP' AND var = 'r0' AND cmp = '==' AND pos")


@query("SELECT DISTINCT g AS guard, v AS value FROM fold", _ROOMS)
def room_demands(spark, d):
    return T.room_demands(_levelled(spark, d), "r0")


@query("SELECT DISTINCT l_orderkey guard, (l_suppkey % 4)::INT room FROM lineitem WHERE l_orderkey IN (SELECT g FROM fold) AND (l_orderkey, l_suppkey % 4) NOT IN (SELECT (g, v) FROM fold)", _ROOMS)
def impossible_rooms(spark, d):
    rooms = star.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("guard"), (F.col("l_suppkey") % 4).cast("int").alias("room")).distinct()
    return T.elsewhere(_levelled(spark, d), "r0", rooms)


@query(
    """SELECT DISTINCT g AS guard, var, val AS value FROM atom a WHERE f = 'R' AND g % 2 = 0 AND NOT EXISTS (SELECT 1 FROM atom b WHERE b.g = a.g AND b.f = 'R' AND (b.kind <> 'LOC' OR (b.var, b.val) NOT IN (SELECT (var, val) FROM put)))""",
    _ATOMS,
)
def owner_fold_demands(spark, d):
    return T.fold_demands(_levelled(spark, d), _placed(spark, d)).select("guard", "var", "value").distinct()


@query(
    """SELECT g AS guard, CASE WHEN g % 2 = 0 THEN bool_and(open_) ELSE bool_or(open_) END holds FROM (
    SELECT g, f, CASE WHEN f = 'A' THEN bool_or(h IS NULL OR h = pos) ELSE bool_and(h IS NULL OR h = pos) END open_ FROM (
    SELECT *, CASE WHEN kind = 'OWN' THEN var IN ('i0', 'i1', 'i2', 'i3') WHEN kind = 'CMP' AND var <> 'r2' THEN CASE cmp WHEN '==' THEN k = val WHEN '!=' THEN k <> val WHEN '<' THEN k < val ELSE k >= val END WHEN var = 'c0' THEN val = 0 END h
    FROM (SELECT *, CASE var WHEN 'r0' THEN 1 WHEN 'r1' THEN 2 END k FROM atom)) GROUP BY g, f) GROUP BY g""",
    _ATOMS,
)
def satisfiable_guards(spark, d):
    levelled = _levelled(spark, d)
    atoms, var = T.atoms(levelled), F.col("var")
    constant = F.when(var == "r0", 1).when(var == "r1", 2)
    holds = F.when(F.col("kind") == "OWN", var.isin("i0", "i1", "i2", "i3")).when((F.col("kind") == "CMP") & (var != "r2"), T.compared(constant, F.col("cmp"), F.col("value"))).when(var == "c0", F.col("value") == 0)
    return T.satisfiable(levelled, atoms.select("guard", "node", holds.alias("holds")))


@query("SELECT site, free, CASE WHEN free THEN '' ELSE x END guards FROM (SELECT l_partkey site, bool_or(l_tax < 0.005) free, array_to_string(list_sort(list(DISTINCT l_orderkey) FILTER (WHERE l_tax >= 0.005)), ',') x FROM lineitem GROUP BY 1)")
def alternative_sites(spark, d):
    sites = star.table(spark, d, "lineitem").select(F.col("l_partkey").alias("site"), F.when(F.col("l_tax") >= 0.005, F.col("l_orderkey")).alias("guard"))
    return T.any_of_guards(sites).select("site", "free", F.array_join(F.col("guards").cast("array<string>"), ",").alias("guards"))


@query("SELECT p_brand AS guard, count(*) - 1 AS \"values\", CASE WHEN count(DISTINCT p_size) = 1 THEN 0 ELSE 1 END ors, count(DISTINCT p_size) equalities FROM part GROUP BY 1".replace("count(*) - 1 AS \"values\", ", ""))
def membership_tests(spark, d):
    tests = star.table(spark, d, "part").groupBy(F.col("p_brand").alias("guard")).agg(F.sort_array(F.collect_set("p_size")).alias("values")).withColumn("var", F.lit("r0"))
    found = guards.membership(tests).groupBy("guard").agg(F.count_if(F.col("op") == "OR").cast("int").alias("ors"), F.count_if(F.col("cmp") == "==").alias("equalities"))
    return found


_LITERALS = (
    _ATOMS
    + """, lit AS (SELECT o_custkey site, g, list_sort(coalesce(list(DISTINCT var) FILTER (WHERE pos), [])) p, list_sort(coalesce(list(DISTINCT var) FILTER (WHERE NOT pos), [])) n FROM atom JOIN orders ON o_orderkey = g WHERE kind = 'OWN' GROUP BY 1, 2),
alts AS (SELECT DISTINCT site, p, n FROM lit), said AS (SELECT site, list_distinct(flatten(list(p))) s FROM alts GROUP BY site),
absorbed AS (SELECT site, p, list_sort(list_filter(n, x -> NOT list_contains(s, x))) n FROM alts JOIN said USING (site)),
shared AS (SELECT site, list_sort(list_reduce(list(p), lambda x, y: list_intersect(x, y))) cp, list_sort(list_reduce(list(n), lambda x, y: list_intersect(x, y))) cn FROM absorbed GROUP BY site),
rest AS (SELECT DISTINCT site, list_sort(list_filter(p, x -> NOT list_contains(cp, x))) p, list_sort(list_filter(n, x -> NOT list_contains(cn, x))) n FROM absorbed JOIN shared USING (site)),
spelt AS (SELECT site, list_concat(list_transform(p, x -> '(gEgo has: ' || x || ')'), list_transform(n, x -> '(not (gEgo has: ' || x || '))')) t FROM rest WHERE len(p) + len(n) > 0),
ways AS (SELECT site, list_sort(list(DISTINCT CASE WHEN len(t) = 1 THEN t[1] ELSE '(and ' || array_to_string(t, ' ') || ')' END)) w FROM spelt GROUP BY site),
terms AS (SELECT site, list_concat(list_concat(list_transform(cp, x -> '(gEgo has: ' || x || ')'), list_transform(cn, x -> '(not (gEgo has: ' || x || '))')), CASE WHEN w IS NULL THEN [] ELSE [CASE WHEN len(w) = 1 THEN w[1] ELSE '(or ' || array_to_string(w, ' ') || ')' END] END) t FROM shared LEFT JOIN ways USING (site))"""
)


def _sites(spark, d) -> DataFrame:
    """site, alts: for each customer the different literal sets of the guards of its orders."""
    of = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("guard"), F.col("o_custkey").alias("site"))
    return T.literals(_levelled(spark, d)).join(of, "guard").groupBy("site").agg(F.collect_set(F.struct("present", "absent")).alias("alts"))


@query("SELECT DISTINCT site, array_to_string(p, ',') present, array_to_string(n, ',') AS absent FROM absorbed", _LITERALS.replace("x -> ", "lambda x: "))
def absorb_ordering(spark, d):
    found = _sites(spark, d).select("site", F.explode(guards.absorbed(F.col("alts"))).alias("a"))
    return found.select("site", F.array_join("a.present", ",").alias("present"), F.array_join("a.absent", ",").alias("absent")).distinct()


@query("SELECT s.site, array_to_string(cp, ',') present, array_to_string(cn, ',') AS absent, count(r.site) rest FROM shared s LEFT JOIN rest r ON r.site = s.site AND len(r.p) + len(r.n) > 0 GROUP BY ALL", _LITERALS.replace("x -> ", "lambda x: "))
def factored_guards(spark, d):
    found = _sites(spark, d).select("site", guards.factored(F.col("alts")).alias("f"))
    return found.select("site", F.array_join("f.present", ",").alias("present"), F.array_join("f.absent", ",").alias("absent"), F.size("f.rest").cast("long").alias("rest"))


@query("SELECT site, CASE WHEN len(t) = 0 THEN NULL WHEN len(t) = 1 THEN t[1] ELSE '(and ' || array_to_string(t, ' ') || ')' END text FROM terms", _LITERALS.replace("x -> ", "lambda x: "))
def rendered_guards(spark, d):
    return _sites(spark, d).select("site", guards.rendered(guards.factored(F.col("alts")), "(gEgo has: {})").alias("text"))
