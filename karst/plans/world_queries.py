"""Questions about the guarded world of the derived model, and the SQL that gives the same rows, written from the definitions.

The SQL walks (room, value) by recursion for each register on its own and intersects; relations of a guarded world have a suffix.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from karst.operators import graph
from karst.operators.world import World, in_order
from karst.plans.fixpoint import shared, written
from karst.plans.registry import query
from karst.sources import star

_CODE = "CASE {} WHEN 'R' THEN 1 WHEN 'A' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 0 END"
_PRICED = "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount <= 0.005 AND l_quantity = "
_COST = "CASE WHEN l_tax < 0.055 THEN []::VARCHAR[] ELSE [p_brand] END cost"

_BASE = f"""
hops AS (SELECT a.l_suppkey src, b.l_suppkey dst, pa.p_brand x, pb.p_brand y, a.l_tax tax, {_CODE.format('a.l_returnflag')} reqf, {_CODE.format('b.l_returnflag')} setf, {_CODE.format('a.l_linestatus')} reqs, {_CODE.format('b.l_linestatus')} sets
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 LEFT JOIN part pa ON pa.p_partkey = a.l_partkey LEFT JOIN part pb ON pb.p_partkey = b.l_partkey
  WHERE a.l_suppkey <> b.l_suppkey AND a.l_quantity = 50 AND a.l_discount >= 0.075),
wy AS (SELECT DISTINCT src, dst, reqf, setf, reqs, sets, CASE WHEN tax < 0.035 THEN [[]::VARCHAR[]] WHEN tax < 0.055 OR x = y THEN [[x]] ELSE list_sort([[x], [y]]) END alts FROM hops),
edge AS (SELECT DISTINCT src, dst FROM wy),
clo(a, b) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT clo.a, edge.dst FROM clo JOIN edge ON clo.b = edge.src),
start AS (SELECT a room FROM clo GROUP BY a ORDER BY count(*) DESC, a LIMIT 1),
reach AS (SELECT b room FROM clo WHERE a = (SELECT room FROM start)),
goal AS (SELECT DISTINCT dst room FROM edge WHERE dst NOT IN (SELECT src FROM edge)),
source AS (SELECT DISTINCT p_brand item, l_suppkey room FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 1 AND l_discount <= 0.025),
need AS (SELECT DISTINCT p_brand item, l_suppkey room FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 2 AND l_discount <= 0.025),
inr AS (SELECT DISTINCT l_suppkey room, {_CODE.format('l_returnflag')} v, {_COST} {_PRICED} 5 AND l_returnflag <> 'N'),
stp AS (SELECT DISTINCT * FROM (SELECT l_suppkey room, {_CODE.format('l_returnflag')} frm, {_CODE.format('l_linestatus')} too, {_COST} {_PRICED} 6) WHERE frm <> too),
gift AS (SELECT DISTINCT p_brand item, l_suppkey room {_PRICED} 9),
dropped AS (SELECT DISTINCT p_brand item, l_suppkey room FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 3 AND l_discount <= 0.025),
entry AS (SELECT l_suppkey room, max({_CODE.format('l_returnflag')}) v {_PRICED} 10 AND l_returnflag <> 'N' GROUP BY 1),
q(v) AS (VALUES (0), (1))"""


def _relations(z: str, wy: str) -> str:
    """Moves, units, walks and findings of the world whose ways are wy; z: suffix of the names."""
    passable = "len(list_filter(alts, lambda a: NOT list_has_any(a, items))) > 0"
    return f""",
mva{z} AS (SELECT src, q.v, dst, coalesce(setf, q.v) w, alts FROM {wy}, q WHERE reqf IS NULL OR reqf = q.v UNION SELECT room, q.v, room, inr.v, [cost] FROM inr, q UNION SELECT room, frm, room, too, [cost] FROM stp),
mvb{z} AS (SELECT DISTINCT src, q.v, dst, coalesce(sets, q.v) w, alts FROM {wy}, q WHERE reqs IS NULL OR reqs = q.v),
sta{z}(room, v) AS (SELECT room, 0 FROM start UNION SELECT dst, w FROM sta{z} s JOIN mva{z} m ON m.src = s.room AND m.v = s.v),
stb{z}(room, v) AS (SELECT room, 0 FROM start UNION SELECT dst, w FROM stb{z} s JOIN mvb{z} m ON m.src = s.room AND m.v = s.v),
grp{z} AS (SELECT DISTINCT src room, list_sort(list_distinct(flatten(alts))) items FROM {wy} WHERE len(alts) >= 2 AND len(list_filter(alts, lambda a: len(a) = 0)) = 0 AND len(list_reduce(alts, lambda x, y: list_intersect(x, y))) = 0),
unit{z} AS (SELECT item unit, [item] items FROM (SELECT DISTINCT item FROM need) WHERE item IN (SELECT item FROM source) UNION SELECT array_to_string(items, '|'), items FROM grp{z} WHERE list_has_any(items, (SELECT list(item) FROM source))),
allu{z} AS (SELECT unit, items FROM unit{z} UNION SELECT item, [item] FROM need UNION SELECT array_to_string(items, '|'), items FROM grp{z}),
bar{z} AS (SELECT DISTINCT unit, room FROM allu{z} JOIN gift ON list_contains(items, item)),
pa{z} AS (SELECT src, v, dst, w, unit FROM mva{z}, allu{z} WHERE {passable}), pb{z} AS (SELECT src, v, dst, w, unit FROM mvb{z}, allu{z} WHERE {passable}),
ga{z} AS (SELECT * FROM pa{z} WHERE (unit, src) NOT IN (SELECT (unit, room) FROM bar{z})), gb{z} AS (SELECT * FROM pb{z} WHERE (unit, src) NOT IN (SELECT (unit, room) FROM bar{z})),
rwa{z}(unit, room, v) AS (SELECT unit, room, 0 FROM allu{z}, start UNION SELECT r.unit, dst, w FROM rwa{z} r JOIN ga{z} m ON m.unit = r.unit AND m.src = r.room AND m.v = r.v),
rwb{z}(unit, room, v) AS (SELECT unit, room, 0 FROM allu{z}, start UNION SELECT r.unit, dst, w FROM rwb{z} r JOIN gb{z} m ON m.unit = r.unit AND m.src = r.room AND m.v = r.v),
rw{z} AS (SELECT DISTINCT unit, room FROM rwa{z} WHERE (unit, room) IN (SELECT (unit, room) FROM rwb{z})),
sat{z} AS (SELECT DISTINCT unit, room FROM allu{z} JOIN source ON list_contains(items, item)),
ba{z}(unit, room, v) AS (SELECT unit, room, v FROM sat{z} JOIN sta{z} USING (room) UNION SELECT b.unit, m.src, m.v FROM ba{z} b JOIN pa{z} m ON m.unit = b.unit AND m.dst = b.room AND m.w = b.v JOIN sta{z} s ON s.room = m.src AND s.v = m.v),
bb{z}(unit, room, v) AS (SELECT unit, room, v FROM sat{z} JOIN stb{z} USING (room) UNION SELECT b.unit, m.src, m.v FROM bb{z} b JOIN pb{z} m ON m.unit = b.unit AND m.dst = b.room AND m.w = b.v JOIN stb{z} s ON s.room = m.src AND s.v = m.v),
rb{z} AS (SELECT DISTINCT unit, room FROM ba{z} WHERE (unit, room) IN (SELECT (unit, room) FROM bb{z})),
aa{z}(b, room, v) AS (SELECT room, room, v FROM sta{z} UNION SELECT b, dst, w FROM aa{z} a JOIN mva{z} m ON m.src = a.room AND m.v = a.v),
ab{z}(b, room, v) AS (SELECT room, room, v FROM stb{z} UNION SELECT b, dst, w FROM ab{z} a JOIN mvb{z} m ON m.src = a.room AND m.v = a.v),
both_{z} AS (SELECT DISTINCT b, room, 1 p FROM aa{z} UNION SELECT DISTINCT b, room, 2 FROM ab{z}),
aft{z} AS (SELECT b, room FROM both_{z} JOIN (SELECT b, count(DISTINCT p) many FROM both_{z} GROUP BY b) USING (b) GROUP BY b, room, many HAVING count(*) = many UNION SELECT DISTINCT dst, dst FROM edge WHERE dst NOT IN (SELECT b FROM both_{z})),
free{z} AS (SELECT DISTINCT dst src, src dst FROM {wy} WHERE len(list_filter(alts, lambda a: len(a) = 0)) > 0),
each{z} AS (SELECT src, dst, unnest(alts) alt FROM {wy}),
many{z} AS (SELECT src, dst, count(*) whole FROM each{z} GROUP BY ALL),
dem{z} AS (SELECT src, dst, item FROM (SELECT src, dst, unnest(list_distinct(alt)) item FROM each{z}) JOIN many{z} USING (src, dst) GROUP BY src, dst, item, whole HAVING count(*) = whole),
faced{z} AS (SELECT DISTINCT n.item, n.room FROM need n JOIN rw{z} r ON r.unit = n.item AND r.room = n.room),
nd{z} AS (SELECT DISTINCT unit, f.room FROM unit{z} JOIN faced{z} f ON list_contains(items, f.item) WHERE len(items) > 1 OR NOT EXISTS (SELECT 1 FROM grp{z} g WHERE g.room = f.room AND list_contains(g.items, f.item))),
strand0{z} AS (SELECT DISTINCT e.src, e.dst, u.unit, len(u.items) = 1 single FROM edge e JOIN unit{z} u ON true WHERE e.src IN (SELECT room FROM reach) AND (e.src, e.dst) NOT IN (SELECT (src, dst) FROM free{z})
  AND EXISTS (SELECT 1 FROM aft{z} a JOIN goal g ON g.room = a.room WHERE a.b = e.dst) AND EXISTS (SELECT 1 FROM aft{z} a JOIN nd{z} n ON n.room = a.room WHERE a.b = e.dst AND n.unit = u.unit)
  AND (u.unit, e.src) IN (SELECT (unit, room) FROM rb{z}) AND (u.unit, e.dst) NOT IN (SELECT (unit, room) FROM rb{z})),
prn{z} AS (SELECT DISTINCT d.src, d.dst, o.room FROM dem{z} d JOIN dropped o USING (item) WHERE o.room <> d.dst AND (item, o.room) NOT IN (SELECT (item, room) FROM source)),
pne{z} AS (SELECT DISTINCT src, dst FROM prn{z}),
pva{z}(src, dst, room, v) AS (SELECT src, dst, room, 0 FROM pne{z}, start UNION SELECT p.src, p.dst, m.dst, m.w FROM pva{z} p JOIN mva{z} m ON m.src = p.room AND m.v = p.v WHERE m.dst = m.src OR NOT EXISTS (SELECT 1 FROM prn{z} x WHERE x.src = p.src AND x.dst = p.dst AND x.room = m.dst)),
pvb{z}(src, dst, room, v) AS (SELECT src, dst, room, 0 FROM pne{z}, start UNION SELECT p.src, p.dst, m.dst, m.w FROM pvb{z} p JOIN mvb{z} m ON m.src = p.room AND m.v = p.v WHERE m.dst = m.src OR NOT EXISTS (SELECT 1 FROM prn{z} x WHERE x.src = p.src AND x.dst = p.dst AND x.room = m.dst)),
still{z} AS (SELECT DISTINCT a.src, a.dst, s.item FROM pva{z} a JOIN pvb{z} b ON b.src = a.src AND b.dst = a.dst AND b.room = a.room JOIN source s ON s.room = a.room),
wyn{z} AS (SELECT *, row_number() OVER () w FROM {wy}),
xa{z}(w, room, v) AS (SELECT y.w, y.dst, coalesce(y.setf, s.v) FROM wyn{z} y JOIN sta{z} s ON s.room = y.src AND (y.reqf IS NULL OR y.reqf = s.v) WHERE y.reqf IS NOT NULL OR y.setf IS NOT NULL UNION SELECT x.w, m.dst, m.w FROM xa{z} x JOIN mva{z} m ON m.src = x.room AND m.v = x.v),
xb{z}(w, room, v) AS (SELECT y.w, y.dst, coalesce(y.sets, s.v) FROM wyn{z} y JOIN stb{z} s ON s.room = y.src AND (y.reqs IS NULL OR y.reqs = s.v) WHERE y.reqs IS NOT NULL OR y.sets IS NOT NULL UNION SELECT x.w, m.dst, m.w FROM xb{z} x JOIN mvb{z} m ON m.src = x.room AND m.v = x.v),
la{z} AS (SELECT DISTINCT x.w, n.item FROM xa{z} x JOIN need n ON n.room = x.room), lb{z} AS (SELECT DISTINCT x.w, n.item FROM xb{z} x JOIN need n ON n.room = x.room),
why{z} AS (SELECT src, dst, unit, CASE WHEN (src, dst, unit) IN (SELECT (src, dst, item) FROM dem{z}) THEN 'forced' WHEN (src, dst) IN (SELECT (src, dst) FROM pne{z}) AND (src, dst, unit) NOT IN (SELECT (src, dst, item) FROM still{z}) THEN 'unholdable: cost'
    WHEN NOT EXISTS (SELECT 1 FROM wyn{z} y WHERE y.src = s.src AND y.dst = s.dst AND NOT (y.w IN (SELECT w FROM xa{z}) AND (y.w, s.unit) NOT IN (SELECT (w, item) FROM la{z}) OR y.w IN (SELECT w FROM xb{z}) AND (y.w, s.unit) NOT IN (SELECT (w, item) FROM lb{z}))) THEN 'retired' END why FROM strand0{z} s WHERE single),
strand{z} AS (SELECT src, dst, unit FROM strand0{z} LEFT JOIN why{z} USING (src, dst, unit) WHERE why IS NULL),
gstr{z} AS (SELECT DISTINCT g.room, array_to_string(g.items, '|') unit FROM grp{z} g WHERE g.room IN (SELECT room FROM reach) AND (array_to_string(g.items, '|'), g.room) IN (SELECT (unit, room) FROM rw{z}) AND (array_to_string(g.items, '|'), g.room) NOT IN (SELECT (unit, room) FROM rb{z}))"""


_WORLD = _BASE + _relations("", "wy")
_SPEC = """,
spec AS (SELECT src, dst, list_sort(coalesce(list(DISTINCT unit) FILTER (WHERE len(items) = 1), [])) items, list_sort(coalesce(list(DISTINCT items) FILTER (WHERE len(items) > 1), [])) groups FROM strand JOIN unit USING (unit) GROUP BY src, dst)"""
_GUARDED = (
    _SPEC
    + """,
wyg AS (SELECT src, dst, reqf, setf, reqs, sets, CASE WHEN s.items IS NULL THEN w.alts ELSE list_sort(list_distinct(list_transform(
  list_reduce(list_prepend(list_transform(w.alts, lambda a: list_concat(a, s.items)), list_transform(s.groups, lambda g: list_transform(g, lambda x: [x]))), lambda acc, g: flatten(list_transform(acc, lambda a: list_transform(g, lambda x: list_concat(a, x))))),
  lambda a: list_sort(list_distinct(a))))) END alts FROM wy w LEFT JOIN spec s USING (src, dst))"""
    + _relations("_g", "wyg")
)


def _world(spark, d) -> World:
    def make() -> World:
        ways = written(star.world_ways(spark, d))
        edges = written(ways.select("src", "dst").distinct())
        start = written(graph.widest(star.rooms(spark, d), edges).select("room"))
        relations = [written(f(spark, d)) for f in (star.world_writes, star.world_steps, star.sources, star.needs)]
        return World(ways, *relations, start, graph.terminals(edges), written(star.world_grants(spark, d)), (("flag",), ("status",)), written(star.drops(spark, d)))

    return shared(spark, d, "world", make)


@query("SELECT room, v flag FROM sta", _WORLD)
def world_states(spark, d):
    world = _world(spark, d)
    return world.values(world.states(("flag",)), ("flag",))


@query(
    """SELECT room, v flag, u status FROM st2""",
    _BASE
    + """, st2(room, v, u) AS (SELECT room, 0, 0 FROM start UNION SELECT dst, w, x FROM st2 JOIN (
    SELECT src, a.v, b.v u, dst, coalesce(setf, a.v) w, coalesce(sets, b.v) x FROM wy, q a, q b WHERE (reqf IS NULL OR reqf = a.v) AND (reqs IS NULL OR reqs = b.v)
    UNION SELECT room, a.v, b.v, room, inr.v, b.v FROM inr, q a, q b UNION SELECT room, frm, b.v, room, too, b.v FROM stp, q b) m ON m.src = st2.room AND m.v = st2.v AND m.u = st2.u)""",
)
def joint_states(spark, d):
    """Two registers walked together: fewer rooms than either alone allows."""
    world = _world(spark, d)
    both = ("flag", "status")
    joint = replace(world, projections=(both,))
    return joint.values(joint.states(both), both)


@query(
    "SELECT room, v flag FROM sc",
    _BASE
    + """, sc(room, v) AS (SELECT room, 0 FROM start UNION SELECT dst, w FROM sc JOIN (SELECT src, q.v, dst, coalesce(e.v, setf, q.v) w FROM wy LEFT JOIN entry e ON e.room = dst, q WHERE reqf IS NULL OR reqf = q.v
    UNION SELECT room, q.v, room, inr.v FROM inr, q UNION SELECT room, frm, room, too FROM stp) m ON m.src = sc.room AND m.v = sc.v)""",
)
def committed_states(spark, d):
    """Arrival forces what an entry writes, so that no movement is credited that is not there."""
    world = _world(spark, d)
    return world.values(world.states(("flag",), star.world_entries(spark, d)), ("flag",))


@query("SELECT unit, items, room FROM (SELECT DISTINCT r.unit, array_to_string(u.items, ',') items, r.room FROM rw r JOIN unit u USING (unit))", _WORLD)
def units_reach_without(spark, d):
    world = _world(spark, d)
    return world.reach_without(world.units).join(world.units, "unit").select("unit", F.array_join("items", ",").alias("items"), "room")


@query("SELECT unit, room FROM rb WHERE unit IN (SELECT unit FROM unit)", _WORLD)
def units_reobtainable(spark, d):
    world = _world(spark, d)
    return world.reobtainable(world.units)


@query("SELECT b AS after, room FROM aft WHERE b IN (SELECT dst FROM edge)", _WORLD)
def rooms_after_crossing(spark, d):
    world = _world(spark, d)
    return world.rooms_after(world.edges.select(F.col("dst").alias("after")))


_AVOID = (
    _WORLD
    + """, ava(x, room, v) AS (SELECT e.dst, s.room, 0 FROM (SELECT DISTINCT dst FROM edge) e, start s UNION SELECT x, m.dst, m.w FROM ava JOIN mva m ON m.src = ava.room AND m.v = ava.v WHERE m.dst <> x OR m.dst = m.src),
avb(x, room, v) AS (SELECT e.dst, s.room, 0 FROM (SELECT DISTINCT dst FROM edge) e, start s UNION SELECT x, m.dst, m.w FROM avb JOIN mvb m ON m.src = avb.room AND m.v = avb.v WHERE m.dst <> x OR m.dst = m.src),
av AS (SELECT DISTINCT x, room FROM ava WHERE (x, room) IN (SELECT (x, room) FROM avb))"""
)


@query("SELECT x avoided, room FROM av", _AVOID)
def reach_avoiding_rooms(spark, d):
    world = _world(spark, d)
    return world.reach_avoiding(world.edges.select(F.col("dst").alias("avoided")))


@query("SELECT dst room, src frm FROM edge WHERE (dst, src) IN (SELECT (x, room) FROM av)", _AVOID)
def entry_frontier(spark, d):
    world = _world(spark, d)
    return world.entry_frontier(world.edges.select(F.col("dst").alias("room")))


@query("SELECT src, dst, item FROM dem", _WORLD)
def way_demands(spark, d):
    return _world(spark, d).demands


@query("SELECT DISTINCT a.src, a.dst, EXISTS (SELECT 1 FROM free f WHERE f.src = a.src AND f.dst = a.dst) AS free FROM edge a", _WORLD)
def free_returns(spark, d):
    world = _world(spark, d)
    return world.edges.join(world.freely_reversible.withColumn("free", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.coalesce("free", F.lit(False)).alias("free"))


@query("SELECT unit, array_to_string(items, ',') items FROM unit", _WORLD)
def requirement_units(spark, d):
    return _world(spark, d).units.select("unit", F.array_join("items", ",").alias("items"))


@query("SELECT room, array_to_string(items, ',') items FROM grp", _WORLD)
def way_groups(spark, d):
    return _world(spark, d).groups.select("room", F.array_join("items", ",").alias("items"))


@query("SELECT unit, room FROM nd", _WORLD)
def unit_needs(spark, d):
    return _world(spark, d).needed


@query("SELECT src, dst, unit FROM strand", _WORLD)
def gated_strandings(spark, d):
    return _world(spark, d).strandings()


@query("SELECT src, dst, unit, why FROM why WHERE why IS NOT NULL", _WORLD)
def dropped_strandings(spark, d):
    """Strandings that are no findings, and why: the crossing asks for the item, nobody can hold it there, or the crossing ends its need."""
    return _world(spark, d).dropped()


@query("SELECT room, unit FROM gstr", _WORLD)
def group_strandings(spark, d):
    return _world(spark, d).group_strandings()


@query("SELECT src, dst, array_to_string(items, ',') items, array_to_string(list_transform(groups, lambda g: array_to_string(g, '|')), ',') groups FROM spec", _WORLD + _SPEC)
def guard_specs(spark, d):
    found = _world(spark, d).specs()
    return found.select("src", "dst", F.array_join("items", ",").alias("items"), F.array_join(F.transform("groups", lambda g: F.array_join(g, "|")), ",").alias("groups"))


@query("SELECT DISTINCT e.src, e.dst, n.item FROM edge e JOIN need n ON n.room = e.dst WHERE (n.item, e.src) NOT IN (SELECT (unit, room) FROM rb)", _WORLD)
def unsatisfiable_specs(spark, d):
    """Were each crossing to ask for all that its end needs: what could not be had before it."""
    world = _world(spark, d)
    asked = world.edges.join(world.needs.withColumnRenamed("room", "dst"), "dst").groupBy("src", "dst").agg(F.collect_set("item").alias("items"))
    return world.unsatisfiable(asked)


@query("SELECT src, dst, reqf req_flag, setf set_flag, reqs req_status, sets set_status, array_to_string(list_transform(alts, lambda a: array_to_string(a, '+')), '|') alts FROM wyg", _WORLD + _GUARDED)
def guarded_ways(spark, d):
    world = _world(spark, d)
    specs, keep = written(world.specs()), [c for c in world.ways.columns if c != "alts"]
    each = world.guarded_alternatives(specs).groupBy("way", *keep).agg(in_order(F.array_join("alt", "+")).alias("alts"))
    rest = world.ways.join(specs.select("src", "dst"), ["src", "dst"], "left_anti").select(*keep, F.transform("alts", lambda a: F.array_join(a, "+")).alias("alts"))
    return rest.unionAll(each.select(*rest.columns)).withColumn("alts", F.array_join("alts", "|")).select(*world.ways.columns)


@query(
    """SELECT kind, unit, CASE WHEN a.unit IS NULL THEN 'fixed' WHEN b.unit IS NULL THEN 'new' ELSE 'remaining' END change FROM
    (SELECT DISTINCT 'item' kind, unit FROM strand WHERE unit IN (SELECT item FROM need) UNION SELECT 'group', unit FROM gstr) b FULL JOIN
    (SELECT DISTINCT 'item' kind, unit FROM strand_g WHERE unit IN (SELECT item FROM need) UNION SELECT 'group', unit FROM gstr_g) a USING (kind, unit)""",
    _WORLD + _GUARDED,
)
def guard_verification(spark, d):
    """The strandings before and after their guards: what is fixed, what remains, what is new."""
    world = _world(spark, d)
    return world.verified(written(world.specs()))
