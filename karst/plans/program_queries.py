"""Facts of the programs that the tables give, and the SQL that gives the same rows.

The SQL builds the same node table and climbs from each effect to the root of its body, parent by parent; contexts are a recursion over
calls. It knows nothing of intervals, guard trees or folds: what a guard asks for is read from the tests by their shape.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from karst.operators import extract
from karst.operators.world import World
from karst.plans.fixpoint import shared, written
from karst.plans.registry import query
from karst.sources import programs


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_TEMPLATES = ", ".join(f"({', '.join(map(_literal, row))})" for row in programs.template_rows())
_STANDS = "CASE {0} WHEN -1 THEN dst WHEN -2 THEN item WHEN -3 THEN reg WHEN -4 THEN v ELSE {0} END {0}"
_PROGRAM = f"""
tpl(form, off, up, ord, depth, last, t, name, vtype, idx, value) AS (VALUES {_TEMPLATES}),
st AS MATERIALIZED (SELECT l_orderkey k, l_linenumber ln, l_partkey % {len(programs.FORMS)} form, l_partkey % 40 item, l_suppkey + 1 dst, l_suppkey % 5 + 20 reg, l_quantity::BIGINT % 4 v FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1),
body AS MATERIALIZED (SELECT k, CASE p WHEN '5-LOW' THEN 0 ELSE s END script, CASE p WHEN '5-LOW' THEN 'p' ELSE 'o' END || k AS id, p <> '1-URGENT' mv FROM (SELECT k, arg_min(dst, ln) s, any_value(o_orderpriority) p FROM st JOIN orders ON o_orderkey = k GROUP BY k)),
node AS MATERIALIZED (SELECT k, {programs.STRIDE} * (ln - 1) + 1 + off node, CASE off WHEN 0 THEN 0 ELSE {programs.STRIDE} * (ln - 1) + 1 + up END parent, CASE off WHEN 0 THEN ln - 1 ELSE ord END ord, t, CASE name WHEN '$next' THEN 'p' || (k + 1) ELSE name END name, vtype, {_STANDS.format('idx')}, {_STANDS.format('value')}
  FROM st JOIN tpl USING (form) WHERE k IN (SELECT k FROM body)),
kid AS MATERIALIZED (SELECT c.*, p.t pt, p.ord pord, p.parent top FROM node c JOIN node p ON p.k = c.k AND p.node = c.parent),
cases AS MATERIALIZED (SELECT c.k, c.node cs, c.t, c.ord, c.parent top, l.node label, c.pt = 'Cond' OR (h.vtype = 'Global' AND l.t = 'Number') guards FROM kid c LEFT JOIN kid l ON l.k = c.k AND l.parent = c.node AND l.ord = 0 AND c.t = 'Case' LEFT JOIN kid h ON h.k = c.k AND h.parent = c.parent AND h.ord = 0 WHERE c.pt IN ('Cond', 'Switch') AND c.t IN ('Case', 'Else')),
arm AS MATERIALIZED (SELECT c.k, c.node arm, x.node test, c.ord = 1 holds FROM kid c JOIN kid x ON x.k = c.k AND x.parent = c.parent AND x.ord = 0 WHERE c.pt = 'If' AND c.ord > 0
  UNION ALL SELECT c.k, b.node, c.label, true FROM cases c JOIN kid b ON b.k = c.k AND b.parent = c.cs AND b.ord = 1 WHERE c.t = 'Case' AND c.guards
  UNION ALL SELECT c.k, b.node, e.label, false FROM cases c JOIN cases e ON e.k = c.k AND e.top = c.top AND e.ord < c.ord AND e.t = 'Case' AND e.guards JOIN kid b ON b.k = c.k AND b.parent = c.cs AND b.ord = CASE c.t WHEN 'Else' THEN 0 ELSE 1 END),
say AS MATERIALIZED (SELECT s.k, s.node leaf, r.t rt, r.vtype rv, r.idx ri, sel.name sel, p.t pt, p.vtype pv, p.idx pi, p.value p1, q.value p2 FROM node s JOIN kid r ON r.k = s.k AND r.parent = s.node AND r.ord = 0 JOIN kid m ON m.k = s.k AND m.parent = s.node AND m.t = 'SendMessage'
  JOIN kid sel ON sel.k = s.k AND sel.parent = m.node AND sel.ord = 0 LEFT JOIN kid p ON p.k = s.k AND p.parent = m.node AND p.ord = 1 LEFT JOIN kid q ON q.k = s.k AND q.parent = m.node AND q.ord = 2 WHERE s.t = 'Send'),
asg AS MATERIALIZED (SELECT a.k, a.node leaf, x.vtype vt, x.idx, y.value FROM node a JOIN kid x ON x.k = a.k AND x.parent = a.node AND x.ord = 0 JOIN kid y ON y.k = a.k AND y.parent = a.node AND y.ord = 1 WHERE a.t = 'Assignment'),
cal AS MATERIALIZED (SELECT c.k, c.node leaf, b.k AS into FROM node c JOIN body b ON b.id = c.name AND b.script = 0 WHERE c.t = 'PublicCall'),
want AS (SELECT k, leaf FROM say UNION SELECT k, leaf FROM asg UNION SELECT k, leaf FROM cal),
climb(k, leaf, node) AS (SELECT k, leaf, leaf FROM want UNION ALL SELECT c.k, c.leaf, n.parent FROM climb c JOIN node n ON n.k = c.k AND n.node = c.node),
cond AS MATERIALIZED (SELECT climb.k, leaf, list_sort(list(DISTINCT id || ':' || test || CASE WHEN holds THEN '+' ELSE '-' END)) conds FROM climb JOIN arm ON arm.k = climb.k AND arm.arm = climb.node JOIN body b ON b.k = climb.k GROUP BY climb.k, leaf),
cond2 AS MATERIALIZED (SELECT k, leaf, coalesce(conds, []) conds FROM want LEFT JOIN cond USING (k, leaf)),
ctx(room, k, mv, conds, seen) AS (SELECT script, k, mv, []::VARCHAR[], []::BIGINT[] FROM body WHERE script <> 0
  UNION SELECT room, "into", mv, list_sort(list_distinct(list_concat(ctx.conds, c.conds))), list_sort(list_append(seen, "into")) FROM ctx JOIN cal USING (k) JOIN cond2 c USING (k, leaf) WHERE NOT list_contains(seen, "into")),
eff AS MATERIALIZED (SELECT k, leaf, 'move' kind, NULL item, NULL register, p1 AS value, []::VARCHAR[] extra FROM say WHERE sel = 'newRoom' AND pt = 'Number'
  UNION ALL SELECT k, leaf, 'take', p1, NULL, NULL, [] FROM say WHERE sel = 'get' AND ri = 0 UNION ALL SELECT k, leaf, 'put', p1, NULL, p2, [] FROM say WHERE sel = 'put' AND ri = 0
  UNION ALL SELECT k, leaf, 'pending', NULL, NULL, value, [] FROM asg WHERE vt = 'Global' AND idx = 13 UNION ALL SELECT k, leaf, 'set', NULL, 'r' || idx, value, [] FROM asg WHERE vt = 'Global' AND idx <> 13
  UNION SELECT s.k, s.leaf, 'move', NULL, NULL, a.value, c.conds FROM say s JOIN asg a ON a.k = s.k AND a.vt = s.pv AND a.idx = s.pi JOIN cond2 c ON c.k = a.k AND c.leaf = a.leaf WHERE sel = 'newRoom' AND pt = 'Variable'),
fact0 AS MATERIALIZED (SELECT DISTINCT x.room, x.k, x.mv, e.leaf, e.kind, e.item, e.register, e.value, list_sort(list_distinct(list_concat(x.conds, list_concat(c.conds, e.extra)))) conds FROM eff e JOIN cond2 c USING (k, leaf) JOIN (SELECT DISTINCT room, k, mv, conds FROM ctx) x USING (k)),
labels AS (SELECT l.k, l.node, h.idx, l.value FROM kid l JOIN kid c ON c.k = l.k AND c.node = l.parent AND c.t = 'Case' AND c.pt = 'Switch' JOIN kid h ON h.k = l.k AND h.parent = c.parent AND h.ord = 0 WHERE l.ord = 0),
equals AS (SELECT e.k, e.node, max(x.idx) idx, max(x.value) AS value FROM node e JOIN kid x ON x.k = e.k AND x.parent = e.node AND x.t IN ('Variable', 'Number') WHERE e.t = 'Eq' GROUP BY e.k, e.node),
says AS (SELECT k, node, idx, value, true pos, '+' sign FROM equals UNION ALL SELECT k, node, idx, value, false, '-' FROM equals UNION ALL SELECT k, node, idx, value, true, '+' FROM labels UNION ALL SELECT k, node, idx, value, false, '-' FROM labels
  UNION ALL SELECT a.k, a.node, e.idx, e.value, false, '+' FROM node a JOIN kid n ON n.k = a.k AND n.parent = a.node AND n.t = 'Not' JOIN kid q ON q.k = n.k AND q.parent = n.node JOIN equals e ON e.k = q.k AND e.node = q.node WHERE a.t = 'And'),
eq AS MATERIALIZED (SELECT b.id || ':' || node || sign c, idx, value, pos FROM says JOIN body b USING (k)),
owns AS MATERIALIZED (SELECT DISTINCT b.id || ':' || n || '+' c, 'i' || p1 item FROM (SELECT k, leaf n, p1 FROM say WHERE sel = 'has' UNION ALL SELECT s.k, x.parent, p1 FROM say s JOIN kid x ON x.k = s.k AND x.node = s.leaf AND x.pt = 'And' WHERE sel = 'has') JOIN body b USING (k)),
sets AS MATERIALIZED (SELECT DISTINCT conds FROM fact0),
asked AS MATERIALIZED (SELECT DISTINCT conds, idx, value, pos FROM (SELECT conds, unnest(conds) c FROM sets) JOIN eq USING (c)),
held AS MATERIALIZED (SELECT conds, list_sort(list(DISTINCT item)) items FROM (SELECT conds, unnest(conds) c FROM sets) JOIN owns USING (c) GROUP BY conds),
never AS (SELECT conds FROM asked WHERE pos GROUP BY conds, idx HAVING count(DISTINCT value) > 1 UNION SELECT a.conds FROM asked a JOIN asked b USING (conds, idx, value) WHERE a.pos AND NOT b.pos),
here AS (SELECT conds, value FROM asked WHERE pos AND idx = 11),
fact AS MATERIALIZED (SELECT f.*, coalesce(held.items, []) items FROM fact0 f LEFT JOIN held USING (conds) WHERE conds NOT IN (SELECT conds FROM never) AND NOT EXISTS (SELECT 1 FROM here h WHERE h.conds = f.conds AND h.value <> f.room))"""

_CONDS = "array_to_string(conds, ' ')"


def _program(spark, d) -> extract.Program:
    def make() -> extract.Program:
        scopes = extract.room_scopes(programs.program_heads(spark, d), programs.program_rooms(spark, d))
        return extract.extract(programs.program_nodes(spark, d), scopes, whole=True)

    return shared(spark, d, "program", make)


def _shown():
    mark = lambda c: F.concat(F.when(c["owner"] == "", c["body"]).otherwise(c["owner"]), F.lit(":"), c["test"].cast("string"), F.when(c["holds"], "+").otherwise("-"))
    return F.array_join(F.array_sort(F.transform("conditions", mark)), " ").alias("conds")


@query(f"SELECT DISTINCT room, value dst, kind, mv movement, {_CONDS} conds FROM fact WHERE kind IN ('move', 'pending')", _PROGRAM)
def program_edges(spark, d):
    """Ways between rooms, with the tests under which each is open."""
    return _program(spark, d).edges.select("room", "dst", "kind", "movement", _shown()).distinct()


@query(f"SELECT DISTINCT 'i' || item item, room, {_CONDS} conds FROM fact WHERE kind = 'take'", _PROGRAM)
def program_takes(spark, d):
    return _program(spark, d).takes.select("item", "room", _shown()).distinct()


@query("SELECT DISTINCT 'i' || item item, value room, array_to_string(items, '+') costs FROM fact WHERE kind = 'put'", _PROGRAM)
def program_puts(spark, d):
    """Where items are put, and what each way to do so asks for."""
    program = _program(spark, d)
    return program.puts.join(program.alts, "guard").select("item", "room", F.array_join(F.transform("alts", lambda a: F.array_join(a, "+")), "|").alias("costs")).distinct()


@query("SELECT DISTINCT register, room, value, array_to_string(items, '+') AS \"cost\" FROM fact WHERE kind = 'set'", _PROGRAM)
def program_writes(spark, d):
    found = _program(spark, d).costs()
    return found.select("register", F.col("room").cast("int").alias("room"), "value", F.array_join("cost", "+").alias("cost")).distinct()


@query("SELECT DISTINCT unnest(items) item, room FROM fact", _PROGRAM)
def program_needs(spark, d):
    """Rooms in which something can only be done with an item."""
    return _program(spark, d).needs


@query(
    """SELECT room, v r20 FROM run""",
    _PROGRAM
    + """, wy AS (SELECT DISTINCT room src, f.value dst, a.value req FROM fact f LEFT JOIN asked a ON a.conds = f.conds AND a.idx = 20 AND a.pos WHERE kind IN ('move', 'pending') AND mv),
wr AS (SELECT DISTINCT room, value v FROM fact WHERE kind = 'set' AND register = 'r20'),
mv AS (SELECT src, req, dst, NULL::BIGINT w FROM wy UNION ALL SELECT room, NULL, room, v FROM wr),
run(room, v) AS (SELECT 1, 0 UNION SELECT dst, coalesce(w, v) FROM run JOIN mv ON src = room AND (req IS NULL OR req = v))""",
)
def program_states(spark, d):
    """The world that the programs make, walked from room 1 with register 20."""
    program, registers = _program(spark, d), ["r20"]
    none = spark.createDataFrame([], "register string, room long, frm int, to int, cost array<string>")
    start, goals = spark.createDataFrame([(1,)], "room long"), spark.createDataFrame([], "room long")
    rooms = lambda df: df.select("item", F.col("room").cast("long").alias("room")).distinct()
    world = World(program.ways(registers), program.costs(), none, rooms(program.takes), rooms(program.needs), start, goals, rooms(program.takes).limit(0), (("r20",),))
    return world.values(world.states(("r20",)), ("r20",))
