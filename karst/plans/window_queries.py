"""Windows that shut and mazes of the derived model, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.operators import mazes, windows
from karst.plans.registry import query
from karst.plans.world_queries import _BASE, _CODE, _world
from karst.sources import star


def part_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """demand, site, room, register, values: line items of a brand that are to be had in quantity ask for one value of the flag."""
    items = star.table(spark, sf_dir, "lineitem").where("l_quantity = 11 and l_returnflag <> 'N' and l_discount <= 0.005")
    part = star.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("demand"))
    value = F.array(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    site = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    found = items.join(part, items["l_partkey"] == part["p_partkey"]).select("demand", site.alias("site"), F.col("l_suppkey").cast("long").alias("room"), F.lit("flag").alias("register"), value.alias("values"))
    return found.distinct()


_WINDOWS = (
    _BASE
    + f""",
mva AS (SELECT src, q.v, dst, coalesce(setf, q.v) w FROM wy, q WHERE reqf IS NULL OR reqf = q.v UNION SELECT room, q.v, room, inr.v FROM inr, q UNION SELECT room, frm, room, too FROM stp),
sta(room, v) AS (SELECT room, 0 FROM start UNION SELECT dst, w FROM sta s JOIN mva m ON m.src = s.room AND m.v = s.v),
prod AS (SELECT DISTINCT p_brand d, l_orderkey || ':' || l_linenumber || ':' || l_suppkey || ':' || l_returnflag site, l_suppkey room, {_CODE.format('l_returnflag')} v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 11 AND l_returnflag <> 'N' AND l_discount <= 0.005),
turned AS (SELECT DISTINCT m.w, m.dst room FROM sta s JOIN mva m ON m.src = s.room AND m.v = s.v WHERE m.w <> m.v),
aft(k, room, v) AS (SELECT w, room, w FROM turned UNION SELECT k, m.dst, m.w FROM aft a JOIN mva m ON m.src = a.room AND m.v = a.v),
bef(k, room, v) AS (SELECT q.v, s.room, s.v FROM q JOIN sta s ON s.v <> q.v WHERE q.v IN (SELECT v FROM sta) UNION SELECT k, m.dst, m.w FROM bef b JOIN mva m ON m.src = b.room AND m.v = b.v),
shut AS (SELECT d, q.v w FROM prod, q GROUP BY d, q.v HAVING bool_and(prod.v <> q.v))"""
)


@query(
    """SELECT d demand, n.room, 'flag' AS register, w AS "value", (SELECT array_to_string(list(t.room ORDER BY t.room), ',') FROM turned t WHERE t.w = s.w) flips FROM shut s JOIN need n ON n.item = s.d
    WHERE w IN (SELECT w FROM turned) AND w IN (SELECT k FROM aft JOIN goal USING (room)) AND (w, n.room) IN (SELECT (k, room) FROM aft) AND (d, w) IN (SELECT (prod.d, k) FROM prod JOIN bef ON bef.room = prod.room)""",
    _WINDOWS,
)
def window_closures(spark, d):
    """Flips of the flag after which a brand is still asked for and no line item can give it."""
    world = _world(spark, d)
    found = windows.window_closures(world, part_producers(spark, d), world.needs.select(F.col("item").alias("demand"), "room"))
    return found.select("demand", "room", "register", "value", F.array_join(F.transform("flips", lambda x: x.cast("string")), ",").alias("flips"))


def item_demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """room, register, values: line items presuppose one value of the flag or of the status at their supplier."""
    items = star.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    flag = F.col("l_linenumber") % 2 == 0
    value = F.when(flag, F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).otherwise(F.when(F.col("l_linestatus") == "O", 1).otherwise(0))
    return items.select(F.col("l_suppkey").cast("long").alias("room"), F.when(flag, "flag").otherwise("status").alias("register"), F.array(value).alias("values")).distinct()


def _side(x: str, z: str) -> str:
    """Relations of one register: flips, rooms after and before; x: its moves mv<x> and states st<x>."""
    return f"""trn{z} AS (SELECT DISTINCT m.w, m.dst room FROM {x} s JOIN mv{z} m ON m.src = s.room AND m.v = s.v WHERE m.w <> m.v),
aft{z}(k, room, v) AS (SELECT w, room, w FROM trn{z} UNION SELECT k, m.dst, m.w FROM aft{z} a JOIN mv{z} m ON m.src = a.room AND m.v = a.v),
bef{z}(k, room, v) AS (SELECT q.v, s.room, s.v FROM q JOIN {x} s ON s.v <> q.v WHERE q.v IN (SELECT v FROM {x}) UNION SELECT k, m.dst, m.w FROM bef{z} b JOIN mv{z} m ON m.src = b.room AND m.v = b.v)"""


def _rows(z: str, own: str, other: str, held: str) -> str:
    return f"""SELECT DISTINCT '{own}' AS register, t.w AS "value", '{other}' demanded, h.v held, d.room FROM trn{z} t JOIN {held} h ON h.room = t.room JOIN dmd d ON d.register = '{other}' AND d.v <> h.v
    WHERE (t.w, d.room) IN (SELECT (k, room) FROM aft{z}) AND t.w IN (SELECT k FROM aft{z} JOIN goal USING (room))
    AND NOT EXISTS (SELECT 1 FROM aft{z} a JOIN able e ON e.room = a.room WHERE a.k = t.w AND e.register = '{other}' AND e.v = d.v) AND EXISTS (SELECT 1 FROM bef{z} a JOIN able e ON e.room = a.room WHERE a.k = t.w AND e.register = '{other}' AND e.v = d.v)"""


@query(
    _rows("a", "flag", "status", "stb") + " UNION " + _rows("b", "status", "flag", "sta"),
    _BASE
    + f""",
mva AS (SELECT src, q.v, dst, coalesce(setf, q.v) w FROM wy, q WHERE reqf IS NULL OR reqf = q.v UNION SELECT room, q.v, room, inr.v FROM inr, q UNION SELECT room, frm, room, too FROM stp),
mvb AS (SELECT DISTINCT src, q.v, dst, coalesce(sets, q.v) w FROM wy, q WHERE reqs IS NULL OR reqs = q.v),
sta(room, v) AS (SELECT room, 0 FROM start UNION SELECT dst, w FROM sta s JOIN mva m ON m.src = s.room AND m.v = s.v),
stb(room, v) AS (SELECT room, 0 FROM start UNION SELECT dst, w FROM stb s JOIN mvb m ON m.src = s.room AND m.v = s.v),
{_side('sta', 'a')}, {_side('stb', 'b')},
able AS (SELECT 'flag' register, room, v FROM inr UNION SELECT 'flag', room, too FROM stp UNION SELECT 'flag', src, setf FROM wy WHERE setf IS NOT NULL UNION SELECT 'status', src, sets FROM wy WHERE sets IS NOT NULL),
dmd AS (SELECT DISTINCT l_suppkey room, CASE WHEN l_linenumber % 2 = 0 THEN 'flag' ELSE 'status' END register, CASE WHEN l_linenumber % 2 = 0 THEN {_CODE.format('l_returnflag')} ELSE {_CODE.format('l_linestatus')} END v FROM lineitem WHERE l_returnflag <> 'N')""",
)
def register_value_strandings(spark, d):
    """Flips past which a room presupposes a value of the other register that nothing brings about any more."""
    return windows.value_strandings(_world(spark, d), item_demands(spark, d))


def customer_doors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """doors and rooms (see operators.mazes): customers in grids of 16 by 16; a customer's nation opens it to the next one, its balance to the one
    sixteen on, and that one has the door back unless its key is divisible by 23."""
    customers = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", "c_acctbal")
    cell = customers.withColumn("maze", F.floor(F.col("k") / 256)).withColumn("cell", F.col("k") % 256)
    east, south = F.col("c_nationkey") % 3 != 0, F.col("c_acctbal") >= 3000
    one = lambda df, name, step=0: df.select("maze", F.lit(name).alias("list"), (F.col("cell") + step).alias("cell"), (F.col("k") + step).alias("to"))
    back = one(cell.where(east), "c", 1).unionAll(one(cell.where(south), "d", 16)).where("to % 23 <> 0")
    doors = one(cell.where(east), "a").unionAll(one(cell.where(south), "b")).unionAll(back).drop("to")
    return doors, cell.where("k % 16 = 5").select("maze", "cell", F.col("k").alias("room"))


_MAZE = """
cell AS (SELECT c_custkey k, c_custkey // 256 m, c_custkey % 256 c, c_nationkey % 3 <> 0 e, c_acctbal >= 3000 s FROM customer),
door AS MATERIALIZED (SELECT DISTINCT m, l, c FROM (SELECT m, 'a' l, c FROM cell WHERE e UNION ALL SELECT m, 'b', c FROM cell WHERE s UNION ALL SELECT m, 'c', c + 1 FROM cell WHERE e AND (k + 1) % 23 <> 0 UNION ALL SELECT m, 'd', c + 16 FROM cell WHERE s AND (k + 16) % 23 <> 0)),
big AS (SELECT m, l, count(*) n FROM door GROUP BY m, l HAVING count(*) >= 8),
sized AS MATERIALIZED (SELECT * FROM big WHERE m IN (SELECT m FROM big GROUP BY m HAVING count(*) >= 4)),
pair AS (SELECT a.m, st, a.l la, b.l lb, count(*) met FROM door a, (VALUES (1), (8), (16), (32)) o(st), door b WHERE b.m = a.m AND b.c = a.c + st AND a.l <> b.l GROUP BY ALL),
score AS (SELECT pair.m, st, la, lb, (met / x.n + met / y.n) / 2 sc FROM pair JOIN sized x ON x.m = pair.m AND x.l = la JOIN sized y ON y.m = pair.m AND y.l = lb),
best AS (SELECT * FROM score WHERE sc >= 0.9 QUALIFY row_number() OVER (PARTITION BY m, st ORDER BY sc DESC, la, lb) = 1),
axis AS MATERIALIZED (SELECT * FROM best WHERE m IN (SELECT m FROM best GROUP BY m HAVING count(*) >= 2)),
hop AS MATERIALIZED (SELECT door.m, c src, c + st dst FROM door JOIN axis ON axis.m = door.m AND la = l UNION SELECT door.m, c, c - st FROM door JOIN axis ON axis.m = door.m AND lb = l),
room AS (SELECT m, c, k FROM cell WHERE k % 16 = 5),
go(m, k, c) AS (SELECT room.m, k, dst FROM room JOIN hop ON hop.m = room.m AND src = room.c UNION SELECT go.m, go.k, hop.dst FROM go JOIN hop ON hop.m = go.m AND hop.src = go.c WHERE NOT EXISTS (SELECT 1 FROM room r WHERE r.m = go.m AND r.c = go.c))"""


@query("SELECT m maze, st::INT step, la ahead, lb AS back FROM axis", _MAZE)
def maze_axes(spark, d):
    """Which door lists are opposite directions, and how far a step goes."""
    return mazes.axes(customer_doors(spark, d)[0]).select("maze", "step", "ahead", "back")


@query('SELECT DISTINCT go.m maze, go.k room, r.k AS "to" FROM go JOIN room r ON r.m = go.m AND r.c = go.c WHERE r.k <> go.k', _MAZE)
def maze_reach(spark, d):
    """Rooms of a maze that can be walked to from each other one."""
    doors, rooms = customer_doors(spark, d)
    return mazes.maze_reach(mazes.passages(doors, mazes.axes(doors)), rooms)
