"""Questions about registers and properties that go one way, and the SQL that gives the same rows.

Each part is a register that its line items write; consecutive line items of an order with other suppliers are ways that ask for a value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from karst.operators import latches
from karst.plans.registry import query
from karst.plans.world_queries import _WORLD, _world
from karst.sources import star

_FLAG = "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END"
_REGISTERS = f"writes AS (SELECT DISTINCT l_partkey register, {_FLAG} AS val FROM lineitem WHERE l_linestatus = 'F')"


@query("SELECT register FROM writes WHERE val IS NOT NULL GROUP BY register HAVING list_sort(list(val)) = [1]", _REGISTERS)
def one_way_registers(spark, d):
    return latches.one_way(star.part_writes(spark, d))


@query(
    f"""SELECT DISTINCT a.l_suppkey src, b.l_suppkey dst, a.l_partkey register FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    WHERE a.l_suppkey <> b.l_suppkey AND a.l_returnflag = 'A' AND a.l_partkey IN (SELECT register FROM writes WHERE val = 1) AND a.l_partkey NOT IN (SELECT register FROM writes WHERE val = 0)""",
    f"writes AS (SELECT DISTINCT l_partkey register, {_FLAG} AS val FROM lineitem WHERE l_linenumber = 1)",
)
def self_sealing_ways(spark, d):
    """Only first line items write here, so that a register may be asked for a value that it is never given."""
    return latches.self_sealing(star.part_asks(spark, d), star.part_writes(spark, d, "l_linenumber = 1"))


@query(
    """SELECT register, safe, item, doors FROM (SELECT register, safe, count(*) doors FROM door GROUP BY ALL) t, (SELECT DISTINCT item FROM need WHERE item IN (SELECT item FROM source)) i
    WHERE NOT EXISTS (SELECT 1 FROM opened o JOIN source s USING (room) WHERE o.register = t.register AND o.safe = t.safe AND s.item = i.item)""",
    _WORLD
    + """, door AS (SELECT DISTINCT 'flag' register, reqf safe, src, dst FROM wy WHERE reqf IS NOT NULL UNION SELECT 'status', reqs, src, dst FROM wy WHERE reqs IS NOT NULL),
opened(register, safe, room) AS (SELECT DISTINCT register, safe, start.room FROM door, start UNION SELECT o.register, o.safe, e.dst FROM opened o JOIN edge e ON e.src = o.room
  WHERE NOT EXISTS (SELECT 1 FROM door x WHERE x.register = o.register AND x.safe = o.safe AND x.src = e.src AND x.dst = e.dst))""",
)
def register_flip_strandings(spark, d):
    """Each value that ways ask of a register is taken as the safe one of a trap."""
    world = _world(spark, d)
    asks = world.ways.select("src", "dst", F.lit("flag").alias("register"), F.col("req_flag").alias("value")).unionAll(world.ways.select("src", "dst", F.lit("status"), "req_status")).where("value is not null")
    return latches.flip_seals(world.start, world.edges, asks.select("register", F.col("value").alias("safe")).distinct(), asks, world.sources, world.needs)


@query(
    """SELECT item, property, w.room, count(DISTINCT a.room) ahead FROM worn w JOIN aft a ON a.b = w.room AND a.room <> w.room JOIN need n USING (item) WHERE n.room = a.room GROUP BY ALL""",
    _WORLD
    + f""", prop AS (SELECT DISTINCT p_brand item, l_suppkey % 2 property, l_suppkey room, CASE WHEN l_returnflag = 'N' THEN 'inc' ELSE 'set' END kind, {_FLAG} val FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 7),
spent AS (SELECT item, property, bool_or(kind = 'inc') counter, count(DISTINCT val) many FROM prop GROUP BY ALL),
worn AS (SELECT DISTINCT item, property, room FROM prop JOIN spent USING (item, property) WHERE item IN (SELECT item FROM spent WHERE counter OR many = 1) AND CASE WHEN counter THEN kind = 'inc' ELSE val IS NOT NULL END)""",
)
def resource_exhaustion(spark, d):
    world = _world(spark, d)
    writes = star.property_writes(spark, d)
    return latches.exhausted(writes, world.needs, world.rooms_after(writes.select(F.col("room").alias("after")).distinct()))
