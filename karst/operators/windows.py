"""Windows that shut by themselves: demands whose every producer dies when a register flips.

A place can stay within reach while what is done there is over: what counts is whether a site can still act. producers: demand, site, room,
register, values: what a site asks of a register (one row for each; a null register: nothing). demands: demand, room that reads it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.operators.world import World
from karst.plans.fixpoint import walks, written


def flips(world: World, register: str) -> DataFrame:
    """value, node: reached states into which a single step brings a register from another value."""
    p = (register,)
    live = world._reached[p]
    moved = world._moves[p].join(live.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst").distinct()
    before = world.values(moved.select(F.col("src").alias("node"), "dst"), p).select("dst", F.col(register).alias("_was"))
    after = world.values(before.withColumn("node", F.col("dst")), p)
    return after.where(F.col(register) != F.col("_was")).select(F.col(register).alias("value"), F.col("dst").alias("node")).distinct()


def _around(world: World, register: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """For a register on its own: reached states (node, value), its values, flips, and for each value the rooms after a flip to it and the rooms before.

    after: value, room, from the states that a flip leads to. before: value, room, from all reached states with another value.
    """
    p, none = (register,), F.lit(None).cast("string")
    live = written(world.values(world._reached[p].withColumn("state", F.col("node")), p).select(F.col("state").alias("node"), F.col(register).alias("value")))
    values = written(live.select("value").distinct())
    turned = written(flips(world, register))
    arcs = written(world._moves[p].select("src", "dst", F.lit(None).cast("array<string>").alias("bars")))
    walked = lambda seeds: written(walks(seeds, arcs).select(F.col("walk").cast("int").alias("value"), world.room(p)).distinct())
    after = walked(turned.select(F.col("value").cast("long").alias("walk"), "node", none.alias("ban")))
    other = values.withColumnRenamed("value", "to").join(live, F.col("to") != F.col("value"))  # a register's values are few
    before = walked(other.select(F.col("to").cast("long").alias("walk"), "node", none.alias("ban")))
    if not world.goals.isEmpty():  # what can't be won any more is a dead end, not a window
        after = written(after.join(after.join(world.goals, "room", "left_semi").select("value").distinct(), "value", "left_semi"))
    return live, values, turned, after, before


def window_closures(world: World, producers: DataFrame, demands: DataFrame) -> DataFrame:
    """demand, room (where it is read), register, value, flips (sorted array of rooms): flips after which a demand is read and nothing can meet it.

    Held for each register alone (projections of several registers are left out): the register comes to the value in a reached state, from
    which a goal and the room that reads the demand can still be reached; every producer of the demand asks for another value; and before,
    from states with another value, some producer was within reach.
    """
    sites, out = written(producers.select("demand", "site", "room", "register", "values").distinct()), []
    asked = written(demands.select("demand", F.col("room").alias("need")).distinct())
    many = sites.groupBy("demand").agg(F.count_distinct("site").alias("_sites"))
    rooms = written(sites.select("demand", "room").distinct())
    none = F.lit(None).cast("string")
    for p in world.projections:
        if len(p) != 1:
            continue
        register = p[0]
        _, values, turned, after, before = _around(world, register)
        asks = sites.where(F.col("register") == register).join(values.withColumnRenamed("value", "w"))  # likewise
        dead = asks.where(~F.array_contains("values", F.col("w"))).groupBy("demand", F.col("w").alias("value")).agg(F.count_distinct("site").alias("_dead"))
        shut = dead.join(many, "demand").where("_dead = _sites").select("demand", "value")
        shut = shut.join(rooms.join(before, "room").select("demand", "value").distinct(), ["demand", "value"], "left_semi")
        read = shut.join(asked, "demand").join(after.withColumnRenamed("room", "need"), ["value", "need"], "left_semi")
        where = turned.select("value", world.room(p)).groupBy("value").agg(F.sort_array(F.collect_set("room")).alias("flips"))
        out.append(read.join(where, "value").select("demand", F.col("need").alias("room"), F.lit(register).alias("register"), "value", "flips"))
    if not out:
        return asked.select("demand", F.col("need").alias("room"), none.alias("register"), F.lit(0).alias("value"), F.array().cast("array<long>").alias("flips")).limit(0)
    return reduce(DataFrame.unionAll, out)


def settable(world: World, register: str) -> DataFrame:
    """room, value: where a register can be brought to a value, by a write, a step or on the way out."""
    wrote = world.writes.where(F.col("register") == register).select("room", F.col("value").cast("int").alias("value"))
    step = world.steps.where(F.col("register") == register).select("room", F.col("to").cast("int").alias("value"))
    way = world.ways.where(F.col(f"set_{register}").isNotNull()).select(F.col("src").alias("room"), F.col(f"set_{register}").cast("int").alias("value"))
    return wrote.unionAll(step).unionAll(way).distinct()


def value_strandings(world: World, demands: DataFrame) -> DataFrame:
    """register, value, demanded, held, room: flips past which a room asks another register for values that the one held is not among.

    demands: room, register, values (array): what a room presupposes. The flip can happen while the demanded register holds the value; the
    room, and a goal, are within reach after it; nothing within reach after it brings the register to a value that would do, while something
    within reach before it did. Both registers are read on their own (projections of several are left out).
    """
    single, out = [p[0] for p in world.projections if len(p) == 1], []
    around = {r: _around(world, r) for r in single}
    for register in single:
        _, _, turned, after, before = around[register]
        where = turned.select("value", world.room((register,))).distinct()
        for other in single:
            asked = demands.where(F.col("register") == other).select(F.col("room").alias("need"), F.array_sort(F.array_distinct("values")).alias("values")).distinct()
            if other == register:
                continue
            held = around[other][0].select(world.room((other,)), F.col("value").alias("held")).distinct()
            held = where.join(held, "room").select("value", "held").distinct()
            faced = asked.join(after.withColumnRenamed("room", "need"), "need")
            rows = written(faced.join(held, "value").where(~F.array_contains("values", F.col("held"))))
            able = settable(world, other).withColumnRenamed("value", "sets")
            mends = lambda there: rows.select("value", "values").distinct().join(there.join(able, "room").select("value", "sets").distinct(), "value").where(F.array_contains("values", F.col("sets"))).select("value", "values").distinct()  # noqa: B023, E731
            rows = rows.join(mends(after), ["value", "values"], "left_anti").join(mends(before), ["value", "values"], "left_semi")
            out.append(rows.select(F.lit(register).alias("register"), "value", F.lit(other).alias("demanded"), "held", F.col("need").alias("room")))
    if not out:
        none = F.lit(None).cast("string")
        return demands.select(none.alias("register"), F.lit(0).alias("value"), none.alias("demanded"), F.lit(0).alias("held"), "room").limit(0)
    return reduce(DataFrame.unionAll, out).distinct()
