"""Findings about registers and properties that only ever go one way: latches, doors that seal themselves, what a flip locks away, what runs out.

writes: register, value. asks: src, dst, register, value that a way asks for. Null values tell nothing and are ignored; repeated rows count
once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.operators.world import BEFORE
from karst.plans.fixpoint import walks, written


def one_way(writes: DataFrame) -> DataFrame:
    """register: those that are only ever written 1, and that at least once."""
    found = writes.where("value is not null").groupBy("register").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return found.where("least = 1 and most = 1").select("register")


def self_sealing(asks: DataFrame, writes: DataFrame) -> DataFrame:
    """src, dst, register: ways that ask for 0 of a register which is raised to 1 somewhere and never written 0: they can be taken until then only."""
    raised = writes.groupBy("register").agg(F.max(F.col("value") == 1).alias("up"), F.max(F.col("value") == 0).alias("down")).where("up and not down")
    return asks.where("value = 0").select("src", "dst", "register").distinct().join(raised, "register", "left_semi").select("src", "dst", "register")


def flip_seals(start: DataFrame, edges: DataFrame, traps: DataFrame, asks: DataFrame, sources: DataFrame, needs: DataFrame) -> DataFrame:
    """register, safe, item, doors: needed items all whose sources lie behind the doors of a trap, and how many doors it has.

    traps: register, safe. A door is an edge with a way that asks for the safe value; once the register has flipped all of them are shut.
    One walk for each trap, all in one fixpoint. A trap without doors and an item without a source give no row.
    """
    named = F.concat_ws("=", "register", F.col("safe").cast("string"))
    doors = written(traps.distinct().join(asks.select("src", "dst", "register", F.col("value").alias("safe")).distinct(), ["register", "safe"]).withColumn("trap", named))
    of = doors.groupBy("register", "safe", "trap").agg(F.count(F.lit(1)).alias("doors"))
    of = written(of.withColumn("walk", F.monotonically_increasing_id()))
    arcs = edges.select("src", "dst").distinct().join(doors.groupBy("src", "dst").agg(F.collect_set("trap").alias("bars")), ["src", "dst"], "left")
    none = F.array().cast("array<string>")
    arcs = arcs.unionAll(start.select(F.lit(BEFORE).alias("src"), F.col("room").alias("dst"), none.alias("bars")))
    seeds = of.select("walk", F.lit(BEFORE).alias("node"), F.col("trap").alias("ban"))
    open_ = written(walks(seeds, arcs).where(F.col("node") != BEFORE).select("walk", F.col("node").alias("room")))
    wanted = sources.join(needs.select("item").distinct(), "item", "left_semi").select("item", "room").distinct()
    free = open_.join(wanted, "room").select("walk", "item").distinct()
    every = wanted.select("item").distinct().crossJoin(of)  # Spark sends the traps only where they are small
    return every.join(free, ["walk", "item"], "left_anti").select("register", "safe", "item", "doors")


def one_way_items(writes: DataFrame) -> DataFrame:
    """item: those with a property that counts, or that is only ever set to one value. writes: item, property, kind (inc or set), value."""
    spec = writes.groupBy("item", "property").agg(F.max(F.col("kind") == "inc").alias("counter"), F.min("value").alias("least"), F.max("value").alias("most"))
    return spec.where("counter or least = most").select("item").distinct()


def exhausted(writes: DataFrame, needs: DataFrame, after: DataFrame) -> DataFrame:
    """item, property, room, ahead: an item that only wears off can be worn in room, and so many other rooms ahead of it still ask for it.

    writes: item, property, room, kind, value; of a property that counts only increments wear. after: after, room.
    """
    counter = writes.where("kind = 'inc'").select("item", "property").distinct().withColumn("counter", F.lit(True))
    worn = writes.join(one_way_items(writes), "item", "left_semi").join(counter, ["item", "property"], "left")
    worn = worn.where((F.col("kind") == "inc") | (F.col("counter").isNull() & F.col("value").isNotNull())).select("item", "property", "room").distinct()
    ahead = after.where("after <> room").join(needs, "room").select("item", F.col("after").alias("room"), F.col("room").alias("_at"))
    found = ahead.groupBy("item", "room").agg(F.count_distinct("_at").alias("ahead"))
    return worn.join(found, ["item", "room"]).select("item", "property", "room", "ahead")
