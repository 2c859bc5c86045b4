"""Walks over (room, register value) states, with items that a walk may not spend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.plans.fixpoint import walks, written

def many(ways: DataFrame, value: int = 0) -> int:
    """How many values a register has, 0 included: a state is room * many + value. Negative values are an error."""
    either = lambda f: f(F.coalesce("req", F.lit(value)), F.coalesce("setv", F.lit(value)), F.lit(value))
    least, most = ways.agg(F.min(either(F.least)), F.max(either(F.greatest))).first()
    if (least or 0) < 0:
        raise ValueError("values of a register are numbers from 0")
    return int(most if most is not None else value) + 1


def state_arcs(ways: DataFrame, values: int) -> DataFrame:
    """src, dst, alt over states: each way, from each value that it admits, to the value that it leaves."""
    admitted = F.when(F.col("req").isNull(), F.sequence(F.lit(0), F.lit(values - 1))).otherwise(F.array(F.col("req").cast("int")))
    found = ways.withColumn("v", F.explode(admitted))
    return found.select((F.col("src") * values + F.col("v")).alias("src"), (F.col("dst") * values + F.coalesce("setv", "v")).alias("dst"), "alt")


def states(start: DataFrame, ways: DataFrame, items: DataFrame | None = None, value: int = 0) -> DataFrame:
    """item, room, value: the states that are reached from the start at a value, without spending the item (null: no ban).

    start: room; items: item, one walk for each.
    """
    n = many(ways, value)
    at = start.select((F.col("room") * n + value).alias("node"))
    split = [F.floor(F.col("node") / n).alias("room"), F.pmod("node", F.lit(n)).alias("value")]
    if items is None:
        seeds = at.select(F.lit(0).alias("walk"), "node", F.lit(None).cast("string").alias("ban"))
        return walks(seeds, state_arcs(ways, n)).select(F.lit(None).cast("string").alias("item"), *split)
    named = written(items.select("item").distinct().select("item", F.row_number().over(Window.orderBy("item")).alias("walk")))
    seeds = named.crossJoin(F.broadcast(at)).select("walk", "node", F.col("item").alias("ban"))
    return walks(seeds, state_arcs(ways, n)).join(named, "walk").select("item", *split)


def in_all(projections: list[DataFrame]) -> DataFrame:
    """room: in every projection."""
    tagged = None
    for k, p in enumerate(projections):
        own = p.select("room", F.lit(k).alias("projection"))
        tagged = own if tagged is None else tagged.unionAll(own)
    return tagged.groupBy("room").agg(F.count_distinct("projection").alias("n")).where(F.col("n") == len(projections)).select("room")
