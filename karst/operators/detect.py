"""Findings: what can no longer be had, and where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions import guards
from karst.operators.world import numbered
from karst.plans.fixpoint import large, walks, written


def reaching(places: DataFrame, arcs: DataFrame, rooms: DataFrame) -> DataFrame:
    """item, room: rooms from which some place (item, room) of the item is reached. One walk backward for each item; no pairs of rooms are made."""
    named = written(numbered(places.where("item is not null"), "item"))
    seeds = places.join(named, "item").select(F.col("place").alias("walk"), F.col("room").alias("node"), F.lit(None).cast("string").alias("ban"))
    back = walks(seeds, arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(None).cast("string").alias("alt")))
    found = back.select("walk", F.col("node").alias("room")).join(large(rooms.select("room").distinct()), "room", "left_semi")
    return found.join(named.withColumnRenamed("place", "walk"), "walk").select("item", "room")


def reobtainable(sources: DataFrame, arcs: DataFrame, rooms: DataFrame) -> DataFrame:
    """item, room: some source of the item is reached from room. rooms: room."""
    return reaching(sources, arcs, rooms)


def edge_strandings(arcs: DataFrame, needs: DataFrame, sources: DataFrame, rooms: DataFrame) -> DataFrame:
    """src, dst, item: a crossing without return after which an item that was to be had is asked for and gone."""
    arcs = written(arcs)
    had = large(written(reobtainable(sources, arcs, rooms)))
    oneway = arcs.join(large(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), ["src", "dst"], "left_anti")
    ahead = reaching(needs, arcs, rooms).withColumnRenamed("room", "dst")
    lost = ahead.join(had.withColumnRenamed("room", "dst"), ["item", "dst"], "left_anti")
    return oneway.join(large(lost), "dst").join(had.withColumnRenamed("room", "src"), ["item", "src"], "left_semi").select("src", "dst", "item").distinct()


def summary(strandings: DataFrame, first: int = 6) -> DataFrame:
    """item, crossings, frontier: the first rooms behind which each item is lost."""
    found = strandings.groupBy("item").agg(F.count(F.lit(1)).alias("crossings"), F.sort_array(F.collect_set("dst")).alias("all"))
    return found.select("item", "crossings", F.array_join(F.slice("all", 1, first), ",").alias("frontier"))


def disjunctive_groups(offers: DataFrame) -> DataFrame:
    """site, members: sites with two alternatives or more, none free, that have nothing in common; members asks for any."""
    found = offers.groupBy("site").agg(F.collect_set("alt").alias("alts"))
    alts = F.col("alts")
    open_ = (F.size(alts) >= 2) & ~F.exists(alts, lambda a: F.size(a) == 0) & (F.size(guards.common(alts)) == 0)
    return found.where(open_).select("site", guards.mentioned(alts).alias("members"))


def group_strandings(groups: DataFrame, without: DataFrame, reached: DataFrame, had: DataFrame) -> DataFrame:
    """site: faced when every source of its group is out of reach. without: site, room reached without the group; had: item, room."""
    gone = groups.select("site", F.explode("members").alias("item")).join(had, "item").where("site = room").select("site").distinct()
    return groups.select("site").join(reached.withColumnRenamed("room", "site"), "site", "left_semi").join(without.where("site = room"), "site", "left_semi").join(gone, "site", "left_anti")


def blocked_edges(ways: DataFrame, banned: list[str]) -> DataFrame:
    """src, dst: edges each way of which costs a banned item."""
    alts = F.collect_list(F.when(F.col("alt").isNull(), F.array().cast("array<string>")).otherwise(F.array("alt")))
    found = ways.groupBy("src", "dst").agg(alts.alias("alts"))
    return found.where(guards.blocked(F.col("alts"), F.array(*map(F.lit, banned)))).select("src", "dst")


def edge_demands(ways: DataFrame) -> DataFrame:
    """src, dst, item: what every way of an edge costs."""
    found = ways.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.count("alt").alias("priced"), F.min("alt").alias("item"), F.max("alt").alias("other"))
    return found.where("n = priced and item = other").select("src", "dst", "item")


def freely_reversible(ways: DataFrame) -> DataFrame:
    """src, dst: edges whose way back has a way that costs no item and asks nothing of the register."""
    free = ways.where("alt is null and req is null").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return ways.select("src", "dst").distinct().join(free, ["src", "dst"], "left_semi")


def free_running_traps(ways: DataFrame) -> DataFrame:
    """value, forced, reset: values that more rooms force than rooms reset to another."""
    forced = ways.where("setv is not null").groupBy(F.col("setv").alias("value")).agg(F.count_distinct("dst").alias("forced"))
    reset = ways.where("req is not null and setv is not null and req <> setv").groupBy(F.col("req").alias("value")).agg(F.count_distinct("dst").alias("reset"))
    return forced.join(reset, "value", "left").select("value", "forced", F.coalesce("reset", F.lit(0)).alias("reset")).where("forced > reset")


def tolls(pockets: DataFrame, ways: DataFrame, needs: DataFrame, sources: DataFrame) -> DataFrame:
    """src, dst, toll, item: an item that a pocket asks for, none of whose sources is inside, and another one is the toll."""
    toll = edge_demands(ways).withColumnRenamed("item", "toll")
    inside = pockets.join(toll, ["src", "dst"])
    asked = inside.join(needs, "room").select("src", "dst", "toll", "item").distinct()
    there = pockets.join(sources, "room").select("src", "dst", "item").distinct()
    return asked.join(there, ["src", "dst", "item"], "left_anti").where("item <> toll").join(sources.select("item"), "item", "left_semi").select("src", "dst", "toll", "item")
