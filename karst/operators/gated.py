"""Questions over all register projections at once: what holds only if it holds in each of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.operators.product import many, state_arcs, states
from karst.plans.fixpoint import large, walks, written


def _both(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows that are in each part: one pre-aggregated count of projections."""
    tagged = reduce(DataFrame.unionAll, [p.select(*keys, F.lit(k).alias("projection")) for k, p in enumerate(parts)])
    return tagged.groupBy(*keys).agg(F.count_distinct("projection").alias("n")).where(F.col("n") == len(parts)).select(*keys)


def reach_without(start: DataFrame, projections: list[DataFrame], items: DataFrame) -> DataFrame:
    """item, room: reached in every projection without spending the item."""
    return _both([states(start, ways, items).select("item", "room").distinct() for ways in projections], ["item", "room"])


def reobtainable(start: DataFrame, projections: list[DataFrame], sources: DataFrame) -> DataFrame:
    """item, room: in every projection some state of the room, itself reached, leads to a source without spending the item."""
    named = written(sources.select("item").distinct().withColumn("walk", F.row_number().over(Window.orderBy("item"))))
    parts = []
    for ways in projections:
        n = many(ways)
        arcs = state_arcs(ways, n)
        back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "alt")
        live = states(start, ways).select((F.col("room") * n + F.col("value")).alias("node"))
        seeds = sources.join(named, "item").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        seeds = seeds.select("walk", (F.col("room") * n + F.col("v")).alias("node"), F.col("item").alias("ban"))
        seeds = seeds.join(live, "node", "left_semi")
        inside = back.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi")
        found = walks(seeds, inside.select("src", "dst", "alt")).join(named, "walk")
        parts.append(found.select("item", F.floor(F.col("node") / n).alias("room")).distinct())
    return _both(parts, ["item", "room"])


def flips(start: DataFrame, ways: DataFrame) -> DataFrame:
    """value, node: the states into which some reached state of another value comes by setting the register."""
    n = many(ways)
    live = states(start, ways).select(F.col("room").alias("src"), F.col("value").alias("v"))
    found = ways.join(live, "src").where("(req is null or req = v) and setv is not null and setv <> v")
    return found.select(F.col("setv").alias("value"), (F.col("dst") * n + F.col("setv")).alias("node")).distinct()


def register_strandings(start: DataFrame, ways: DataFrame, sources: DataFrame, needs: DataFrame) -> DataFrame:
    """value, room, item: a flip of the register in room after which the item is asked for, and no source is left."""
    n = many(ways)
    seeds = written(flips(start, ways).withColumn("walk", F.col("node")))  # a flip's value is that of its state
    after = walks(seeds.select("walk", "node", F.lit(None).cast("string").alias("ban")), state_arcs(ways, n))
    rooms = written(after.select("walk", F.floor(F.col("node") / n).alias("room")).distinct())
    asked = rooms.join(needs, "room").select("walk", "item").distinct()
    had = rooms.join(sources, "room").select("walk", "item").distinct()
    there = sources.join(states(start, ways).select("room").distinct(), "room").select("item").distinct()
    gone = asked.join(had, ["walk", "item"], "left_anti").join(there, "item", "left_semi")
    return gone.join(seeds, "walk").select("value", F.floor(F.col("node") / n).alias("room"), "item").distinct()


def dangerous_sinks(drops: DataFrame, needs: DataFrame, reobtainable: DataFrame, pairs) -> DataFrame:
    """item, room, ahead: an item can be lost in room, is asked for in other rooms ahead, and is not to be had from there again.

    pairs: a, b, each once; or what gives them of the rooms (room) that are asked for. A pair of rooms carries the items of its ends as arrays, so that
    it is not multiplied by what is lost in one of them or asked for in the other.
    """
    lost = written(drops.select("item", "room").join(reobtainable, ["item", "room"], "left_anti"))
    at = lost.groupBy("room").agg(F.collect_set("item").alias("_lost"))
    ahead = needs.groupBy(F.col("room").alias("b")).agg(F.collect_set("item").alias("_asked"))
    if callable(pairs):
        pairs = pairs(lost.select("room").distinct())
    met = pairs.withColumnRenamed("a", "room").where("b <> room").join(ahead, "b").join(at, "room")
    found = met.select("room", F.explode(F.array_intersect("_lost", "_asked")).alias("item"))
    return found.groupBy("item", "room").agg(F.count(F.lit(1)).alias("ahead"))


def permanent_drops(moves: DataFrame, drops: DataFrame) -> DataFrame:
    """item, room: dropped there, the item never comes back to its holder. moves: item, src (null: from anywhere), dst; holder is 0.

    An item that nothing ever hands over has no way to be lost and gives no row.
    """
    # what is handed over from anywhere passes through one place of its item, so that no move is multiplied by all places
    at = lambda node, kind=0: F.xxhash64("item", F.lit(kind), node.cast("long"))
    holder, anywhere = at(F.lit(0)), at(F.lit(0), 1)
    places = moves.select("item", F.col("src").alias("node")).unionAll(moves.select("item", "dst")).unionAll(drops.select("item", "room")).where("node is not null").distinct()
    arcs = moves.select(F.when(F.col("src").isNull(), anywhere).otherwise(at(F.col("src"))).alias("src"), at(F.col("dst")).alias("dst"))
    arcs = arcs.unionAll(places.join(large(moves.where("src is null").select("item").distinct()), "item", "left_semi").select(at(F.col("node")).alias("src"), anywhere.alias("dst")))
    handed = drops.select("item", F.col("room").alias("node")).join(large(moves.where("dst = 0").select("item").distinct()), "item", "left_semi").distinct()
    # backward, from the holder of each item: one walk, as no arc leaves its item
    seeds = moves.where("dst = 0").select("item").distinct().select(F.lit(0).alias("walk"), holder.alias("node"), F.lit(None).cast("string").alias("ban"))
    back = walks(seeds, arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(None).cast("string").alias("alt")))
    return handed.withColumn("home", at(F.col("node"))).join(back.select(F.col("node").alias("home")), "home", "left_anti").select("item", F.col("node").alias("room"))
