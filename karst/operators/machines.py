"""State machines as tables of steps: carried cues, collapsed chains, what every route to a state needs.

step: machine, state, path, trans (PARK, ADVANCE, JUMP, SETSTATE, EXIT, DEATH; a SETSTATE lands one state after its target), target, cues, effects (number), guards (number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.plans.fixpoint import walks, written


def carried(steps: DataFrame) -> DataFrame:
    """Steps whose PARK becomes ADVANCE where a surplus of cues from earlier states reaches them.

    Along the states in order each flowing state uses one cue and adds its own; the least over its paths is carried on, never
    below 0; a state without flowing paths ends the carry. One fold over the ordered states of each machine.
    """
    flows = F.col("trans").isin("PARK", "ADVANCE")
    states = steps.groupBy("machine", "state").agg(F.max(flows.cast("int")).alias("flows"), F.min(F.when(flows, F.col("cues"))).alias("cues"))
    ordered = states.groupBy("machine").agg(F.sort_array(F.collect_list(F.struct("state", "flows", "cues"))).alias("all"))

    def step(acc: Column, s: Column) -> Column:
        on = s["flows"] == 1
        flip = on & (acc["carry"] >= 1)
        carry = F.when(on, F.greatest(F.lit(0), acc["carry"] + s["cues"] - 1)).otherwise(F.lit(0))
        return F.struct(carry.cast("long").alias("carry"), F.when(flip, F.array_append(acc["hit"], s["state"])).otherwise(acc["hit"]).alias("hit"))

    first = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("hit"))
    hit = ordered.select("machine", F.explode(F.aggregate("all", first, step)["hit"]).alias("state")).withColumn("_hit", F.lit(True))
    found = steps.join(hit, ["machine", "state"], "left")
    return found.withColumn("trans", F.when(F.col("_hit") & (F.col("trans") == "PARK"), F.lit("ADVANCE")).otherwise(F.col("trans"))).drop("_hit")


def _landing() -> Column:
    """The state in which a step lands; null if it stays or leaves."""
    return F.when(F.col("trans") == "ADVANCE", F.col("state") + 1).when(F.col("trans") == "JUMP", F.col("target")).when(F.col("trans") == "SETSTATE", F.col("target") + 1)


def compressed(steps: DataFrame, entries: DataFrame, start: int = 0) -> DataFrame:
    """Steps with every landing in a run of states that change nothing moved to the first state after the run.

    A state can be skipped if its only step advances, asks nothing, changes nothing, and it is neither the start nor an entry
    (entries: machine, state).
    Runs are gaps and islands of consecutive states; no loop is needed.
    """
    only = steps.groupBy("machine", "state").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("trans", "guards", "effects")).alias("s"))
    clear = only.where("n = 1 and s.trans = 'ADVANCE' and s.guards = 0 and s.effects = 0").where(F.col("state") != start).join(entries, ["machine", "state"], "left_anti").select("machine", "state")
    island = F.col("state") - F.row_number().over(Window.partitionBy("machine").orderBy("state"))
    runs = clear.withColumn("_run", island)
    last = F.max("state").over(Window.partitionBy("machine", "_run"))
    after = runs.select("machine", F.col("state").alias("landing"), (last + 1).alias("beyond"))
    found = steps.withColumn("landing", _landing()).join(after, ["machine", "landing"], "left")
    moved = F.col("beyond").isNotNull()
    return found.withColumn("trans", F.when(moved, F.lit("JUMP")).otherwise(F.col("trans"))).withColumn("target", F.when(moved, F.col("beyond")).otherwise(F.col("target"))).drop("landing", "beyond")


def arcs(steps: DataFrame) -> DataFrame:
    """machine, state, next: where each step lands."""
    return steps.select("machine", "state", _landing().alias("next")).where("next is not null").distinct()


def needed_by_all(steps: DataFrame, entries: DataFrame) -> DataFrame:
    """machine, state, item: what every entry from which a state is reached asks for. entries: machine, entry, state, items."""
    moves = written(arcs(steps))
    of = F.xxhash64("machine", "state")
    names = moves.select("machine", "state").union(moves.select("machine", "next")).union(entries.select("machine", "state")).distinct().withColumn("node", of)
    seeds = entries.select(F.xxhash64("machine", "entry").alias("walk"), of.alias("node"), F.lit(None).cast("string").alias("ban"))
    reached = walks(seeds, moves.select(of.alias("src"), F.xxhash64("machine", "next").alias("dst"), F.lit(None).cast("string").alias("alt")))
    asked = entries.select(F.xxhash64("machine", "entry").alias("walk"), "items")
    found = reached.join(asked, "walk").join(names, "node").select("machine", "state", "walk", "items")
    many = found.groupBy("machine", "state").agg(F.count_distinct("walk").alias("all"))
    each = found.select("machine", "state", "walk", F.explode("items").alias("item")).groupBy("machine", "state", "item").agg(F.count_distinct("walk").alias("n"))
    return each.join(many, ["machine", "state"]).where(F.col("n") == F.col("all")).select("machine", "state", "item")
