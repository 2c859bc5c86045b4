"""Mazes given as door lists: which cells are open toward some direction that nobody names.

doors: maze, list, cell: the cells at which a door of a list stands. rooms: maze, cell, room: cells that are rooms. Offsets are what a step may
add to a cell's number. A door is shared by the two cells that it joins, so two lists are opposite directions if most cells of one, moved
by an offset, are in the other, and back. The best pair for each size of step is an axis if it agrees well enough; the width of the grid
comes out as the size of its step. Passages stay one-way where only one side has a door.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.plans.fixpoint import large, many_tasks, walks, written

OFFSETS = (1, 8, 16, 32)
#: Steps of a maze that one task walks.
MOST_STEPS = 1 << 18


def axes(doors: DataFrame, offsets: tuple[int, ...] = OFFSETS, agree: float = 0.9, fewest: int = 8) -> DataFrame:
    """maze, step, ahead, back, score: lists that are opposite directions, at most one pair for each step.

    Lists of fewer than ``fewest`` cells are no directions, and a maze with fewer than four lists or two axes has none. Ties go to the smaller
    list ahead, then back. Null cells and repeated rows are ignored.
    """
    doors = doors.where("maze is not null and list is not null and cell is not null").select("maze", "list", "cell").distinct()
    size = doors.groupBy("maze", "list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)
    size = size.join(size.groupBy("maze").agg(F.count(F.lit(1)).alias("_lists")).where("_lists >= 4").select("maze"), "maze", "left_semi")
    size = written(size)
    own = doors.join(size.select("maze", "list"), ["maze", "list"], "left_semi")
    moved = own.withColumn("step", F.explode(F.array(*(F.lit(d) for d in sorted(offsets))))).select("maze", F.col("list").alias("ahead"), "step", (F.col("cell") + F.col("step")).alias("cell"))
    met = moved.join(large(own).withColumnRenamed("list", "back"), ["maze", "cell"]).where("ahead <> back").groupBy("maze", "step", "ahead", "back").agg(F.count(F.lit(1)).alias("_met"))
    many = lambda name, out: size.select("maze", F.col("list").alias(name), F.col("n").alias(out))
    # cells of one that are met in the other are as many, moved ahead or back
    score = (F.col("_met") / F.col("_a") + F.col("_met") / F.col("_b")) / 2
    found = met.join(many("ahead", "_a"), ["maze", "ahead"]).join(many("back", "_b"), ["maze", "back"]).withColumn("score", score).where(F.col("score") >= agree)
    best = Window.partitionBy("maze", "step").orderBy(F.desc("score"), "ahead", "back")
    one = found.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    two = one.groupBy("maze").agg(F.count(F.lit(1)).alias("_axes")).where("_axes >= 2").select("maze")
    return one.join(two, "maze", "left_semi").select("maze", "step", "ahead", "back", "score")


def passages(doors: DataFrame, found: DataFrame) -> DataFrame:
    """maze, src, dst: the steps that doors allow, each in its own direction. found: axes()."""
    both = found.select("maze", F.col("ahead").alias("list"), "step").unionAll(found.select("maze", F.col("back").alias("list"), (-F.col("step")).alias("step")))
    return large(doors).join(both, ["maze", "list"]).select("maze", F.col("cell").alias("src"), (F.col("cell") + F.col("step")).alias("dst")).distinct()


def maze_reach(steps: DataFrame, rooms: DataFrame, size: int = 1 << 20, most: int = MOST_STEPS) -> DataFrame:
    """maze, room, to: rooms that can be walked to without passing through a third one: who steps into a room is there.

    steps: maze, src, dst (integers from -size to size). A maze of up to ``most`` steps is walked by one task, as no step leaves it; a larger one
    by a fixpoint over its cells.
    """
    rooms = written(rooms.where("maze is not null and cell is not null and room is not null").select("maze", "cell", "room").distinct())
    steps = written(steps.where("maze is not null and src is not null and dst is not null").select("maze", "src", "dst").distinct())
    wide = written(steps.groupBy("maze").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("maze"))
    if wide.isEmpty():
        return _each(steps, rooms)
    of = lambda df, how: df.join(wide, "maze", how)
    return _each(of(steps, "left_anti"), of(rooms, "left_anti")).unionAll(_walked(of(steps, "left_semi"), written(of(rooms, "left_semi")), size))


def _each(steps: DataFrame, rooms: DataFrame) -> DataFrame:
    """maze, room, to, maze by maze."""

    def walk(moves: pa.Table, places: pa.Table) -> pa.Table:
        onward, named, cells = defaultdict(list), defaultdict(list), defaultdict(list)
        for src, dst in zip(moves["src"].to_pylist(), moves["dst"].to_pylist(), strict=True):
            onward[src].append(dst)
        for cell, room in zip(places["cell"].to_pylist(), places["room"].to_pylist(), strict=True):
            named[cell].append(room)
            cells[room].append(cell)
        found = []
        for room, own in cells.items():
            seen, todo = set(), [dst for cell in own for dst in onward.get(cell, ())]
            while todo:
                cell = todo.pop()
                if cell not in seen:
                    seen.add(cell)
                    if cell not in named:
                        todo += onward.get(cell, ())
            found += [(room, to) for to in {x for cell in seen for x in named.get(cell, ())} if to != room]
        maze = (moves if len(moves) else places)["maze"]
        kind = places.schema.field("room").type
        return pa.table({"maze": pa.array([maze[0].as_py()] * len(found), maze.type), "room": pa.array([r for r, _ in found], kind), "to": pa.array([t for _, t in found], kind)})

    kinds = dict(rooms.dtypes)
    dealt = lambda df: df.repartition(many_tasks(df.sparkSession), "maze").groupBy("maze")
    return dealt(steps.withColumn("maze", F.col("maze").cast(kinds["maze"]))).cogroup(dealt(rooms)).applyInArrow(walk, f"maze {kinds['maze']}, room {kinds['room']}, to {kinds['room']}")


def _walked(steps: DataFrame, rooms: DataFrame, size: int) -> DataFrame:
    """maze, room, to: one walk for each room, all in one fixpoint; rooms are left through copies of their cells, so that no walk goes on from a room that it comes to."""
    wide = 4 * size
    at = lambda cell, copy=0: F.col("maze").cast("long") * (2 * wide) + F.col(cell) + size + copy * wide
    inner = steps.join(rooms.select("maze", F.col("cell").alias("src")), ["maze", "src"], "left_anti").select(at("src").alias("src"), at("dst").alias("dst"))
    leaving = steps.join(rooms.select("maze", F.col("cell").alias("src")), ["maze", "src"], "left_semi").select(at("src", 1).alias("src"), at("dst").alias("dst"))
    named = written(rooms.select("maze", "room").distinct().withColumn("walk", F.monotonically_increasing_id()))
    seeds = rooms.join(named, ["maze", "room"]).select("walk", at("cell", 1).alias("node"), F.lit(None).cast("string").alias("ban"))
    arcs = reduce(DataFrame.unionAll, [inner, leaving]).withColumn("alt", F.lit(None).cast("string"))
    found = walks(seeds, arcs).join(rooms.select(at("cell").alias("node"), F.col("room").alias("to")), "node").join(named, "walk")
    return found.where("room <> to").select("maze", "room", "to").distinct()
