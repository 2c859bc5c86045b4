"""Relational idioms: prefixes, runs, collapses, tie-broken choices, bands, grids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.plans.fixpoint import large, many_tasks, walks, written

#: Cells of a tile's side: what hangs together within a tile is one node of the walk of a flood.
TILE = 128


def runs(df: DataFrame, by: str, order: list[str], kind: str) -> DataFrame:
    """by, kind, first, last, length: runs of equal kind in order (gaps and islands)."""
    own = Window.partitionBy(by).orderBy(*order)
    change = F.when(F.lag(kind).over(own).eqNullSafe(F.col(kind)) & (F.row_number().over(own) > 1), 0).otherwise(1)
    found = df.withColumn("_new", change).withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    key = order[-1]
    return found.groupBy(by, "_run", kind).agg(F.min_by(key, F.struct(*order)).alias("first"), F.max_by(key, F.struct(*order)).alias("last"), F.count(F.lit(1)).alias("length")).drop("_run")


def prefixes(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Adds priors: the values of all earlier rows, joined by commas."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("priors", F.array_join(F.collect_list(value).over(before), ","))


def clamped(df: DataFrame, by: str, order: str, value: Column) -> DataFrame:
    """by, carry: a sum in order that never falls below 0. The sum less its lowest prefix (or 0) is that sum."""
    own = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = df.withColumn("_sum", F.sum(value).over(own)).withColumn("_low", F.least(F.lit(0), F.min("_sum").over(own)))
    return found.withColumn("carry", F.col("_sum") - F.col("_low")).drop("_sum", "_low")


def mode(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, n: the most frequent value of each group, the smallest at a tie."""
    counted = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def collapsed(df: DataFrame, by: list[str], merged: str, lowest: str) -> DataFrame:
    """One row for each key: the union of the merged field, sorted, and the lowest value."""
    return df.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set(merged)), ",").alias(merged), F.min(lowest).alias(lowest))


def band_join(left: DataFrame, right: DataFrame, key: str, a: str, b: str, width: int) -> DataFrame:
    """Pairs with equal key whose a and b differ by width at most: an equi-join on bins of that width and the bins beside.

    The pairs are far more than the rows, so the bins are dealt to a number of tasks that does not follow the rows' bytes.
    """
    tasks = many_tasks(left.sparkSession)
    left = left.withColumn("_bin", F.floor(F.col(a) / (width + 1)))
    near = F.explode(F.array(*(F.floor(F.col(b) / (width + 1)) + k for k in (-1, 0, 1))))
    right = right.withColumn("_bin", near)
    dealt = lambda df: large(df.repartition(tasks, key, "_bin"))
    return dealt(left).join(dealt(right), [key, "_bin"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_bin")


def top_of_each(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered in rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _hanging(t: pa.Table) -> pa.Table:
    """x, y, part (the number of a part's first cell in the tile): the cells of one tile by what hangs together within it."""
    x, y = t["x"].to_numpy(), t["y"].to_numpy()
    at_x, at_y = x - x.min() + 1, y - y.min() + 1
    wide = int(at_x.max()) + 2
    none = wide * (int(at_y.max()) + 2)  # beyond all cells; the border is never open
    here = at_y * wide + at_x
    part = np.full(none + 1, none, np.int64)
    part[here] = here
    while True:
        own = part[here]
        least = np.minimum.reduce([part[here + step] for step in (0, 1, -1, wide, -wide)])
        if (least == own).all():
            return pa.table({"x": x, "y": y, "part": own})
        np.minimum.at(part, own, least)  # all of a part hears of what one of its cells meets
        part[here] = part[part[here]]


def flood(cells: DataFrame, seeds: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """x, y: the open cells that hang together with the seeds by their sides. cells: x, y of open cells, 0 <= x < width.

    What hangs together within a tile of cells is found there, tile by tile; only these parts, and where they meet over the sides of tiles, are walked.
    """
    cells = cells.select(F.col("x").cast("long"), F.col("y").cast("long")).where("x is not null and y is not null").distinct()
    tx, ty = F.floor(F.col("x") / tile).alias("_tx"), F.floor(F.col("y") / tile).alias("_ty")
    dealt = cells.select("x", "y", tx, ty).repartition(many_tasks(cells.sparkSession), "_tx", "_ty").groupBy("_tx", "_ty")
    tagged = dealt.applyInArrow(_hanging, "x long, y long, part long").select("x", "y", tx, ty, "part")
    named = F.struct("_tx", "_ty", "part")
    known = written(tagged)
    sides = []
    for column, dx, dy in (("x", 1, 0), ("y", 0, 1)):
        last = known.where(F.pmod(column, F.lit(tile)) == tile - 1).select((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), named.alias("a"))
        sides.append(last.join(large(known.where(F.pmod(column, F.lit(tile)) == 0).select("x", "y", named.alias("b"))), ["x", "y"]).select("a", "b"))
    met = written(sides[0].unionAll(sides[1]).distinct())
    start = seeds.select(F.col("x").cast("long"), F.col("y").cast("long")).distinct().join(large(known), ["x", "y"]).select(named.alias("p")).distinct()
    # a part's number: the first cell of its tile in the rows of all tiles, and its own number there
    number = lambda p: ((F.col(f"{p}._ty") * F.lit(-(-(width + 2) // tile) + 1) + F.col(f"{p}._tx")) * ((tile + 2) ** 2 + 1) + F.col(f"{p}.part")).cast("long")
    arcs = met.select(number("a").alias("src"), number("b").alias("dst"))
    arcs = arcs.unionAll(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("alt", F.lit(None).cast("string"))
    found = walks(start.select(F.lit(0).alias("walk"), number("p").alias("node"), F.lit(None).cast("string").alias("ban")), arcs)
    return known.withColumn("p", named).withColumn("node", number("p")).join(found.select("node"), "node").select("x", "y")


def inside(points: DataFrame, polygon: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """The points inside a polygon, by the parity of the sides that a ray to the right crosses; one expression, no join."""
    crossed = F.lit(0)
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if ay == by:
            continue
        spans = (F.lit(ay) > py) != (F.lit(by) > py)
        crossed = crossed + (spans & (px < F.lit(bx - ax) * (py - F.lit(ay)) / F.lit(by - ay) + F.lit(ax))).cast("int")
    return points.where(crossed % 2 == 1)


def map_entries(packed: DataFrame, column: str = "word") -> DataFrame:
    """Adds kind (upper 5 bits) and number (lower 11 bits) of 16-bit resource words."""
    return packed.withColumn("kind", F.shiftright(column, 11).bitwiseAND(31)).withColumn("number", F.col(column).bitwiseAND(2047))
