"""Streaming forms: windowed counts, runs of equal events, and reach that grows with the arcs that arrive."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from karst.operators.graph import reach
from karst.plans.fixpoint import written


def windowed_counts(events: DataFrame, size: str, late: str) -> DataFrame:
    """start, event_type, n, total by event time; events later than the watermark are dropped."""
    found = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def longest_runs(events: DataFrame) -> DataFrame:
    """user_id, kind, length: an update whenever a user's longest run of equal events grows. Events of a batch are put in order of ts."""

    def follow(key, batches, state):
        kind, length, best = state.get if state.exists else (None, 0, 0)
        out = []
        for x in pd.concat(list(batches)).sort_values(["ts", "event_id"])["event_type"]:
            length = length + 1 if x == kind else 1
            kind = x
            if length > best:
                best = length
                out.append((key[0], kind, best))
        state.update((kind, length, best))
        yield pd.DataFrame(out[-1:], columns=["user_id", "kind", "length"])

    shape = "user_id long, kind string, length long"
    return events.groupBy("user_id").applyInPandasWithState(follow, shape, "kind string, length long, best long", "update", GroupStateTimeout.NoTimeout)


def growing_reach(start: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over a stream of arcs (src, dst): after each batch sink gets the rooms reached so far.

    What was reached stays reached, so a batch starts from the last result and follows all arcs seen.
    """
    held: dict[str, DataFrame] = {}

    def batch(arcs: DataFrame, number: int) -> None:
        seen = arcs.select("src", "dst")
        held["arcs"] = written((held["arcs"].unionAll(seen) if "arcs" in held else seen).distinct())
        held["rooms"] = written(reach(held.get("rooms", start), held["arcs"]))
        sink(held["rooms"], number)

    return batch
