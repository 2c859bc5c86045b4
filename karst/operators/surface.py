"""Findings of many detectors as one comparable surface, written as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def surface(findings: dict[str, DataFrame]) -> DataFrame:
    """key, row: each finding as JSON with its columns in order of name, so that equal findings are equal strings."""
    out = None
    for key, df in findings.items():
        own = df.select(F.lit(key).alias("key"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row"))
        out = own if out is None else out.unionAll(own)
    return out


def write_surface(found: DataFrame, path: str) -> None:
    """A folder for each key; rows are ranged and sorted, so that the files compare line by line."""
    found.repartitionByRange("key", "row").sortWithinPartitions("key", "row").write.partitionBy("key").mode("overwrite").text(path)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, row, change: what is gone and what is new, with multiplicities."""
    counted = before.select("key", "row", F.lit(-1).alias("n")).unionAll(after.select("key", "row", F.lit(1).alias("n")))
    return counted.groupBy("key", "row").agg(F.sum("n").alias("n")).where("n <> 0").select("key", "row", F.when(F.col("n") > 0, "new").otherwise("gone").alias("change"))
