"""Least fixpoints of walks over a relation of arcs.

All walks of a query run together: a walk is a row of seeds, and its states are labelled with it. Arcs below ARCS_SENT rows, with
at most BARS_SENT bars on them, are sent to every task, and each task follows its walks to the end in one pass; more than that are joined round by round
(semi-naive), each round written to the shared folder, until no walk finds a new state. Both give the same rows.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arcs that are sent to every task, at most: 20 bytes each.
ARCS_SENT = 2_000_000
#: Bars on them, of all arcs together, at most: 4 bytes each in a task, some 20 on their way through the driver.
BARS_SENT = 24_000_000
MOST_ROUNDS = 100_000
#: Rows of several walks that leave a task at once.
ROWS_OUT = 1 << 17


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset a local session takes a temporary folder; on a cluster it is an error."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("karst.test.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="karst-")
        spark.conf.set("karst.test.dir", top)
    _WRITTEN.append(f"{top.rstrip('/')}/karst-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and every reader sees the same rows."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._karst_path = path
    return out


def replaced(df: DataFrame, old: DataFrame) -> DataFrame:
    """The rows written, in place of a table of written() that nothing reads from here on; files of shuffles that are done with go too."""
    out, spark = written(df), df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old._karst_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.remove(old._karst_path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


_SHARED: dict = {}


def shared(spark: SparkSession, sf_dir: str, name: str, make, tables: tuple[str, ...] = ("lineitem", "orders", "part", "supplier")):
    """What make() gives, made once for the tables of a folder as they are now: queries of one model share what it wrote.

    It is made anew when a table has changed (by length or time of change) or when what it wrote is no longer there.
    """
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm

    def status(path: str):
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        return (fs.getFileStatus(p).getLen(), fs.getFileStatus(p).getModificationTime()) if fs.exists(p) else None

    key, now = (spark.sparkContext.applicationId, sf_dir, name), tuple(status(f"{sf_dir}/{t}.parquet") for t in tables)
    held = _SHARED.get(key)
    if held is None or held[1] != now or not all(map(status, held[2])):
        before = len(_WRITTEN)
        value = make()
        _SHARED[key] = held = value, now, _WRITTEN[before:]
    return held[0]


def discard_written(spark: SparkSession) -> int:
    """Deletes all tables that queries of this process have written so far; results that were not saved elsewhere can't be read any more."""
    conf, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    _SHARED.clear()
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def walks(seeds: DataFrame, arcs: DataFrame, arcs_sent: int = ARCS_SENT) -> DataFrame:
    """walk, node for every state that each walk reaches, its seeds included.

    seeds: walk long, node long, ban string (null: none). arcs: src long, dst long, and alt string (null: free) or bars array<string> (null or
    empty: free): a walk may not take an arc whose alt is its ban or whose bars have it. Rows with a null walk or node, and arcs with
    a null end, are ignored; repeated rows count once.
    """
    seeds = seeds.select(F.col("walk").cast("long"), F.col("node").cast("long"), F.col("ban").cast("string")).where("walk is not null and node is not null")
    none = F.array().cast("array<string>")
    bars = F.coalesce("bars", none) if "bars" in arcs.columns else F.when(F.col("alt").isNull(), none).otherwise(F.array(F.col("alt").cast("string")))
    arcs = arcs.select(F.col("src").cast("long"), F.col("dst").cast("long"), bars.alias("bars")).where("src is not null and dst is not null and src <> dst").distinct()
    arcs = written(arcs)  # it is read twice
    size = arcs.agg(F.count(F.lit(1)).alias("arcs"), F.coalesce(F.sum(F.size("bars")), F.lit(0)).alias("bars")).first()
    if size["arcs"] <= arcs_sent and size["bars"] <= BARS_SENT:
        return large(_sent(seeds, arcs))
    return large(_joined(seeds, arcs))


def large(df: DataFrame) -> DataFrame:
    """The rows, never to be sent to all tasks by a join: Spark takes what comes out of a walk, or of a well compressed file, for as small as what went in."""
    return df.hint("merge")


def many_tasks(spark: SparkSession) -> int:
    """Tasks for work that is long for its few bytes. Spark merges partitions by bytes alone, but for those whose number is given."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole_groups(batches, key: str):
    """Arrow batches that come sorted by key, as the key and the columns (lists) of one group after the other."""
    held: list[list] | None = None
    of = None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        keys, begin = columns[b.schema.names.index(key)], 0
        for cut in [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else ():
            part = [c[begin:cut] for c in columns]
            if held is not None and of == keys[begin]:
                for mine, more in zip(held, part, strict=True):
                    mine.extend(more)
            else:
                if held is not None:
                    yield of, dict(zip(b.schema.names, held, strict=True))
                held, of = part, keys[begin]
            begin = cut
        names = b.schema.names
    if held is not None:
        yield of, dict(zip(names, held, strict=True))


def dealt(df: DataFrame, key: str, *within: str) -> DataFrame:
    """The rows, whole groups of key in one task each and one group after the other."""
    return df.repartition(many_tasks(df.sparkSession), key).sortWithinPartitions(key, *within)


def _sent(seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    spark = seeds.sparkSession
    table = arcs.toArrow()  # at most ARCS_SENT rows with BARS_SENT bars
    ends, inverse = np.unique(np.concatenate([table["src"].to_numpy(), table["dst"].to_numpy()]), return_inverse=True)
    src, dst = inverse[: len(table)], inverse[len(table) :]
    order = np.argsort(src, kind="stable")
    lists = table["bars"].combine_chunks().take(pa.array(order))
    flat = pc.dictionary_encode(lists.flatten())
    own = np.repeat(np.arange(len(table), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    codes = flat.indices.to_numpy(zero_copy_only=False)
    by = np.argsort(codes, kind="stable")
    names = {x: k for k, x in enumerate(flat.dictionary.to_pylist())}
    closed = own[by], np.searchsorted(codes[by], np.arange(len(names) + 1))
    sent = spark.sparkContext.broadcast((ends, np.searchsorted(src[order], np.arange(len(ends) + 1)), dst[order], names, closed))

    def follow(batches):
        ends, begin, dst, names, (closed, cuts) = sent.value
        open_, seen = np.ones(len(dst), bool), np.zeros(len(ends), bool)
        ready, many_rows = [], 0
        for b in batches:
            for walk, ban, nodes in zip(b.column("walk").to_pylist(), b.column("ban").to_pylist(), b.column("nodes"), strict=True):
                shut = closed[cuts[names[ban]] : cuts[names[ban] + 1]] if ban in names else closed[:0]
                open_[shut] = False
                nodes = nodes.values.to_numpy()
                at = np.searchsorted(ends, nodes)
                known = (at < len(ends)) & (ends[np.minimum(at, max(len(ends) - 1, 0))] == nodes) if len(ends) else np.zeros(len(nodes), bool)
                front = at[known]
                seen[front] = True
                fronts = [front]
                while len(front):
                    many = begin[front + 1] - begin[front]
                    arcs = np.repeat(begin[front] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    reached = dst[arcs[open_[arcs]]]
                    front = np.unique(reached[~seen[reached]])
                    seen[front] = True
                    fronts.append(front)
                open_[shut] = True
                found = np.concatenate(fronts)
                seen[found] = False  # a walk costs what it reaches, not what there is
                ready.append((walk, np.concatenate([ends[found], nodes[~known]])))
                many_rows += len(ready[-1][1])
                if many_rows >= ROWS_OUT:
                    yield _rows(ready)
                    ready, many_rows = [], 0
        if ready:
            yield _rows(ready)

    grouped = seeds.groupBy("walk", "ban").agg(F.collect_set("node").alias("nodes"))
    return grouped.repartition(many_tasks(spark), "walk", "ban").mapInArrow(follow, "walk long, node long")


def _rows(found: list) -> pa.RecordBatch:
    walks_ = np.repeat(np.array([w for w, _ in found], np.int64), [len(nodes) for _, nodes in found])
    return pa.RecordBatch.from_pydict({"walk": walks_, "node": np.concatenate([nodes for _, nodes in found]).astype(np.int64)})


def _joined(seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    front = written(seeds.distinct())
    every = [front]
    for _ in range(MOST_ROUNDS):
        step = front.join(arcs, front["node"] == arcs["src"]).where("ban is null or not array_contains(bars, ban)").select("walk", F.col("dst").alias("node"), "ban").distinct()
        for done in every:
            step = step.join(done, (step["walk"] == done["walk"]) & (step["node"] == done["node"]) & step["ban"].eqNullSafe(done["ban"]), "left_anti")
        front = written(step)
        if front.isEmpty():
            return every[0].select("walk", "node") if len(every) == 1 else _all(every).select("walk", "node")
        every.append(front)
        if len(every) > 8:
            every = [written(_all(every))]
    raise RuntimeError(f"no fixpoint after {MOST_ROUNDS} rounds")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
