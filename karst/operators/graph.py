"""Reachability, components, condensation, cuts and matching over relations of arcs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from karst.plans.fixpoint import ROWS_OUT, dealt, large, walks, whole_groups, written


def _plain(arcs: DataFrame) -> DataFrame:
    return arcs.select("src", "dst", F.lit(None).cast("string").alias("alt"))


def closure(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """a, b: b is reached from a, each node from itself. nodes: room."""
    seeds = nodes.select(F.col("room").alias("walk"), F.col("room").alias("node"), F.lit(None).cast("string").alias("ban"))
    return walks(seeds, _plain(arcs)).select(F.col("walk").alias("a"), F.col("node").alias("b"))


def reach(starts: DataFrame, arcs: DataFrame) -> DataFrame:
    """room: everything that is reached from any of the starts."""
    seeds = starts.select(F.lit(0).alias("walk"), F.col("room").alias("node"), F.lit(None).cast("string").alias("ban"))
    return walks(seeds, _plain(arcs)).select(F.col("node").alias("room"))


def backward(goals: DataFrame, arcs: DataFrame) -> DataFrame:
    """goal, room: room reaches goal."""
    seeds = goals.select(F.col("room").alias("walk"), F.col("room").alias("node"), F.lit(None).cast("string").alias("ban"))
    return walks(seeds, _plain(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).select(F.col("walk").alias("goal"), F.col("node").alias("room"))


def strong_components(nodes: DataFrame, arcs: DataFrame, first: int = 64, growth: int = 16) -> DataFrame:
    """room, component (its smallest room), size. Rooms hang together when each reaches the other.

    Rooms that nothing enters or leaves are alone. Of the rest some rooms, chosen by hash, are walked from forward and backward: what both walks
    reach is the room's component, which then leaves the arcs. The chosen ones become more each time, until no room is left; few of them find
    the large components, so that the later, many, walks are short.
    """
    own = written(nodes.select("room").where("room is not null").distinct())
    arcs = written(arcs.select("src", "dst").where("src <> dst").distinct())
    left, out, many = own, [], first
    none = F.lit(None).cast("string").alias("ban")
    back = lambda df: df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    while not left.isEmpty():
        through = arcs.select(F.col("src").alias("room")).intersect(arcs.select(F.col("dst").alias("room")))
        inner = written(left.join(large(through), "room", "left_semi"))
        alone = left.join(large(inner), "room", "left_anti").select("room", F.col("room").alias("component"))
        chosen = written(inner.orderBy(F.xxhash64("room"), "room").limit(many)) if inner.count() > many else inner
        seeds = chosen.select(F.col("room").alias("walk"), F.col("room").alias("node"), none)
        ahead = walks(seeds, _plain(arcs)).join(walks(seeds, _plain(back(arcs))), ["walk", "node"])
        ahead = written(ahead.withColumnRenamed("node", "room"))
        named = ahead.join(large(own), "room", "left_semi").groupBy("walk").agg(F.min("room").alias("component"))
        found = written(ahead.join(large(named), "walk").select("room", "component").distinct().unionAll(alone))
        out.append(found.join(large(own), "room", "left_semi"))
        gone = large(found.select("room"))
        left = written(left.join(gone, "room", "left_anti"))
        arcs = written(arcs.join(gone.withColumnRenamed("room", "src"), "src", "left_anti").join(gone.withColumnRenamed("room", "dst"), "dst", "left_anti"))
        many *= growth
    found = reduce(DataFrame.unionAll, out) if out else own.select("room", F.col("room").alias("component"))
    return found.join(large(found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))), "component").select("room", "component", "size")


def condensation(components: DataFrame, arcs: DataFrame) -> DataFrame:
    """src, dst: arcs between components."""
    of = components.select("room", "component")
    a, b = of.toDF("src", "from"), of.toDF("dst", "to")
    return arcs.join(large(a), "src").join(large(b), "dst").where(F.col("from") != F.col("to")).select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


def roots(arcs: DataFrame) -> DataFrame:
    """room: arcs leave it and none arrives."""
    return arcs.select(F.col("src").alias("room")).distinct().join(arcs.select(F.col("dst").alias("room")), "room", "left_anti")


def terminals(arcs: DataFrame) -> DataFrame:
    """room: arcs arrive and none leaves."""
    return arcs.select(F.col("dst").alias("room")).distinct().join(arcs.select(F.col("src").alias("room")), "room", "left_anti")


def middle(nodes: DataFrame, arcs: DataFrame, many: int = 64) -> tuple[DataFrame, DataFrame, float]:
    """What one room reaches (node), what reaches it (node), and how much a room reaches in the mean: of some rooms, chosen by hash, that with most of both.

    Whatever reaches that room reaches all that it does: in a graph that hangs together most rooms share most of what they reach.
    """
    chosen = written(nodes.select("room").orderBy(F.xxhash64("room"), "room").limit(many))
    seeds = chosen.select(F.col("room").alias("walk"), F.col("room").alias("node"), F.lit(None).cast("string").alias("ban"))
    ahead = written(walks(seeds, _plain(arcs)))
    behind = written(walks(seeds, _plain(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    each = [{r["walk"]: r["count"] for r in df.groupBy("walk").count().collect()} for df in (ahead, behind)]  # a row for each chosen room
    best = max(sorted(each[0]), key=lambda w: each[0][w] * each[1][w], default=None)
    mean = sum(each[0].values()) / max(len(each[0]), 1)
    of = lambda df: large(df.where(F.col("walk") == best).select("node"))
    return of(ahead), of(behind), mean


def widest(nodes: DataFrame, arcs: DataFrame, pairs: int = 4_000_000) -> DataFrame:
    """room, reach: the room that reaches most, the smallest at a tie. nodes: room.

    Where some pairs are to be expected at most, each room is walked from. Else what reaches a middle (see there) shares what that reaches: rooms on
    both sides of it reach just that, and the others before it are walked from to its border. What doesn't reach it can't reach what does, so
    the rest is looked at on its own, and not at all if it is less than what was found; a middle that little reaches doesn't help, and all is walked.
    """
    own = written(nodes.select(F.col("room").cast("long").alias("room")).where("room is not null").distinct())
    arcs = written(arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct())
    left = written(own.unionAll(arcs.select("src")).unionAll(arcs.select("dst")).distinct())
    none, out, best, before = F.lit(None).cast("string").alias("ban"), [own.select("room", F.lit(0).cast("long").alias("reach")).limit(0)], 0, None
    while (size := left.count()) >= best and (many := own.count()):
        walked = lambda rooms, over: walks(rooms.select(F.col("room").alias("walk"), F.col("room").alias("node"), none), _plain(over)).groupBy(F.col("walk").alias("room")).agg(F.count(F.lit(1)).alias("reach"))
        ahead, behind, mean = middle(own, arcs)
        if many * mean <= pairs or (before and before - size < before / 16):
            out.append(written(walked(own, arcs)))
            break
        ahead, behind = ahead.withColumnRenamed("node", "room"), behind.withColumnRenamed("node", "room")
        shared = ahead.count()
        reaching = written(own.join(behind, "room", "left_semi"))
        outer = reaching.join(ahead, "room", "left_anti")
        outside = written(arcs.join(ahead.withColumnRenamed("room", "dst"), "dst", "left_anti"))
        core = reaching.join(ahead, "room", "left_semi").select("room", F.lit(shared).cast("long").alias("reach"))
        out.append(written(core.unionAll(walked(outer, outside).select("room", F.col("reach") + shared))))
        best = max(best, out[-1].agg(F.max("reach")).first()[0] or 0)
        own, left = written(own.join(behind, "room", "left_anti")), written(left.join(behind, "room", "left_anti"))
        arcs, before = written(arcs.join(behind.withColumnRenamed("room", "src"), "src", "left_anti")), size
    return reduce(DataFrame.unionAll, out).orderBy(F.desc("reach"), "room").limit(1)


def dominators(src: np.ndarray, dst: np.ndarray, many: int) -> np.ndarray:
    """The immediate dominator of each node but 0, by Semi-NCA; 0, the root, reaches all nodes 0 to many - 1."""

    def listed(a: np.ndarray, b: np.ndarray) -> list[list[int]]:
        order = np.argsort(a, kind="stable")
        cuts, b = np.searchsorted(a[order], np.arange(many + 1)).tolist(), b[order].tolist()
        return [b[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    ahead, behind = listed(src, dst), listed(dst, src)
    number, nodes, parent, left = [-1] * many, [], [0] * many, [(0, 0)]
    while left:
        v, above = left.pop()
        if number[v] < 0:
            parent[len(nodes)], number[v] = above, len(nodes)
            left.extend((w, number[v]) for w in ahead[v] if number[w] < 0)
            nodes.append(v)
    least, semi, over = list(range(many)), list(range(many)), parent.copy()
    for i in range(many - 1, 0, -1):
        best = i
        for u in behind[nodes[i]]:
            path, u = [], number[u]
            if u > i:  # compressed along the way to what is not yet linked
                while over[u] > i:
                    path.append(u)
                    u = over[u]
                top, low = over[u], least[u]
                for x in reversed(path):
                    low = least[x] = min(least[x], low)
                    over[x] = top
                best = min(best, low)
            else:
                best = min(best, u)
        semi[i] = least[i] = best
    above = parent.copy()
    for i in range(1, many):
        while above[i] > semi[i]:
            above[i] = above[above[i]]
    found = np.zeros(many, np.int64)
    found[nodes] = np.array(nodes, np.int64)[above]
    return found


def _bridges(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the nearest node, itself included, that all ways to it enter by one arc; the source of the arc into itself; its dominator. -1: there is none, or it is 0."""
    many = int(dst.max()) + 1
    up = dominators(src, dst, many)
    order = np.argsort(up[1:], kind="stable") + 1
    cuts = np.searchsorted(up[order], np.arange(many + 1))
    begin, end = np.zeros(many, np.int64), np.zeros(many, np.int64)
    turn, left, visited = 0, [(0, False)], []
    while left:
        v, done = left.pop()
        if done:
            end[v] = turn
            continue
        begin[v], turn = turn, turn + 1
        visited.append(v)
        left.append((v, True))
        left.extend((k, False) for k in order[cuts[v] : cuts[v + 1]].tolist())
    below = (begin[dst] <= begin[src]) & (begin[src] < end[dst])  # the arc comes back from what is only reached through its end
    alone = np.bincount(dst[~below], minlength=many) == 1
    alone[0] = False
    of = np.full(many, -1, np.int64)
    one = ~below & alone[dst]
    of[dst[one]] = src[one]
    alone &= of > 0
    nearest = np.full(many, -1, np.int64)
    for v in visited:
        nearest[v] = v if alone[v] else nearest[up[v]] if v else -1
    return nearest, np.where(alone, of, -1), up


def _pocket_tree(batches):
    """node, src, nearest, above of what is reached: src of the arc that all ways to it take last, if there is one, and the nearest such node, and that above a node itself."""
    t = pa.Table.from_batches(list(batches), pa.schema([("src", pa.int64()), ("dst", pa.int64())]))
    if len(t):
        names = np.unique(t["dst"].to_numpy())
        place = lambda c: np.searchsorted(names, c.to_numpy()) + 1
        src = np.where(np.array(t["src"].is_null()), 0, place(t["src"].fill_null(0)))
        dst = place(t["dst"])
        ends = np.concatenate([[0], names])
        nearest, of, over = _bridges(src, dst)
        up = np.full(len(ends), -1, np.int64)
        up[1:] = np.where(over[1:] > 0, nearest[over[1:]], -1)
        name = lambda x: pa.array(ends[np.maximum(x, 0)][1:], mask=(x < 0)[1:])
        yield pa.RecordBatch.from_pydict({"node": pa.array(names), "src": name(of), "nearest": name(nearest), "above": name(up)})


def pockets(start: DataFrame, arcs: DataFrame) -> DataFrame:
    """src, dst, room: rooms that the starts reach only over that arc.

    Such an arc is the only one into its end but for those that come back to it, so it is told from the dominators of the rooms, which one task
    finds in time that grows with the arcs (some 100 bytes of memory each); then each room walks up over the arcs that it hangs on.
    """
    arcs = arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()
    arcs = written(arcs)
    starts = start.select(F.col("room").cast("long").alias("room")).where("room is not null").distinct()
    full = written(reach(starts, arcs))
    inside = arcs.join(large(full.withColumnRenamed("room", "src")), "src", "left_semi").select("src", "dst")
    rooted = inside.unionAll(starts.select(F.lit(None).cast("long").alias("src"), F.col("room").alias("dst")))
    tree = written(rooted.repartition(1).mapInArrow(_pocket_tree, "node long, src long, nearest long, above long"))
    seeds = tree.where("nearest is not null").select(F.col("node").alias("walk"), F.col("nearest").alias("node"), F.lit(None).cast("string").alias("ban"))
    hangs = tree.where("src is not null and above is not null").select(F.col("node").alias("src"), F.col("above").alias("dst"), F.lit(None).cast("string").alias("alt"))
    named = tree.where("src is not null").select("src", F.col("node").alias("dst"))
    return walks(seeds, hangs).select(F.col("walk").alias("room"), F.col("node").alias("dst")).join(named, "dst").select("src", "dst", "room")


def saturating(consumers: DataFrame) -> DataFrame:
    """market, consumers, tokens, saturated: whether each consumer of a market can have a token of its own.

    consumers: market, consumer, tokens (array). Augmenting paths, one market at a time; markets are the unit of distribution, and a task goes through its own one after the other.
    """

    def solve(wants: dict) -> tuple[int, int, bool]:
        owner: dict = {}

        def place(consumer) -> bool:
            """A breadth-first search for a free token; then tokens are handed on along the way it was found."""
            came: dict = {}
            held = {c: token for token, c in owner.items()}
            queue = [consumer]
            for c in queue:
                for token in wants[c]:
                    if token in came:
                        continue
                    came[token] = c
                    if token in owner:
                        queue.append(owner[token])
                        continue
                    while token is not None:
                        owner[token] = came[token]
                        token = held.get(came[token])
                    return True
            return False

        done = sum(place(c) for c in sorted(wants))
        tokens = {x for w in wants.values() for x in w}
        return len(wants), len(tokens), done == len(wants)

    def each(batches):
        found: list = []
        for market, rows in whole_groups(batches, "market"):
            found.append((market, *solve(dict(zip(rows["consumer"], rows["tokens"], strict=True)))))
            if len(found) >= ROWS_OUT:
                yield out(found)
                found = []
        if found:
            yield out(found)

    def out(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), shape, strict=True)], schema=shape)

    schema = T.StructType([T.StructField("market", consumers.schema["market"].dataType), T.StructField("consumers", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("saturated", T.BooleanType())])
    shape = to_arrow_schema(schema)
    return dealt(consumers.select("market", "consumer", "tokens"), "market").mapInArrow(each, schema)
