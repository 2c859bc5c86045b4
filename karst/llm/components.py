"""Connected components by contraction, and exact Jaccard links within candidate groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_groups, large, mix, pack_sorted, staged, task, unpack_sorted

#: Words of a shingle, and the similarity from which two sets are linked.
SHINGLE, SIMILAR = 5, 0.8
#: Members of a candidate group that are compared in one task; larger groups go through pairs of such chunks.
CHUNK = 1024


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for all nodes of the edges a - b, of any ordered type.

    Every node points to its smallest neighbour if that is smaller; pointers are followed once, the graph is contracted, and so on
    until no edge is left: each round at least halves the nodes of every component. Aggregations are pre-aggregated per task,
    and the joins are plain equi-joins whose large keys Spark can split. Self-loops give single nodes; no edges, no rows.
    """
    nodes = staged(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    rest = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = nodes.select("node", F.col("node").alias("root"))
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a")).toDF("a", "b")
        to = staged(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        on = to.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
        to = staged(to.join(on, F.col("to") == F.col("_a")).select("a", F.col("_to").alias("to")))
        a, b = to.toDF("a", "_p"), to.toDF("b", "_q")
        roots = staged(roots.join(to.toDF("root", "_to"), "root", "left").select("node", F.coalesce("_to", "root").alias("root")))
        rest = rest.join(a, "a").join(b, "b").where("_p <> _q")
        rest = staged(rest.select(F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b")).distinct())
    return roots


#: A random number for each byte, and powers of an odd one with their inverses (made longer as texts ask for them).
_BYTES = np.random.default_rng(17).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers and their inverses, modulo 2^64; a batch's texts bound n."""
    if len(_POWERS[0]) < n:
        _POWERS[:] = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64)), dtype=np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
    return _POWERS[0][:n], _POWERS[1][:n]


def string_hashes(strings: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial of its bytes, all from one prefix sum over the bytes of the array."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    if not len(strings) or offsets[-1] == offsets[0]:
        return mix(np.zeros(len(strings), np.uint64), np.zeros(len(strings), np.uint64))
    data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    powers, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers, out=sums[1:])
        sums = sums[at]
        first = np.minimum(at[:-1], len(data) - 1)
        return mix((sums[1:] - sums[:-1]) * inverse[first], np.diff(at).astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (lower case, cut at white space), and how many each text has."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(large(texts)))
    flat = pc.list_flatten(lists)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    h = string_hashes(flat)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[real], minlength=len(counts))
        h = h[real]
    return h, counts


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """Sorted different hashes of each text's runs of five words (lower case, cut at white space); a shorter text is one run."""
    h, counts = word_hashes(texts)
    run = h.copy()
    for k in range(1, SHINGLE):
        run = mix(run[: len(h) - k], h[k:]) if len(h) > k else run[:0]
    ends = np.cumsum(counts)
    out = []
    for a, z in zip(ends - counts, ends, strict=True):
        if z - a >= SHINGLE:
            out.append(np.unique(run[a : z - SHINGLE + 1]))
        elif z > a:
            one = h[a : a + 1]
            for k in range(a + 1, z):
                one = mix(one, h[k : k + 1])
            out.append(mix(one, np.full(1, z - a, np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def minhash(s: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    with np.errstate(over="ignore"):
        best = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(x), 4096):
            y = x[a : a + 4096, None] * multipliers + offsets
            y ^= y >> np.uint32(15)
            best = np.minimum(best, (y * np.uint32(0x85EBCA6B)).min(axis=0))
    return best


def minhashes(sets: list[np.ndarray], multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """minhash() of each set, a row each."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    best = np.full((len(sets), len(multipliers)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate(sets)
        x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        starts = (np.cumsum(sizes) - sizes)[full]
        with np.errstate(over="ignore"):
            for k, (m, o) in enumerate(zip(multipliers, offsets, strict=True)):
                y = x * m + o
                y ^= y >> np.uint32(15)
                y *= np.uint32(0x85EBCA6B)
                best[full, k] = np.minimum.reduceat(y, starts)
    return best


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of incidence columns; a token of one set alone has none."""
    flat = np.concatenate([*left, *right])
    tokens, inverse, many = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(many > 1) - 1
    kept = many[inverse] > 1
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])[kept]
    col = column[inverse[kept]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(256, (1 << 22) // max(1, len(left) + len(right)))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(col, [a, a + width])
        tile = np.zeros((len(left) + len(right), width), np.float32)
        tile[row[i:j], col[i:j] - a] = 1
        out += tile[: len(left)] @ tile[len(left) :].T
    return out


def _links_of(node: list[bytes], side: np.ndarray, sets: list[np.ndarray], similar: float) -> tuple[np.ndarray, list[int]]:
    """Links of each member of a unit, and the place of the smallest member it hangs together with here. Members come by side, then name."""
    split = int((side == 0).sum())
    same = split in (0, len(node))
    a, b = (np.arange(len(node)), np.arange(len(node))) if same else (np.arange(split), np.arange(split, len(node)))
    size = np.array([len(s) for s in sets], np.float64)
    links = np.zeros(len(node), np.int64)
    if same and len(node) == 2:
        common = np.intersect1d(*sets, assume_unique=True).size
        good = np.array([[False, True], [True, False]]) & (common >= similar * (size.sum() - common) - 1e-9)
    else:
        common = overlaps([sets[k] for k in a], [sets[k] for k in b]).astype(np.float64)
        good = common >= similar * (size[a][:, None] + size[b][None, :] - common) - 1e-9
        if same:
            np.fill_diagonal(good, False)
    links[a] += good.sum(axis=1)
    if not same:
        links[b] += good.sum(axis=0)
    order = np.array(sorted(range(len(node)), key=node.__getitem__), np.int64)
    label = np.empty(len(node), np.int64)  # the place by name of the smallest member known to hang together with each
    label[order] = np.arange(len(node))
    while True:
        new = label.copy()
        new[a] = np.minimum(new[a], np.where(good, label[b][None, :], len(node)).min(axis=1))
        if not same:
            new[b] = np.minimum(new[b], np.where(good, label[a][:, None], len(node)).min(axis=0))
        new = new[order][new]  # a smallest member's own smallest member
        if (new == label).all():
            return links, order[label].tolist()
        label = new


def _linked(similar: float):
    def linked(batches):
        for t, bounds in by_groups(batches, ["candidate", "i", "j"]):
            nodes, sides = t["node"].to_pylist(), t["side"].to_numpy()
            tokens = t["tokens"].to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for a, z in zip(bounds, bounds[1:], strict=False):
                node = nodes[a:z]
                links, to = _links_of(node, sides[a:z], [unpack_sorted(x, np.uint64) for x in tokens[a:z]], similar)
                out[0].extend(node)
                out[1].extend(node[k] for k in to)
                out[2].extend(links.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["node", "to", "links"])

    return task(linked)


def exact_links(members: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """All links of Jaccard similarity ``similar`` or more within candidate groups: node, root of its class, links (partners).

    members: node binary, candidate binary, tokens binary (packed set), one row for each node. A group of more than CHUNK
    nodes is dealt into chunks by a hash of the node, and each pair of chunks is a unit of its own, so no task holds more than
    two chunks. Only counts and spanning links leave a unit, never its pairs.
    """
    members = staged(members)
    sizes = members.groupBy("candidate").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    dealt = members.join(sizes.where("n > 1").select("candidate", "chunks"), "candidate")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("candidate", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "tokens")
    units = dealt.repartition("candidate", "i", "j").sortWithinPartitions("candidate", "i", "j", "side", "node")
    found = staged(units.mapInArrow(_linked(similar), "node binary, to binary, links long"))
    roots = components(found.where("links > 0").select(F.col("node").alias("a"), F.col("to").alias("b")))
    return found.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0").join(roots, "node")


def packed_sets(sets: list[np.ndarray]) -> list[bytes]:
    return [pack_sorted(s) for s in sets]
