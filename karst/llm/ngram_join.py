"""Similarity self-join of texts as sets of five-word shingles, by chosen paths.

Each text is a set of shingles; equal sets are one class from the start. In each of several runs a set samples some of its tokens
(a token t if its hash in that run is below 1 / (similarity * size), so that similar sets sample the same tokens), goes into the
bucket of each, samples again within large buckets, and so on, to a depth that grows with the logarithm of the number of texts.
Buckets that are small enough, or at the last level, are compared
by brute force on 128 one-byte minhashes; runs are repeated until a pair at the similarity has met with the target chance. What
passes is joined into candidate groups, and within these every pair is verified on the full sets, whether or not it had met.

Only names, sketches and paths of sets are shuffled for the search; texts are read again for members of candidate groups.
Copies share one class, so a group of copies costs one member; a large group of different near copies is compared in chunk pairs.
"""

from __future__ import annotations

from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_groups, collected, mix, session_of, staged, task
from .components import SIMILAR, components, exact_links, find, hash_family, minhash, packed_sets, set_key, shingles

SKETCH = 128
#: Levels of splitting, at least; and by how many times the texts must grow (as a power of two) for one more.
LEVELS, GROWTH = 3, 6
#: A bucket up to this size is compared at once; larger ones are split while there are levels left.
SMALL = 64
#: Sets of a bucket that are compared in one task.
BLOCK = 2048


def levels_for(texts: int) -> int:
    """Levels of splitting: dissimilar sets that share one common token part at the next level, so the logarithm of the texts is enough."""
    return max(LEVELS, -(-texts.bit_length() // GROWTH))


def runs_for(similar: float, recall: float, levels: int = LEVELS) -> int:
    """Runs after which a pair of the given similarity has met with the target chance, in the worst case of sizes.

    Two such sets sample a common token as often as a Poisson variable of mean 1 is above 0; below it they must meet again.
    """
    meet = 1.0
    for _ in range(levels):
        meet = 1 - exp(-meet)
    return max(1, ceil(log(1 - recall) / log(1 - meet)))


def path_levels(s: np.ndarray, runs: int, similar: float, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the hashes of the chosen paths, and for each of them the place of the path it continues."""
    limit = np.uint64(min((1 << 64) - 1, int((1 << 64) / (similar * len(s)))))
    with np.errstate(over="ignore"):
        parents = np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for _ in range(levels):
        rows, cols = [], []
        step = max(1, (1 << 16) // len(s))
        for a in range(0, len(parents), step):
            own = parents[a : a + step]
            row, col = np.nonzero(mix(np.broadcast_to(s, (len(own), len(s))), own[:, None]) <= limit)
            rows.append(row + a)
            cols.append(col)
        row, col = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols))
        parents = mix(parents[row], s[col])
        out.append((parents, row))
    return out


def _described(runs: int, levels: int, similar: float, family):
    """For each document the name of its set; with it the size, the sketch and the chosen paths."""

    def described(batches):
        for b in batches:
            sets = shingles(b.column("text"))
            out: dict[str, list] = {k: [] for k in ("node", "sketch", "path", "up")}
            for s in sets:
                if len(s):
                    paths = path_levels(s, runs, similar, levels)
                    row = (set_key(s), minhash(s, *family).astype(np.uint8).tobytes(), [x.view(np.int64).tolist() for x, _ in paths], [u.tolist() for _, u in paths])
                else:
                    row = (None, None, None, None)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            kinds = (pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("content"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["doc_id", "content", *out])

    return task(described)


def _compared(least: int):
    """Links of the pairs of a bucket (or of two chunks of it) whose sketches agree often enough; for larger buckets spanning links."""

    def compared(batches):
        for t, bounds in by_groups(batches, ["bucket", "i", "j"]):
            x = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
            side, size = t["side"].to_numpy(), np.diff(bounds)
            mixed = np.minimum.reduceat(side, bounds[:-1]) != np.maximum.reduceat(side, bounds[:-1])
            left, right = [], []
            for n in range(2, 9):
                first = bounds[:-1][(size == n) & ~mixed]
                for p in range(n):
                    for q in range(p + 1, n):
                        hit = first[(x[first + p] == x[first + q]).sum(axis=1) >= least] if len(first) else first
                        left.append(hit + p)
                        right.append(hit + q)
            for k in np.flatnonzero((size > 8) | ((size > 1) & mixed)).tolist():
                a, z = int(bounds[k]), int(bounds[k + 1])
                parent = list(range(z - a))
                for i in range(z - a):
                    hit = np.flatnonzero((x[a + i + 1 : z] == x[a + i]).sum(axis=1) >= least) + i + 1
                    for j in (hit[side[a + hit] != side[a + i]] if mixed[k] else hit).tolist():
                        r, s = find(parent, i), find(parent, j)
                        parent[max(r, s)] = min(r, s)
                to = [find(parent, i) for i in range(z - a)]
                own = [i for i in range(z - a) if to[i] != i]
                left.append(np.array([a + to[i] for i in own], np.int64))
                right.append(np.array([a + i for i in own], np.int64))
            node = t["node"].combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate(v) if v else np.zeros(0, np.int64))) for v in (left, right)], names=["a", "b"])

    return task(compared)


def _members(batches):
    for b in batches:
        sets = shingles(b.column("text"))
        right = [len(s) > 0 and set_key(s) == n for s, n in zip(sets, b.column("node").to_pylist(), strict=True)]
        kept = pa.array(right)
        yield pa.RecordBatch.from_arrays([b.column("node").filter(kept), b.column("candidate").filter(kept), pa.array(packed_sets([s for s, r in zip(sets, right, strict=True) if r]), pa.binary())], names=["node", "candidate", "tokens"])


def candidate_edges(sets: DataFrame, similar: float, levels: int) -> DataFrame:
    """Spanning links between sets that met in a bucket and whose sketches agree. sets: node, sketch, path, up; repeated rows count once."""
    # three standard deviations below what a pair at the similarity agrees in
    expected = similar + (1 - similar) / 256
    least = int(SKETCH * (expected - 3.3 * (expected * (1 - expected) / SKETCH) ** 0.5))
    buckets = None
    # copies go while a set is still one row; their paths are equal, and a least one, unlike a first one, lets Spark reuse the shuffle
    single = sets.groupBy("node").agg(F.min(F.col("path")[0]).alias("paths"))
    rows = single.select("node", F.posexplode("paths").alias("place", "bucket"))
    for level in range(levels):
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = rows.join(sizes, "bucket")
        own = (found if level == levels - 1 else found.where(F.col("n") <= SMALL)).select("node", "bucket", "n")
        buckets = own if buckets is None else buckets.unionAll(own)
        if level < levels - 1:
            below = sets.select("node", F.col("path")[level + 1].alias("p"), F.col("up")[level + 1].alias("u")).dropDuplicates(["node"])
            split = found.where(F.col("n") > SMALL).select("node", "place").join(below, "node")
            own = F.expr("filter(transform(p, (x, k) -> struct(k as place, x as bucket, u[k] as up)), c -> c.up = place)")
            rows = split.select("node", F.explode(own).alias("c")).select("node", "c.place", "c.bucket")
    buckets = staged(buckets)
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = buckets.withColumn("chunks", chunks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("node", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    dealt = dealt.join(sets.select("node", "sketch").dropDuplicates(["node"]), "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    return dealt.mapInArrow(_compared(least), "a binary, b binary").distinct()


def ngram_join(docs: DataFrame, similar: float = SIMILAR, recall: float = 0.999) -> DataFrame:
    """doc_id, content, class_id, links, copies and root for each document.

    docs: doc_id long, text string; other columns are ignored. Documents whose sets have a Jaccard similarity of ``similar`` or
    more are linked; class_id is the smallest doc_id of all that hang together by links, links the number of different other sets
    that the document's own is linked to, copies the number of documents with exactly its set. root names the class, content is a
    hash of the text. Null texts and texts without words have no set: each is its own class, with 0 links and root null. A null doc_id is never a class_id unless
    all its class has none. Repeated rows are copies of each other.
    """
    session_of(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = "doc_id long, content long, node binary, sketch binary, path array<array<long>>, up array<array<int>>"
    levels = levels_for(docs.select().count())
    known = staged(docs.withColumn("content", F.xxhash64("text")).mapInArrow(_described(runs_for(similar, recall, levels), levels, similar, hash_family(SKETCH, 11)), shape))
    named = known.where("node is not null")
    heads = named.groupBy("node").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    candidates = components(staged(candidate_edges(named, similar, levels)))
    collected(docs.sparkSession)  # the search's shuffle files go before texts are read again
    # texts of members: one document of each candidate set, found again by its id and told apart by its set's name
    of = candidates.join(heads, "node").select("node", F.col("root").alias("candidate"), F.col("head").alias("_head"))
    members = docs.join(of, docs["doc_id"].eqNullSafe(of["_head"])).select("text", "node", "candidate").mapInArrow(task(_members), "node binary, candidate binary, tokens binary")
    linked = exact_links(members.dropDuplicates(["node"]), similar)
    classes = heads.join(linked, "node", "left").select("node", "head", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    classes = staged(classes)
    ids = classes.groupBy("root").agg(F.min("head").alias("class_id"))
    classes = classes.join(ids, "root").select("node", "root", "class_id", "links", "copies")
    found = known.select("doc_id", "content", "node").join(classes, "node", "left")
    alone = F.col("node").isNull()
    return found.select("doc_id", "content", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(1)).alias("copies"), "root")


def one_of_each(docs: DataFrame, similar: float = SIMILAR, recall: float = 0.999) -> DataFrame:
    """The rows of docs that stay when one document of each class of ngram_join() does: that with the smallest doc_id.

    Rows without words have no class and stay; so does a class without doc_id, with one of its documents. Of rows that repeat
    both doc_id and text, one stays.
    """
    found = ngram_join(docs, similar, recall).where("root is null or class_id <=> doc_id").select("doc_id", "content", F.coalesce("root", F.lit(b"")).alias("root"))
    worded = F.length("root") > 0
    kept = found.where(worded).groupBy("root").agg(F.min("doc_id").alias("_doc"), F.min("content").alias("_content")).select("_doc", "_content", F.lit(True).alias("_one"))
    kept = kept.unionAll(found.where(~worded).select("doc_id", "content", F.lit(False)).distinct())
    named = {c: f"_own_{k}" for k, c in enumerate(docs.columns)}  # no column of docs can be taken for one of ours
    stay = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items())).withColumn("_hash", F.xxhash64(F.col(named["text"]).cast("string")))
    stay = stay.join(kept, F.col(named["doc_id"]).cast("long").eqNullSafe(F.col("_doc")) & F.col("_hash").eqNullSafe(F.col("_content")))
    stay = stay.withColumn("_row", F.when(F.col("_one"), F.lit(0)).otherwise(F.monotonically_increasing_id()))
    return stay.dropDuplicates([named["doc_id"], "_hash", "_row"]).select(*(F.col(n).alias(c) for c, n in named.items()))
