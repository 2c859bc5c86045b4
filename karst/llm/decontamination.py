"""Documents that hold passages of a benchmark, found by the q-gram lemma and checked by banded alignment.

Texts are compared as lower-case letters and digits with single blanks. Each benchmark item is cut into overlapping windows. A
region of a document within ``edits`` of a window of m characters shares at least m - q + 1 - q * edits of its q-grams with it,
on diagonals that differ by ``edits`` at most. So the q-grams of every document are looked up in the index of the benchmark,
hits are counted in diagonal bands that overlap by half, and bands that reach the bound are aligned.

Windows that are equal, as those of a template that many items share, are one window with the items it stands for: documents are
held against it once. The index is sent to the executors in blocks of at most BLOCK_CHARS characters of benchmark, whatever its size,
one block at a time; documents are read once for each block and are not shuffled while one block is enough.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import large, release, session_of, staged, task

BLOCK_CHARS = 4 << 20
#: Windows begin this many to a window's length: a passage of a window and a STEPS-th of one more holds a whole window.
STEPS = 4
#: Characters of texts that are searched together.
GROUP_CHARS = 1 << 20
#: Bits of the table that sorts out most q-grams.
TABLE_BITS = 22


@cache
def _folds() -> np.ndarray:
    """For each character its lower-case form, or 0 if it is no letter or digit."""

    def fold(c: int) -> int:
        x = chr(c)
        return (ord(x.lower()) if len(x.lower()) == 1 else c) if x.isalnum() else 0

    return np.fromiter((fold(c) for c in range(0x110000)), np.uint32, 0x110000)


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts with single blanks (as 32), where each stood in its text, and where each text begins (and the end)."""
    c = _folds()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    keep = c > 0
    if len(c):
        keep[1:] |= keep[:-1] & (doc[1:] == doc[:-1])  # the first of each gap
    at = np.flatnonzero(keep)
    chars = np.where(c[at] > 0, c[at], 32).astype(np.uint32)
    return chars, at - first[doc[at]], np.searchsorted(at, np.append(first, len(c)))


def qgrams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on (the last q - 1 places run over the end)."""
    with np.errstate(over="ignore"):
        done, out = 0, np.zeros(len(chars), np.uint64)
        block, size, base = chars.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
        shifted = lambda a, n: np.concatenate([a[n:], np.zeros(min(n, len(a)), np.uint64)])
        power = base
        while done < q:
            if (q - done) & size:
                out = out * power + shifted(block, done)
                done += size
            block = block * power + shifted(block, size)
            power, size = power * power, size * 2
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """q-grams of the windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], q: int, window: int, rate: float):
        self.q, self.rate = q, rate
        chars, _, bounds = folded([t for _, t in items])
        self.items, self.window, keys, posts, offsets = [], [], [], [], []
        known: dict[bytes, int] = {}
        grams = qgrams(chars, q)
        for (item, _), a, z in zip(items, bounds, bounds[1:], strict=False):
            if z > a and chars[z - 1] == 32:
                z -= 1
            starts = [a] if z - a <= window else [*range(a, z - window, max(1, window // STEPS)), z - window]
            for s in starts:
                e = min(z, s + window)
                if e - s < q:
                    continue
                place = known.setdefault(chars[s:e].tobytes(), len(self.window))
                if place < len(self.window):
                    self.items[place].add(item)
                    continue
                n = e - s - q + 1
                keys.append(grams[s : s + n])
                posts.append(np.full(n, place, np.int32))
                offsets.append(np.arange(n, dtype=np.int32))
                self.items.append({item})
                self.window.append(chars[s:e])
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        keys, posts, offsets = join(keys, np.uint64), join(posts, np.int32), join(offsets, np.int32)
        order = np.argsort(keys, kind="stable")
        self.post, self.offset = posts[order], offsets[order]
        self.keys, self.begin = np.unique(keys[order], return_index=True)
        self.begin = np.append(self.begin, len(order))
        self.size = np.array([len(w) for w in self.window], np.int64)
        self.edits = np.minimum((self.size * rate).astype(np.int64), (self.size - q) // q)
        self.bound = self.size - q + 1 - q * self.edits
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def regions(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, window, first character, end, edits) of each window found. Whole texts, about GROUP_CHARS characters at a time."""
        found, a = [], 0
        while a < len(texts):
            z, size = a, 0
            while z < len(texts) and (z == a or size + len(texts[z]) <= GROUP_CHARS):
                size += len(texts[z])
                z += 1
            found += [(a + d, *rest) for d, *rest in self._regions(texts[a:z])]
            a = z
        return found

    def _regions(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        chars, where, bounds = folded(texts)
        grams = qgrams(chars, self.q)
        at = np.flatnonzero(self.table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return []
        key = np.searchsorted(self.keys, grams[at])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == grams[at]
        at, key = at[same], key[same]
        doc = np.searchsorted(bounds, at, "right") - 1
        fits = at + self.q <= bounds[doc + 1]
        at, key, doc = at[fits], key[fits], doc[fits]
        found = []
        step = 1 << 18  # hits spread out at a time; a text's hits may be cut, so neighbours overlap
        cuts = np.searchsorted(doc, np.unique(doc))
        a = 0
        cuts = np.append(cuts, len(doc))
        while a < len(cuts) - 1:
            z = a + 1
            while z < len(cuts) - 1 and cuts[z + 1] - cuts[a] <= step:
                z += 1
            found += self._bands(at[cuts[a] : cuts[z]], key[cuts[a] : cuts[z]], doc[cuts[a] : cuts[z]])
            a = z
        return self._aligned(found, chars, where, bounds)

    def _bands(self, at, key, doc):
        many = self.begin[key + 1] - self.begin[key]
        own = np.repeat(np.arange(len(at)), many)
        post = self.begin[key][own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        window, diagonal = self.post[post], at[own] - self.offset[post]
        width = 2 * self.edits[window] + 1
        out = []
        for half in (0, 1):
            band = (diagonal + half * (width // 2)) // width
            order = np.lexsort((band, window, doc[own]))
            d, w, x = doc[own][order], window[order], band[order]
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (x[1:] != x[:-1])]))
            count = np.diff(np.append(new, len(d)))
            for k in new[count >= self.bound[w[new]]].tolist():
                low = x[k] * width[order[k]] - half * (width[order[k]] // 2)
                out.append((int(d[k]), int(w[k]), int(low), int(low + width[order[k]] - 1)))
        return out

    def _aligned(self, bands, chars, where, bounds):
        done = set()
        for d, w, low, high in sorted(set(bands)):
            e, m = int(self.edits[w]), int(self.size[w])
            a, z = max(int(bounds[d]), low - e), min(int(bounds[d + 1]), high + m + e)
            hit = aligned(self.window[w], chars[a:z], e)
            if hit:
                first, end, edits = hit
                done.add((d, w, int(where[a + first]), int(where[a + end - 1]) + 1, edits))
        return sorted(done)


def aligned(pattern: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """Where the pattern ends best in the region within the edit budget: first, end, edits. The region is the band."""
    n = len(region)
    row, origin, j = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for k, c in enumerate(pattern):
        up, diagonal = row + 1, row[:-1] + (region != c)
        best, start = up.copy(), origin.copy()
        better = diagonal < up[1:]
        best[1:][better], start[1:][better] = diagonal[better], origin[:-1][better]
        slack = best - j  # what a gap in the pattern costs grows by one for each character
        low = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == low, j, 0))
        row, origin = low + j, start[source]
        if row.min() > edits:
            return None
    end = int(row.argmin())
    return (int(origin[end]), end, int(row[end])) if end > origin[end] else None


def _blocks(docs: DataFrame, benchmark: DataFrame, q: int, window: int, rate: float):
    """How many blocks the benchmark has, and the index of each in turn as a broadcast of bounded size, which the caller destroys."""
    spark = session_of(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-2 * chars // BLOCK_CHARS) if chars > BLOCK_CHARS else 1

    def each():
        for block in range(blocks):
            part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) if blocks > 1 else items
            rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # about BLOCK_CHARS characters
            yield spark.sparkContext.broadcast(Index(rows, q, window, rate))

    return blocks, each()


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 10, window: int = 96, rate: float = 0.06) -> DataFrame:
    """One row for each document and benchmark item of which it holds a window: doc_id, item_id, first, last, edits, windows.

    docs: doc_id long, text string; benchmark: item_id long, text string; other columns are ignored. first and last: characters
    (from 0, last exclusive) of the text from the first window found to the last; edits: the fewest of any window. A window has
    ``window`` characters, or the whole item if that is shorter; items of fewer than q characters, null or empty texts hold
    nothing. Repeated documents give the rows of each, repeated items those of one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def searched(index):
        def search(batches):
            for b in batches:
                ids, texts = b.column("doc_id"), large(b.column("text")).to_pylist()
                best: dict[tuple, list] = {}
                for d, w, first, end, edits in index.value.regions(texts):
                    for item in index.value.items[w]:
                        old = best.setdefault((d, item), [first, end, edits, 0])
                        best[d, item] = [min(old[0], first), max(old[1], end), min(old[2], edits), old[3] + 1]
                rows = [(ids[d].as_py(), item, *v) for (d, item), v in best.items()]
                kinds = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("edits", pa.int32()), ("windows", pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

        return task(search)

    shape = "doc_id long, item_id long, first int, last int, edits int, windows int"
    blocks, indexes = _blocks(docs, benchmark, q, window, rate)
    if blocks == 1:
        return docs.mapInArrow(searched(next(indexes)), shape)
    parts = []
    for index in indexes:
        parts.append(staged(docs.mapInArrow(searched(index), shape)))
        index.destroy()
    return reduce(DataFrame.unionAll, parts)  # all texts of one kind, and so all windows of an item, are in one block


def without_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 10, window: int = 96, rate: float = 0.06) -> DataFrame:
    """The rows of docs whose text holds no window of any benchmark item; null texts stay. Rows are judged where they are read."""

    def clean(index):
        def holds_none(texts: pa.Array) -> pa.Array:
            release()
            found = {r[0] for r in index.value.regions(large(texts).to_pylist())}
            return pa.array([k not in found for k in range(len(texts))], pa.bool_())

        return F.arrow_udf(holds_none, "boolean")(F.col("text").cast("string"))

    blocks, indexes = _blocks(docs, benchmark, q, window, rate)
    if blocks == 1:
        return docs.where(clean(next(indexes)))
    text = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    parts = []
    for index in indexes:
        parts.append(staged(text.where(~clean(index)).select(F.sha2("text", 256).alias("_found"))))
        index.destroy()
    found = reduce(DataFrame.unionAll, parts).distinct()
    name = F.sha2(docs["text"].cast("string"), 256)
    return docs.join(found, name.eqNullSafe(found["_found"]), "left_anti")
