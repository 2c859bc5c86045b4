"""Mixture-controlled packing of documents into training sequences.

Each source is a queue of documents in an order fixed by a hash. In every window of tokens each queue may send its quantum, the
window's size times its target share; what a queue may not yet send it keeps as deficit for the next window (deficit
round-robin). A packet of at most ``grain`` tokens of one document that ends at token c of its queue therefore goes out in window
ceil(c / quantum). That closed form needs no loop over windows: deficits pass over windows and partitions by arithmetic on prefix
sums. The stream of windows is cut every ``length`` tokens; the rest of the last sequence is cut at powers of two, so that
nothing is padded at all.

Prefix sums are taken in two steps, within hash buckets and over buckets, so that neither a large source nor the number of
windows ever gathers its rows in one task. Token ids are written once; only numbers move until the pieces are known.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, large, session_of, staged, task

#: Words of these characters alone need no normalisation beyond lower case, and are cut by PIECE as the tokenizer cuts them.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
#: Entries of each of a worker's two caches (words, and pieces of words), at most about; a full cache starts anew.
CACHED = 600_000


class WordEncoder:
    """Token ids of texts by a tokenizer that never joins what ASCII white space separates: each different word is encoded once.

    Words of plain Latin characters are cut here and their pieces given to the tokenizer's model; all others go through the whole
    tokenizer. Both give the ids that the tokenizer gives for the whole text.
    """

    def __init__(self, path: str, separator: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.separator = Tokenizer.from_file(path), separator
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]  # the bytes that stand for themselves
        hidden = iter(range(256, 512))
        self.byte = [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def _word(self, word: str) -> bytes:
        if not PLAIN(word) or "<|" in word:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
        known, found = self.pieces, []
        for piece in PIECE(word.lower()):
            ids = known.get(piece)
            if ids is None:
                shown = piece if piece.isascii() else "".join(self.byte[b] for b in piece.encode())
                ids = known[piece] = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], self.dtype).tobytes()
            found.append(ids)
        return b"".join(found)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, the separator after each; and the number of ids of each text."""
        for cache in (self.words, self.pieces):
            if len(cache) > CACHED:
                cache.clear()
        lists = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        found, known = [], self.words
        for word in coded.dictionary.to_pylist():
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._word(word)
            found.append(ids)
        found.append(np.array([self.separator], self.dtype).tobytes())
        flat = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        codes = np.full(int(counts.sum()) + len(counts), len(found) - 1, np.int64)
        inner = np.ones(len(codes), bool)
        ends = np.cumsum(counts + 1)
        inner[ends - 1] = False
        codes[inner] = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[codes]
        stops = np.cumsum(each)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - stops + each, each) + np.arange(stops[-1] if len(stops) else 0)]
        return ids, np.diff(np.concatenate([[0], stops])[np.concatenate([[0], ends])])


_ENCODERS: dict = KEPT.setdefault("packing", {})


def encoder_of(path: str, separator: int) -> WordEncoder:
    """The encoder of this worker, kept over its tasks."""
    if (path, separator) not in _ENCODERS:
        _ENCODERS[path, separator] = WordEncoder(path, separator)
    return _ENCODERS[path, separator]


def _tokenized(path: str, separator: int):
    def tokenized(batches):
        from pyspark import TaskContext

        encoder, row = encoder_of(path, separator), TaskContext.get().partitionId() << 36
        for b in batches:
            ids, lengths = encoder(large(b.column("text")))
            bounds = np.concatenate([[0], np.cumsum(lengths)]) * ids.dtype.itemsize
            blobs = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(lengths))), b.column("doc_id"), b.column("queue"), pa.array(lengths, pa.int64()), blobs.cast(pa.binary())],
                names=["row", "doc_id", "queue", "n", "ids"],
            )
            row += len(lengths)

    return task(tokenized, "packing")


def _packets(grain: int):
    """Pieces of documents by window: packets of up to grain tokens, each in the window in which its queue's quanta cover its end."""

    def packets(batches):
        for b in batches:
            a, n, q = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "n", "quantum"))
            many = -(-n // grain)
            doc = np.repeat(np.arange(len(n)), many)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start, end = k * grain, np.minimum((k + 1) * grain, n[doc])
            window = -(-8 * (a[doc] + end) // q[doc]) - 1
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (window[1:] != window[:-1])
            at = np.flatnonzero(new)
            if len(at):
                stop = end[np.append(at[1:], len(doc)) - 1]
                own = doc[at]
                yield pa.RecordBatch.from_pydict(
                    {"row": b.column("row").take(pa.array(own)), "queue": b.column("queue").take(pa.array(own)), "at": a[own] + start[at], "window": window[at], "start": start[at], "length": stop - start[at]}
                )

    return packets


def _cut(length: int, total: int):
    """Pieces at the borders of sequences: every length tokens, and powers of two in the rest."""
    whole, rest, tail = total // length, total % length, [0]
    while rest:
        tail.append(tail[-1] + (1 << rest.bit_length() - 1))
        rest -= tail[-1] - tail[-2]
    tail = np.array(tail, np.int64) + whole * length

    def cut(batches):
        for b in batches:
            row, start, o, n = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("row", "start", "offset", "length"))
            index = lambda x: np.where(x < tail[0], x // length, whole + np.searchsorted(tail, x, "right") - 1)
            begin = lambda s: np.where(s < whole, s * length, tail[np.clip(s - whole, 0, len(tail) - 1)])
            first = index(o)
            many = index(o + n - 1) - first + 1
            own = np.repeat(np.arange(len(n)), many)
            seq = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            a, z = np.maximum(o[own], begin(seq)), np.minimum((o + n)[own], begin(seq + 1))
            yield pa.RecordBatch.from_pydict({"row": row[own], "start": start[own] + a - o[own], "length": z - a, "sequence_id": seq, "offset": a - begin(seq)})

    return cut


def _summed(batches):
    """The checksum of each piece's ids as 32-bit numbers, in place of the ids."""
    for b in batches:
        k = b.schema.get_field_index("ids")
        width = [np.dtype(f"<u{w}") for w in b.column("width").to_pylist()]
        crc = [zlib.crc32(np.frombuffer(x, w).astype("<u4").tobytes()) for x, w in zip(b.column(k).to_pylist(), width, strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length")), pa.array(crc, pa.int64()), *(b.column(c) for c in ("doc_tokens", "sequence_id", "offset"))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def prefix_sum(df: DataFrame, group: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of value over the rows before each, within its group: within hash or range buckets, then over the buckets.

    bucket: a column that is constant or ascending along the order; the rows of one bucket meet in one task.
    """
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_before", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return df.join(sums, [*group, "_bucket"]).withColumn(name, F.col("_base") + F.col("_before")).drop("_base", "_before", "_bucket")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    separator: int = 1,
    length: int = 2048,
    window: int = 1 << 17,
    grain: int = 256,
    mixture: dict[str, float] | None = None,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """Packs all documents; one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id long, text string, source string; other columns are ignored. mixture: each source's target share (default: its
    share of all tokens; a source it does not name gets the mean of those named). A queue that is empty leaves its share to the
    others. tokenizer: path of a tokenizer file whose tokens never span ASCII white space.

    A null text is empty and gives its separator alone; a null source is a queue of its own; a null doc_id is packed like any
    other; repeated rows are packed once each; an empty table gives an empty result.
    """
    session_of(docs)
    queue = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), F.col("text").cast("string").alias("text"))
    ids = staged(docs.mapInArrow(_tokenized(tokenizer, separator), "row long, doc_id long, queue string, n long, ids binary"))
    rows, total = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(1, -(-rows // bucket_rows))

    quanta = ids.groupBy("queue").agg(F.sum("n").alias("_all"))
    share = F.col("_all") / F.lit(float(max(1, total)))
    if mixture:
        mean, whole = sum(mixture.values()) / len(mixture), sum(mixture.values())
        share = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in mixture.items() for x in (f"+{k}", float(v) / whole))), F.col("queue")), F.lit(mean / whole))
    quanta = quanta.select("queue", F.greatest(F.lit(1), F.round(share * F.lit(8.0 * window))).cast("long").alias("quantum"))  # in eighths of a token

    placed = prefix_sum(ids.select("row", "queue", "n"), ["queue"], F.pmod(F.xxhash64("row"), F.lit(buckets)), ["row"], "n", "at").join(quanta, "queue")
    pieces = placed.mapInArrow(_packets(grain), "row long, queue string, at long, window long, start long, length long")
    # windows hold about as many tokens each; their sums go through buckets of 1,024 windows
    within = Window.partitionBy("window").orderBy("queue", "at", "row").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("window").agg(F.sum("length").alias("_tokens")).withColumn("_block", F.shiftright("window", 10))
    bases = prefix_sum(sums.groupBy("_block").agg(F.sum("_tokens").alias("_all")).withColumn("_one", F.lit(0)), ["_one"], F.col("_block"), ["_block"], "_all", "_start").select("_block", "_start")
    inside = Window.partitionBy("_block").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_in", F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).join(bases, "_block").select("window", (F.col("_in") + F.col("_start")).alias("_base"))
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("length").over(within), F.lit(0))).join(sums, "window").select("row", "start", "length", (F.col("_base") + F.col("_before")).alias("offset"))
    pieces = pieces.mapInArrow(_cut(length, int(total)), "row long, start long, length long, sequence_id long, offset long")

    width = F.expr("int(length(ids) / n)")
    cut = ids.select("row", "doc_id", F.col("n").alias("doc_tokens"), width.alias("width"), "ids").join(pieces, "row")
    cut = cut.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "width", F.expr("substring(ids, int(start * width) + 1, int(length * width))").alias("ids"))
    return cut.mapInArrow(_summed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
