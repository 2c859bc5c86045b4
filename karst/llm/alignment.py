"""Alignment of two tokenizers over a corpus: groups of tokens between common borders, and links of tokens that overlap, with their counts.

Both tokenizers cut a text before white space that follows anything else, and join nothing over such a border (checked against the
vocabularies when they are loaded). So a text is taken apart into units there, and each different unit is tokenized and aligned once: a
border of units is a border of groups. Texts with other white space than SPACE (carriage returns, and what is not ASCII) are one unit.

Per block of texts the links become postings (A id, B id, document, multiplicity). They are shuffled by the A id, in buckets, as sorted
arrays, with the blocks of a bucket dealt to parts, so that no id makes a task large: a part holds at most PART blocks' postings, however
hot one id is. Two streams meet in each part, sorted and spillable by Spark: first the bucket's counts (in how many documents a pair is
linked, summed beforehand from one row per block and bucket), in which the highest count of each A id is found on the spot, and then
the postings, one block at a time. Each block's documents get their sums from there, and are added up by block.
"""

from __future__ import annotations

import hashlib
import io
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, gathered, large, pack, pack_sorted, session_of, staged, task, unpack, unpack_sorted

#: Buckets of A ids, and the blocks of a bucket that one part holds at most, about.
BUCKETS, PART = 128, 2048
#: Bytes of text in a block, at most, but for a longer text.
BLOCK_BYTES = 2 << 20
#: Units that a worker keeps, and their characters, at most about: then it begins anew.
CACHED, CHARS = 250_000, 4_000_000
#: White space before which texts are cut. A unit: such white space and what follows it; texts with other white space are not cut.
SPACE = " \t\n\f\v"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
ODD = re.compile(rf"[^\S{SPACE}]").search
#: What stands after a token in the spelling of groups: more of its side, the other side, the next group.
MORE, OTHER, NEXT = ",", "|", ";"


class Tokens:
    """Two tokenizers: ids and bytes of units, which begin with a space as the text is read as space + text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x]  # the bytes that stand for themselves
        byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
        spelled = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        bytes_a = [bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode() for s in spelled]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.many_b, self.space = len(bytes_b), self.b.piece_to_id("▁")
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.large_binary()), pa.array(bytes_b, pa.large_binary())
        real = [p for k, p in enumerate(pieces) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))]
        over = re.compile(f"[^{SPACE}][{SPACE}]").search  # entries that such a border would cut, in texts that are cut
        plain = [x.decode(errors="replace") for x in bytes_a]
        self.cuts = not any(re.search(f"[^▁]▁|[{SPACE}]", p) for p in real if len(p) > 1) and not any(over(x) and not ODD(x) for x in plain)
        if len(bytes_a) * len(bytes_b) >= 1 << 32:
            raise ValueError("a pair of ids must fit in 32 bits")
        numbers = range(max(len(bytes_a), len(bytes_b)))
        self.spelled = pa.array([f"{k}{s}" for k in numbers for s in (MORE, OTHER, NEXT)], pa.large_string())

    def units(self, text: str) -> list[str]:
        """The units of space + text."""
        return [" " + text] if not self.cuts or ODD(text) else UNIT(" " + text)

    def ids_a(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]

    def ids_b(self, units: list[str]) -> list[list[int]]:
        """The tokenizer puts a space before what it is given: a unit's own is left off, and what it adds to others is taken away again."""
        own = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [([self.space] if u == " " else x) if u[0] == " " else x[1:] for u, x in zip(units, own, strict=True)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    many = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for own in lists for x in own), np.int64, int(many.sum())), many


def _ends(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Where each token ends in the bytes of all of them, and the bytes."""
    got = table.take(pa.array(ids))
    ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset + 1 : got.offset + 1 + len(got)]
    return ends, got.buffers()[2].to_pybytes()[: ends[-1]] if len(ends) else b""


def _sound(table: pa.Array, ids: np.ndarray, many: np.ndarray, want: pa.Array) -> np.ndarray:
    """Whether the tokens of each unit spell it."""
    ends, data = _ends(table, ids)
    at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(many)])]
    got = pa.Array.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    return pc.equal(got, want).to_numpy(zero_copy_only=False)


class Aligned:
    """Units with what is known of them: n_a, n_b, n_groups, sound; links (codes of pairs) and the spelling of their groups."""

    def __init__(self, tokens: Tokens, units: list[str]):
        want = pa.array([u.encode() for u in units], pa.large_binary())
        (a, many_a), (b, many_b) = _flat(tokens.ids_a(units)), _flat(tokens.ids_b(units))
        self.sound = _sound(tokens.bytes_a, a, many_a, want) & _sound(tokens.bytes_b, b, many_b, want)
        a, b = a[np.repeat(self.sound, many_a)], b[np.repeat(self.sound, many_b)]
        self.n_a, self.n_b = np.where(self.sound, many_a, 0), np.where(self.sound, many_b, 0)
        ends_a, ends_b = _ends(tokens.bytes_a, a)[0], _ends(tokens.bytes_b, b)[0]
        borders = np.intersect1d(ends_a, ends_b)  # of groups
        pieces = np.union1d(ends_a, ends_b)  # each stretch between ends is the overlap of one token of A and one of B
        link_a, link_b = np.searchsorted(ends_a, pieces), np.searchsorted(ends_b, pieces)
        size = np.where(self.sound, pc.binary_length(want).to_numpy(zero_copy_only=False), 0)
        bounds = np.concatenate([[0], np.cumsum(size)])
        per = lambda ends: np.diff(np.searchsorted(ends, bounds, "right"))
        self.n_groups, self.n_links = per(borders), per(pieces)
        self.links = a[link_a] * tokens.many_b + b[link_b] if len(pieces) else np.zeros(0, np.int64)
        self.spelled = self._spell(tokens, a, b, ends_a, ends_b, borders)

    def _spell(self, tokens, a, b, ends_a, ends_b, borders) -> pa.Array:
        """a1,a2|b1;a3|b2,b3; for each unit."""
        group = np.concatenate([np.searchsorted(borders, ends_a), np.searchsorted(borders, ends_b)])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))  # stable: tokens of a side stay in order
        ids, group, side = np.concatenate([a, b])[order], group[order], side[order]
        after = np.zeros(len(ids), np.int64)  # MORE
        if len(ids):
            last_of_group = np.append(group[1:] != group[:-1], True)
            after[:-1][(side[1:] != side[:-1]) & ~last_of_group[:-1]] = 1  # OTHER
            after[last_of_group] = 2  # NEXT
        got = tokens.spelled.take(pa.array(ids * 3 + after))
        ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1]
        at = ends[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return pa.Array.from_buffers(pa.large_string(), len(self.n_a), [None, pa.py_buffer(at), got.buffers()[2] or pa.py_buffer(b"")])


class Units:
    """The units that a worker has aligned, in tables that grow; begun anew when they are full."""

    def __init__(self, path_a: str, path_b: str):
        self.tokens = Tokens(path_a, path_b)
        self._begin()

    def _begin(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.numbers = np.zeros((0, 4), np.int64)
        self.sound, self.links, self.spelled = np.zeros(0, bool), np.zeros(0, np.int64), pa.array([], pa.large_string())

    def look(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all units of the texts in a row, and how many each text has."""
        if len(self.place) > CACHED or self.chars > CHARS:
            self._begin()
        found = [self.tokens.units(t) if t else [] for t in texts]
        place, new = self.place, {}
        for own in found:
            for u in own:
                if u not in place:
                    new[u] = None
        if new:
            got, base = Aligned(self.tokens, list(new)), len(self.sound)
            self.numbers = np.concatenate([self.numbers, np.stack([got.n_a, got.n_b, got.n_groups, got.n_links], axis=1)])
            self.sound, self.links = np.concatenate([self.sound, got.sound]), np.concatenate([self.links, got.links])
            self.spelled = pa.concat_arrays([self.spelled, got.spelled])
            place.update((u, base + k) for k, u in enumerate(new))
        many = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter((place[u] for own in found for u in own), np.int64, int(many.sum()))
        self.chars += sum(map(len, new))
        return at, many


_UNITS: dict = KEPT.setdefault("alignment", {})


def _units_of(path_a: str, path_b: str) -> Units:
    if (path_a, path_b) not in _UNITS:
        _UNITS[path_a, path_b] = Units(path_a, path_b)
    return _UNITS[path_a, path_b]


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each, in a row."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


def aligned_texts(units: Units, texts: list[str]) -> dict[str, np.ndarray | list[str]]:
    """What each text has: n_a, n_b, n_groups, n_links, groups_sha256; and of all links the text (doc) and the code of the pair (code)."""
    at, many = units.look(texts)
    doc = np.repeat(np.arange(len(texts)), many)
    good = np.ones(len(texts), bool)
    good[doc[~units.sound[at]]] = False
    good &= many > 0
    at, doc, many = at[good[doc]], doc[good[doc]], np.where(good, many, 0)
    numbers = np.stack([np.bincount(doc, weights=units.numbers[at, k], minlength=len(texts)) for k in range(4)]).astype(np.int64)
    first = np.cumsum(units.numbers[:, 3]) - units.numbers[:, 3]
    each = units.numbers[at, 3]
    code = units.links[_spread(first[at], each)]
    spelled = units.spelled.take(pa.array(at))
    data, ends = spelled.buffers()[2], np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset : spelled.offset + len(at) + 1]
    cuts = ends[np.concatenate([[0], np.cumsum(many)])].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    sha = [hashlib.sha256(view[a : z - 1]).hexdigest() if z > a else "" for a, z in zip(cuts, cuts[1:], strict=False)]
    return {"n_a": numbers[0], "n_b": numbers[1], "n_groups": numbers[2], "n_links": numbers[3], "groups_sha256": sha, "doc": np.repeat(doc, each), "code": code}


def _ipc(table: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(table)
    return out.getvalue()


_BLOCKS = "block long, bucket int, pairs binary, documents binary, places binary, times binary"


def _blocks(path_a: str, path_b: str, buckets: int, block_bytes: int):
    """For each block of texts one row for each bucket: pairs (sorted), in how many of its documents each is linked, their places in the
    block and the multiplicities there; and one row with bucket -1, whose pairs are the block's documents."""

    def blocks(batches):
        from pyspark import TaskContext

        units, block = _units_of(path_a, path_b), TaskContext.get().partitionId() << 36
        for t in gathered(batches, block_bytes):
            texts = large(t["text"]).to_pylist()
            got = aligned_texts(units, texts)
            yield pa.RecordBatch.from_pydict({
                "block": [block], "bucket": pa.array([-1], pa.int32()),
                "pairs": [_ipc(pa.RecordBatch.from_pydict({"doc_id": t["doc_id"].combine_chunks(), **{k: got[k] for k in ("n_a", "n_b", "n_groups", "n_links")}, "groups_sha256": pa.array(got["groups_sha256"], pa.string())}))],
                **{k: pa.array([None], pa.binary()) for k in ("documents", "places", "times")},
            })
            many_b, bits = units.tokens.many_b, max(1, len(texts) - 1).bit_length()
            bucket = got["code"] // many_b % buckets
            keys, times = np.unique((bucket << 32 | got["code"]) << bits | got["doc"], return_counts=True)
            code = keys >> bits
            first = np.flatnonzero(np.diff(code, prepend=-1))
            documents = np.diff(np.append(first, len(keys)))
            own = code[first] >> 32
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            rows: dict[str, list] = {k: [] for k in ("block", "bucket", "pairs", "documents", "places", "times")}
            for a, z in zip(cuts, np.append(cuts[1:], len(own)), strict=True):
                low, high = first[a], first[z] if z < len(first) else len(keys)
                rows["block"].append(block)
                rows["bucket"].append(int(own[a]))
                rows["pairs"].append(pack_sorted((code[first[a:z]] & 0xFFFFFFFF).astype("<u4")))
                rows["documents"].append(pack(documents[a:z].astype("<u4")))
                rows["places"].append(pack((keys[low:high] & (1 << bits) - 1).astype("<u4")))
                rows["times"].append(pack(times[low:high].astype("<u4")))
            if rows["block"]:
                yield pa.RecordBatch.from_arrays([pa.array(rows["block"], pa.int64()), pa.array(rows["bucket"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in ("pairs", "documents", "places", "times"))], names=list(rows))
            block += 1

    return task(blocks, "alignment")


class Sums:
    """Counts of pairs, added up as sorted arrays arrive."""

    def __init__(self):
        self.pairs, self.counts, self.new, self.held = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

    def add(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((pairs, counts))
        self.held += len(pairs)
        if self.held > max(100_000, len(self.pairs)):
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            pairs = np.concatenate([self.pairs, *(p for p, _ in self.new)])
            counts = np.concatenate([self.counts, *(c for _, c in self.new)])
            self.pairs, own = np.unique(pairs, return_inverse=True)
            sums = np.zeros(len(self.pairs), np.int64)
            np.add.at(sums, own, counts)
            self.counts, self.new, self.held = sums, [], 0
        return self.pairs, self.counts


def _counted(flush: int):
    """Sums of the counts of a bucket over the rows of a task; rows need not be sorted, and what is held is bounded."""

    def counted(batches):
        held: dict[int, Sums] = {}
        size = 0

        def out():
            for bucket, sums in held.items():
                pairs, counts = sums.close()
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([pack_sorted(pairs.astype("<u4"))], pa.binary()), pa.array([pack(counts)], pa.binary())], names=["bucket", "pairs", "counts"])

        for b in batches:
            names = b.schema.names
            for k, bucket in enumerate(b.column("bucket").to_pylist()):
                pairs = unpack_sorted(b.column("pairs")[k].as_py(), "<u4")
                counts = unpack(b.column("documents")[k].as_py(), "<u4").astype(np.int64) if "documents" in names else unpack(b.column("counts")[k].as_py(), "<i8")
                held.setdefault(bucket, Sums()).add(pairs, counts)
                size += len(pairs)
                if size > flush:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return task(counted)


def _contributions(many_b: int):
    """Rows sorted by bucket, part and block: first a bucket's counts (a null block), then its postings. For each block with the bucket's
    postings: places of documents, the sum of counts over their links and how many links are their A id's best."""

    def contributions(batches):
        pairs, counts, best = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
        for b in batches:
            out: dict[str, list] = {"block": [], "places": [], "sums": [], "bests": []}
            for k, block in enumerate(b.column("block").to_pylist()):
                own = unpack_sorted(b.column("pairs")[k].as_py(), "<u4")
                if block is None:
                    pairs, counts = own, unpack(b.column("counts")[k].as_py(), "<i8")
                    starts = np.flatnonzero(np.diff(pairs // many_b, prepend=-1))
                    best = counts == np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(pairs))))
                    continue
                at = np.repeat(np.searchsorted(pairs, own), unpack(b.column("documents")[k].as_py(), "<u4"))
                places, inverse = np.unique(unpack(b.column("places")[k].as_py(), "<u4"), return_inverse=True)
                times = unpack(b.column("times")[k].as_py(), "<u4").astype(np.int64)
                sums, bests = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
                np.add.at(sums, inverse, times * counts[at])
                np.add.at(bests, inverse, times * best[at])
                for name, x in (("block", block), ("places", pack_sorted(places.astype("<u4"))), ("sums", pack(sums)), ("bests", pack(bests))):
                    out[name].append(x)
            if out["block"]:
                yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in ("places", "sums", "bests"))], names=list(out))

    return task(contributions)


def _added(batches):
    """Rows sorted by block, its documents first: the documents with the sums of all their contributions."""
    block, held = None, None

    def done():
        docs, sums, bests = held
        t = docs.append_column("n_best", pa.array(bests)).append_column("count_sum", pa.array(sums))
        return t.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]).to_batches()

    for b in batches:
        for k, own in enumerate(b.column("block").to_pylist()):
            docs = b.column("docs")[k].as_py()
            if docs is not None:
                if held is not None:
                    yield from done()
                docs = pa.ipc.open_stream(docs).read_all()
                block, held = own, (docs, np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64))
                continue
            if own != block:
                raise ValueError("contributions of a block without documents")
            at = unpack_sorted(b.column("places")[k].as_py(), "<u4")
            held[1][at] += unpack(b.column("sums")[k].as_py(), "<i8")
            held[2][at] += unpack(b.column("bests")[k].as_py(), "<i8")
    if held is not None:
        yield from done()


def align_tokens(docs: DataFrame, path_a: str, path_b: str, buckets: int = BUCKETS, part: int = PART, block_bytes: int = BLOCK_BYTES, flush: int = 4_000_000) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    docs: doc_id long, text string; other columns are ignored. path_a: file of a byte-level tokenizer that is given space + text; path_b:
    model of a piece tokenizer that puts the space itself. Groups are what stands between byte offsets at which tokens of both end; a link is
    a pair of tokens whose bytes overlap; the count of a pair of ids is the number of rows in which they are linked. n_best: links whose count
    is the highest of their A id's pairs; count_sum: counts summed over links.

    Null and empty texts, and texts that the tokens of A or of B do not spell byte by byte, have no tokens: zeros and an empty
    groups_sha256. A null doc_id is a document as any other; repeated rows are a document each; an empty table gives no rows.
    """
    session_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = staged(rows.mapInArrow(_blocks(path_a, path_b, buckets, block_bytes), _BLOCKS))
    postings, documents = found.where("bucket >= 0"), found.where("bucket = -1")
    from sentencepiece import SentencePieceProcessor

    many_b = SentencePieceProcessor(model_file=path_b).get_piece_size()
    parts = max(1, -(-documents.count() // part))
    kind = "bucket int, pairs binary, counts binary"
    sums = postings.select("bucket", "pairs", "documents").mapInArrow(_counted(flush), kind)
    counts = staged(sums.repartition("bucket").mapInArrow(_counted(1 << 62), kind))  # a bucket's different pairs are bounded by the vocabularies
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    own = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")
    streams = postings.select("bucket", own, "block", "pairs", *none("counts"), "documents", "places", "times").unionAll(
        counts.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("long").alias("block"), "pairs", "counts", *none("documents", "places", "times"))
    )
    streams = streams.repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.col("block").asc_nulls_first())
    given = streams.mapInArrow(_contributions(many_b), "block long, places binary, sums binary, bests binary")
    both = given.select("block", *none("docs"), "places", "sums", "bests").unionAll(documents.select("block", F.col("pairs").alias("docs"), *none("places", "sums", "bests")))
    both = both.repartition("block").sortWithinPartitions("block", F.col("docs").isNull())
    return both.mapInArrow(task(_added), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
