"""Language-model scores by a weighted backoff automaton.

States are the n-grams seen in training that are shorter than the order, the root among them. A state's arc for a seen continuation
carries the log-probability of the smoothed n-gram and leads to the longest suffix that is a state; every other word leaves by the
failure arc, which costs log(kappa / (c(h) + kappa)) and leads to the state of the next shorter history, down to the root, whose arcs
are the add-one unigrams. So, with Dirichlet smoothing,

    p_1(w)       = (c(w) + 1) / (N + V + 1)
    p_n(w | h)   = (c(h w) + kappa p_{n-1}(w)) / (c(h) + kappa)          (p_{n-1} where the state h is unseen)

which sums to one over the vocabulary and one unknown word. One left-to-right traversal of a text carries the state, follows arcs
and failure arcs and adds up their weights.

The automaton grows with the corpus and is never collected or broadcast. Texts are cut into blocks of documents; a block asks
for each different n-gram of its texts once, at the hash bucket that owns it. Buckets add up the training counts of all blocks
and answer; the block builds from them the part of the automaton that its own texts can reach, and runs over it. Frequent n-grams
cost one row for each block, not one for each occurrence, so no key is hot. The number of buckets follows the size of the corpus.

Words are told apart by 64-bit hashes: among five million words, two share a hash with a chance of one in a million. Longer n-grams
are told apart by as many bits as the number of tokens asks for, so that one lookup in 2^SPARE finds another n-gram's count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, large, mix, pack, pack_sorted, release, scalar, session_of, staged, task, unpack, unpack_sorted

#: Hashes of the end of a text and of the place before its first word; no word can be either, as words hash their own bytes.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\x00 end", b"\x00 start"))
BLOCK_BYTES = 4 << 20
CHARS_A_BUCKET = 12 << 20
#: Bits of a longer n-gram's key beyond those that number all tokens; tokens of a lane of a traversal.
SPARE, LANE = 22, 256


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts: hashes of the different words, the code of each token (by falling frequency), tokens of each text.

    A-Z become a-z; words are what stands between the six ASCII white-space characters; an end token closes each text.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = pc.list_flatten(lists)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if pc.any(pc.equal(pc.binary_length(flat), 0)).as_py():
        real = pc.greater(pc.binary_length(flat), 0)
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[real.to_numpy(zero_copy_only=False)], minlength=len(counts))
        flat = flat.filter(real)
    coded = pc.dictionary_encode(flat)
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    codes = np.full(len(flat) + len(counts), len(words), np.int64)
    ends = np.cumsum(counts + 1) - 1
    inner = np.ones(len(codes), bool)
    inner[ends] = False
    codes[inner] = coded.indices.to_numpy(zero_copy_only=False)
    words = np.append(words, END)
    rank = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    place = np.empty(len(words), np.uint32)
    place[rank] = np.arange(len(words))
    return words[rank], place[codes], counts + 1


def grams(words: np.ndarray, codes: np.ndarray, lengths: np.ndarray, order: int, bits: int = 64):
    """For n = 1..order the n-gram that ends at each token: sorted different keys, and each token's place there (-1: text too short).

    Keys of more than one word keep their upper ``bits`` bits.
    """
    h = words[codes]
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(h)) - np.repeat(first, lengths)
    keys = h
    for n in range(1, order + 1):
        if n > 1:
            before = np.roll(keys, 1)
            if n == 2:
                before[first] = START
            keys = mix(before, h)
        good = at >= n - 2
        unique, inverse = np.unique(keys[good] >> np.uint64(64 - bits) if n > 1 else keys[good], return_inverse=True)
        place = np.full(len(h), -1, np.int32)
        place[good] = inverse
        yield n, unique, place


def _blocks(held_mod: int, held_rem: int):
    def blocks(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, t in enumerate(gathered(batches, BLOCK_BYTES)):
            words, codes, lengths = tokens(large(t["text"]))
            held = np.array([t["crc"].to_numpy(zero_copy_only=False) % held_mod == held_rem]).reshape(-1)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([part << 32 | k], pa.int64()),
                    "doc_id": pa.array([t["doc_id"].to_pylist()], pa.list_(pa.int64())),
                    "held": pa.array([held.tolist()], pa.list_(pa.bool_())),
                    "lengths": [pack(lengths)],
                    "words": [words.tobytes()],
                    "codes": [pack(codes.astype(np.uint32))],
                }
            )

    return task(blocks)


def _asked(order: int, bits: int, width: int):
    """Each block's different n-grams with their training counts, one row for each bucket."""

    def asked(batches):
        for b in batches:
            for r in b.to_pylist():
                words, codes, lengths = np.frombuffer(r["words"], np.uint64), unpack(r["codes"], np.uint32), unpack(r["lengths"], np.int64)
                trained = np.repeat(~np.array(r["held"], bool), lengths)
                out: dict[str, list] = {k: [] for k in ("block", "bucket", "keys", "counts")}
                for n, unique, place in grams(words, codes, lengths, order, width):
                    counts = np.bincount(place[(place >= 0) & trained], minlength=len(unique)).astype(np.uint32)
                    top = np.uint64((64 if n == 1 else width) - bits)
                    cuts = np.searchsorted(unique >> top, np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(unique)])
                    for bucket in np.flatnonzero(np.diff(cuts)):
                        a, z = cuts[bucket], cuts[bucket + 1]
                        for k, v in zip(out, (r["block"], n << 48 | int(bucket), pack_sorted(unique[a:z]), pack(counts[a:z])), strict=True):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return task(asked)


def _answered(t: pa.Table) -> pa.Table:
    """The counts that a bucket owns, given back to each block in the order of its keys; for words also how many there are."""
    keys = [unpack_sorted(x, np.uint64) for x in t["keys"].to_pylist()]
    flat = np.concatenate(keys)
    unique, inverse = np.unique(flat, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([unpack(x, np.uint32) for x in t["counts"].to_pylist()]), minlength=len(unique)).astype(np.uint64)
    cuts = np.cumsum([0, *map(len, keys)])
    mine = t["bucket"][0].as_py() >> 48 == 1
    return pa.table(
        {
            "block": t["block"],
            "bucket": t["bucket"],
            "counts": pa.array([pack(total[inverse[a:z]]) for a, z in zip(cuts, cuts[1:], strict=False)], pa.binary()),
            "tokens": pa.array([int(total.sum()) * mine] + [0] * (len(keys) - 1), pa.int64()),
            "words": pa.array([int((total > 0).sum()) * mine] + [0] * (len(keys) - 1), pa.int64()),
        }
    )


class Automaton:
    """The part of the automaton that some texts can reach, as arrays over its n-grams; n-gram 0 is the root, 1 the place before a text.

    count: in training; weight: of the arc that reads the n-gram's last word in the state of its history; target: the state that the
    arc leads to; backoff, fail: weight and target of the failure arc of the n-gram as a state. at[n - 1]: for each token of the texts
    the n-gram of n words that ends there, or -1.
    """

    def __init__(self, places: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, texts: int, total: int, kinds: int, kappa: float):
        order = len(places)
        base = np.cumsum([2, *map(len, counts)])
        first = np.cumsum(lengths) - lengths
        self.order, self.at = order, [np.where(p >= 0, p + b, -1).astype(np.int32) for p, b in zip(places, base, strict=False)]
        many = int(base[-1])
        self.count = np.concatenate([[max(total, 1), texts], *counts]).astype(np.float64)
        history, suffix = np.zeros(many, np.int32), np.zeros(many, np.int32)
        for n in range(2, order + 1):
            own = np.flatnonzero(places[n - 1] >= 0)
            gram = self.at[n - 1][own]
            before = self.at[n - 2][np.maximum(own - 1, 0)]
            history[gram] = np.where(np.isin(own, first, assume_unique=True), 1, before) if n == 2 else before
            suffix[gram] = self.at[n - 2][own]
        p = (self.count + 1.0) / (total + kinds + 1)
        for a, z in zip(base[1:-1], base[2:], strict=True):
            c = self.count[history[a:z]]
            p[a:z] = np.where(c > 0, (self.count[a:z] + kappa * p[suffix[a:z]]) / (c + kappa), p[suffix[a:z]])
        self.weight = np.log10(p)
        self.backoff = np.log10(kappa / (self.count + kappa))
        del p, history
        self.fail, self.target = suffix, np.arange(many, dtype=np.int32)
        self.target[base[order - 1] :] = suffix[base[order - 1] :]
        if order == 1:
            self.target[:] = 0
        self.target[self.count == 0] = 0  # a word that training never saw leads to the root
        self.start = 1 if order > 1 and texts else 0
        self.level = np.repeat(np.arange(order + 2, dtype=np.int8) - 1, [1, 1, *map(len, counts)])
        self.level[:2] = 0, 1

    def traverse(self, lengths: np.ndarray) -> np.ndarray:
        """The weight of each token. The texts' tokens are cut into lanes, read together from left to right, each with its state.

        A lane begins as many tokens early as the longest state has words, from the root, which brings it into the right state.
        """
        size, warm = int(lengths.sum()), self.order - 1
        ends = np.zeros(size + 1, bool)
        ends[np.cumsum(lengths)] = True  # ends[i]: a text ended at token i - 1
        ends[0] = True
        begin = np.arange(0, size, LANE)
        state, weight = np.zeros(len(begin), np.int64), np.zeros(size)
        for step in range(-warm, LANE):
            token = begin + step
            lanes = np.flatnonzero((token >= 0) & (token < size))
            i = token[lanes]
            s = np.where(ends[i], self.start, state[lanes])
            w = np.zeros(len(lanes))
            open_ = np.arange(len(lanes))
            for n in range(self.order - 1, 0, -1):  # states of n words: by an arc, or else by failure to n - 1 words
                here = open_[self.level[s[open_]] == n]
                arc = self.at[n][i[here]]
                there = (arc >= 0) & (self.count[arc] > 0)
                w[here[there]] += self.weight[arc[there]]
                s[here[there]] = self.target[arc[there]]
                missed = here[~there]
                w[missed] += self.backoff[s[missed]]
                s[missed] = self.fail[s[missed]]
                open_ = np.setdiff1d(open_, here[there], assume_unique=True)
            arc = self.at[0][i[open_]]  # the root has an arc for every word
            w[open_] += self.weight[arc]
            s[open_] = self.target[arc]
            state[lanes] = s
            if step >= 0:
                weight[i] = w
        return weight

    def root(self) -> np.ndarray:
        """The weight of each token from the root alone."""
        return self.weight[self.at[0]]


def _scored(order: int, total: int, kinds: int, texts: int, kappa: float, width: int):
    def scored(seq: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        r = seq.to_pylist()[0]
        words, codes, lengths = np.frombuffer(r["words"], np.uint64), unpack(r["codes"], np.uint32), unpack(r["lengths"], np.int64)
        got = dict(zip(replies["bucket"].to_pylist(), replies["counts"].to_pylist(), strict=True))
        counts, places = [], []
        for n, unique, place in grams(words, codes, lengths, order, width):
            c = np.concatenate([unpack(got[k], np.uint64) for k in sorted(k for k in got if k >> 48 == n)] or [np.zeros(0, np.uint64)])
            if len(c) != len(unique):
                raise ValueError("a bucket did not answer")
            counts.append(c.astype(np.int64))
            places.append(place)
        del codes, got, replies
        machine = Automaton(places, counts, lengths, texts, total, kinds, kappa)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        add = lambda x: np.bincount(doc, weights=x, minlength=len(lengths))
        return pa.table(
            {
                "doc_id": pa.array(r["doc_id"], pa.int64()),
                "held_out": pa.array(r["held"], pa.bool_()),
                "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(add(machine.count[machine.at[0]] > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(lengths), total, np.int64)),
                "base_score": pa.array(add(machine.root())),
                "score": pa.array(add(machine.traverse(lengths))),
            }
        )

    return scored


def lm_scores(docs: DataFrame, order: int = 3, kappa: float = 100.0, held_mod: int = 7, held_rem: int = 2) -> DataFrame:
    """Scores every text by a model of the texts whose crc32(doc_id) mod held_mod is not held_rem.

    docs: doc_id long, text string; other columns are ignored, whatever their names. One row per input row: repeated rows (all
    count in training) give repeated results. A null text is empty: its one token is the end. A null doc_id counts as not held
    out. An empty table gives an empty result; without any training text, counts are 0 and every word has probability 1.
    """
    spark = session_of(docs)
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(held_rem + 1))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), crc.alias("crc"))
    seq = staged(docs.mapInArrow(_blocks(held_mod, held_rem), "block long, doc_id array<long>, held array<boolean>, lengths binary, words binary, codes binary"))
    chars = scalar(docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))))
    bits = max(0, int(chars // CHARS_A_BUCKET).bit_length())
    width = min(64, SPARE + max(bits, int(chars).bit_length()))
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 << bits)
    asked = seq.mapInArrow(_asked(order, bits, width), "block long, bucket long, keys binary, counts binary")
    replies = staged(asked.repartition(spread, "bucket").groupBy("bucket").applyInArrow(_answered, "block long, bucket long, counts binary, tokens long, words long"))
    total, kinds = replies.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    end = scalar(seq.agg(F.coalesce(F.sum(F.expr("size(filter(held, x -> not x))")), F.lit(0))))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return seq.groupBy("block").cogroup(replies.select("block", "bucket", "counts").groupBy("block")).applyInArrow(_scored(order, int(total), int(kinds), int(end), kappa, width), out)
