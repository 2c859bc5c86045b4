"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

n-grams of one to three letters are hashed to a fixed number of features. Document frequencies come from all training texts. The
weights are learned by follow-the-regularised-leader with L1 and L2 penalties, one text at a time, from a bounded number of texts
of each language; a part of these, kept from the learning, sets the temperature of the probabilities. The model has a fixed size
for each language and is applied as a column expression to every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import large, release, session_of, task

DIM = 1 << 14
ORDERS = 3
#: Texts whose counts stand side by side in memory.
GROUP = 128
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(texts: pa.Array):
    """For groups of texts: the number of texts, whether each has a letter, and (text, feature, count) of what is there."""
    strings = large(texts).to_pylist()
    k = 0
    while k < len(strings):
        z, size = k, 0
        while z < len(strings) and z - k < GROUP and (z == k or size + len(strings[z]) <= 1 << 20):
            size += len(strings[z])
            z += 1
        group = [s.lower() for s in strings[k:z]]
        k = z
        c = np.frombuffer("".join(f"\n{s}" for s in group).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
        doc = np.repeat(np.arange(len(group), dtype=np.int64), [len(s) + 1 for s in group])
        word = letters()[c]
        c = np.where(word, c, 0).astype(np.uint32)
        n, total = len(doc), 0
        for order in range(1, ORDERS + 1):
            h, real = np.full(n, order, np.uint32), np.zeros(n, bool)
            gap = np.zeros(n, bool)
            for j in range(order):
                x = np.pad(c, (0, ORDERS))[j : n + j]
                h = (h ^ x) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                real |= x > 0
                if 0 < j < order - 1:
                    gap |= x == 0
            keep = real & ~gap
            total = total + np.bincount(doc[keep] * DIM + (h[keep] % np.uint32(DIM)), minlength=len(group) * DIM)
        at = np.flatnonzero(total)
        has = np.bincount(doc[word[:n]], minlength=len(group)) > 0
        yield len(group), has, at // DIM, at % DIM, total[at]


@dataclass
class Languages:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, n: int, text: np.ndarray, feature: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[feature]
        norm = np.sqrt(np.bincount(text, weights=x * x, minlength=n))
        x /= norm[text]
        return np.stack([np.bincount(text, weights=x * w[feature], minlength=n) + b for w, b in zip(self.weights, self.bias, strict=True)], axis=1)

    def predict(self, texts: pa.Array) -> pa.Array:
        release()
        names, scores = [], []
        for n, has, text, feature, count in features(texts):
            p = softmax(self.logits(n, text, feature, count) / self.temperature) if self.names else np.zeros((n, 1))
            best = p.argmax(axis=1)
            names += [self.names[b] if h and self.names else UNKNOWN for b, h in zip(best, has, strict=True)]
            scores += np.where(has, p[np.arange(n), best], 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    def column(self, text: Column) -> Column:
        return F.arrow_udf(self.predict, "lang_pred string, score double")(text.cast("string"))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], kinds: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (kinds x DIM) and biases after the given passes; the last column of each state is the bias, which is not penalised."""
    z, n = np.zeros((DIM + 1, kinds)), np.zeros((DIM + 1, kinds))

    def solved(i: np.ndarray) -> np.ndarray:
        one, two = np.where(i == DIM, 0, l1)[:, None], np.where(i == DIM, 0, l2)[:, None]
        return np.where(np.abs(z[i]) > one, -(z[i] - np.sign(z[i]) * one) / ((beta + np.sqrt(n[i])) / alpha + two), 0.0)

    for _ in range(epochs):
        for i, x, y in rows:
            i, x = np.append(i, DIM), np.append(x, 1.0)
            w = solved(i)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = solved(np.arange(DIM + 1))
    return w[:DIM].T.copy(), w[DIM]


def fit_languages(
    docs: DataFrame, held_mod: int = 3, held_rem: int = 1, max_texts: int = 6_000, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3
) -> Languages:
    """Learns from doc_id, text, lang of rows whose crc32(doc_id) mod held_mod is not held_rem.

    Rows with a null doc_id, text or lang are not learned from. Document frequencies count every such text; the weights see about
    max_texts texts at most, as many of each language as there are, chosen by a hash of doc_id. Repeated rows count as often as
    they are there. Without any row to learn from, every prediction is UNKNOWN with score 0.
    """
    session_of(docs)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.where((crc % held_mod != held_rem) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches):
        seen = np.zeros(DIM, np.int64)
        for b in batches:
            for _, _, _, feature, _ in features(b.column("text")):
                seen += np.bincount(feature, minlength=DIM)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"feature": at, "texts": seen[at]})

    per = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    names, total = sorted(per), sum(per.values())
    if not names:
        return Languages([], np.zeros(DIM), np.zeros((0, DIM)), np.zeros(0), 1.0)
    idf = np.full(DIM, np.log(1.0 + total))
    for r in docs.select("text").mapInArrow(task(frequencies), "feature long, texts long").groupBy("feature").agg(F.sum("texts").alias("n")).collect():  # DIM rows
        idf[r["feature"]] = np.log((1 + total) / (1 + r["n"])) + 0.1

    share = max(1, max_texts // len(names))
    rates = F.create_map(*(F.lit(x) for k in names for x in (k, int(min(1.0, share / per[k]) * (1 << 20)))))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(rates, F.col("lang")))
    blank = Languages(names, idf, np.zeros((1, DIM)), np.zeros(1), 1.0)

    def weighed(batches):
        place = {k: i for i, k in enumerate(names)}
        for b in batches:
            out, langs, done = [], b.column("lang").to_pylist(), 0
            for n, _, text, feature, count in features(b.column("text")):
                x = (1 + np.log(count)) * blank.idf[feature]
                x /= np.sqrt(np.bincount(text, weights=x * x, minlength=n))[text]
                cuts = np.searchsorted(text, np.arange(n + 1))
                out += [(feature[a:z].astype("<u2").tobytes(), x[a:z].astype("<f4").tobytes()) for a, z in zip(cuts, cuts[1:], strict=False)]
                done += n
            yield pa.RecordBatch.from_arrays([pa.array([place[k] for k in langs], pa.int32()), b.column("turn"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["y", "turn", "i", "x"])

    def learned(t: pa.Table) -> pa.Table:
        t = t.sort_by("turn")
        rows = [(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(x, "<f4").astype(float), y) for i, x, y in zip(t["i"].to_pylist(), t["x"].to_pylist(), t["y"].to_pylist(), strict=True)]
        held, kept = rows[::5], [r for k, r in enumerate(rows) if k % 5] or rows
        weights, bias = ftrl(kept, len(names), alpha, beta, l1, l2, epochs)
        logits = np.stack([x @ weights[:, i].T + bias for i, x, _ in held])
        y = np.array([r[2] for r in held])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
        return pa.table({"weights": [weights.tobytes()], "bias": [bias.tobytes()], "temperature": [float(min(np.geomspace(0.02, 5, 120), key=loss))]})

    turn = F.xxhash64("doc_id", F.lit("turn")).alias("turn")
    found = sample.select("text", "lang", turn).mapInArrow(task(weighed), "y int, turn long, i binary, x binary")
    got = found.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learned, "weights binary, bias binary, temperature double").first()  # at most max_texts rows
    if got is None:
        return Languages([], idf, np.zeros((0, DIM)), np.zeros(0), 1.0)
    return Languages(names, idf, np.frombuffer(got["weights"]).reshape(len(names), DIM), np.frombuffer(got["bias"]), got["temperature"])


def language_ids(docs: DataFrame, model: Languages) -> DataFrame:
    """docs with lang_pred and score (0 to 1). A text that is null or has no letter is UNKNOWN, with score 0; ties go to the first name."""
    session_of(docs)
    return docs.withColumn("_found", model.column(F.col("text"))).select(*(F.col(c) for c in docs.columns if c not in ("lang_pred", "score")), "_found.lang_pred", "_found.score")
