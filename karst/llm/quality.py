"""Quality scores: random Fourier features over document statistics, ridge by summed normal equations, isotonic calibration.

Statistics of a text (length, character classes, repetition, line shapes) are computed for a whole Arrow batch at once. Labels fit
the model: the cosine features of a Gaussian kernel, whose normal equations each partition sums for its own rows; the sums of a
bounded number of partitions are added and solved. A part of the labelled rows is kept from the fit and calibrates the raw scores
by pooling adjacent violators. The fit uses at most about ``max_labels`` labelled rows, chosen by a hash; scoring is a
column expression over every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import large, release, session_of, staged, task

#: Character classes of UTF-8 bytes.
CLASSES = ("upper", "lower", "digit", "blank", "line", "stop", "symbol", "bar", "bang", "control")


def _classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("symbol"), np.uint8)
    for name, chars in (("upper", range(65, 91)), ("lower", [*range(97, 123), *range(128, 256)]), ("digit", range(48, 58)), ("blank", (9, 11, 12, 13, 32)), ("line", (10,)), ("stop", b".,;:'\"-?()"), ("bar", b"|"), ("bang", b"!"), ("control", [*range(9), *range(14, 32), 127])):
        table[list(chars)] = CLASSES.index(name)
    return table


TABLE = _classes()


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of figures for each text; an empty text has zeros."""
    texts, n = large(texts), len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    kinds = TABLE[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]

    def per(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sums of values between bounds."""
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return np.diff(sums[bounds]).astype(float)

    count = {name: per(kinds == k, at) for k, name in enumerate(CLASSES)}
    size = np.diff(at).astype(float)
    lists = pc.ascii_split_whitespace(texts)
    words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists)
    codes = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n), words)
    ends = np.concatenate([[0], np.cumsum(words)])
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    both, many = np.unique(doc << 32 | codes, return_counts=True)
    kinds_of = both >> 32
    top = np.zeros(n)
    np.maximum.at(top, kinds_of, many)
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(float)
    long = per(length > 24, ends)
    different = np.bincount(kinds_of, minlength=n).astype(float)
    w, b, letters, lines = np.maximum(words, 1), np.maximum(size, 1), np.maximum(count["upper"] + count["lower"], 1), count["line"] + 1
    rows = np.stack(
        [
            np.log1p(size), np.log1p(words), size / w, count["upper"] / letters, count["digit"] / b, count["blank"] / b, count["stop"] / b, count["symbol"] / b,
            count["bar"] / w, count["bang"] / w, count["control"] / b, np.log1p(size / lines), per(same, ends) / w, top / w, different / w, np.log1p(different), long / w,
        ],
        axis=1,
    )
    rows[size == 0] = 0
    return rows


@dataclass
class Quality:
    """A fitted model; a few thousand numbers, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.waves + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, texts: pa.Array) -> pa.Array:
        release()
        if not len(self.knots):
            return pa.array(np.full(len(texts), self.values[0]))
        return pa.array(np.interp(self.raw(statistics(texts)), self.knots, self.values))

    def column(self, text: Column) -> Column:
        return F.arrow_udf(self.score, "double")(text.cast("string"))


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators; equal scores are pooled first. Knots (mean score of each block) and ascending values."""
    s, inverse = np.unique(score, return_inverse=True)
    n, y = np.bincount(inverse).astype(float), np.bincount(inverse, weights=label)
    blocks: list[list[float]] = []
    for a, b, c in zip(s, n, y, strict=True):
        blocks.append([a * b, b, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 1], sums[:, 2] / sums[:, 1]


def fit_quality(docs: DataFrame, labels: DataFrame, held_mod: int = 5, held_rem: int = 0, max_labels: int = 40_000, waves: int = 256, ridge: float = 1e-4, seed: int = 7) -> Quality:
    """Learns label 1 from texts. docs: doc_id, text; labels: doc_id, label (0 or 1).

    Rows whose crc32(doc_id) mod held_mod is held_rem are never learned from; nor are rows with null doc_id, text or label.
    Repeated rows count as often as they are there. Where only one label is known, or none, every score is that label, or 0.5.
    At most about max_labels labelled rows are used: a hash of doc_id keeps that share of them.
    """
    session_of(docs)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    labels = labels.where((crc % held_mod != held_rem) & F.col("label").isin(0, 1))
    known = labels.count()
    if known > max_labels:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_labels / known * (1 << 30)))
    labels = labels.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("times"))

    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("part"), b.column("times"), pa.array(statistics(b.column("text")).tolist(), pa.list_(pa.float64()))], names=["label", "part", "times", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(labels), "doc_id")  # at most max_labels rows of a few numbers
    found = found.select("text", "label", "times", (F.floor(crc / held_mod) % 5).cast("int").alias("part"))
    rows = staged(found.mapInArrow(task(measured), "label int, part int, times long, x array<double>")).repartition(16)

    def normal(model: Quality | None):
        """Sums over a partition: of the statistics and their squares, or of the normal equations."""

        def sums(batches):
            total = None
            for b in batches:
                x = np.stack(b.column("x").to_numpy(zero_copy_only=False))
                y, t = (b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("label", "times"))
                if model is None:
                    own = np.concatenate([[t.sum(), (y * t).sum()], t @ x, t @ (x * x)])
                else:
                    z = model.features(x)
                    own = np.concatenate([(z.T @ (z * t[:, None])).ravel(), z.T @ (y * t)])
                total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

        return sums

    def added(df: DataFrame, model: Quality | None) -> np.ndarray:
        return sum(np.frombuffer(r[0]) for r in df.mapInArrow(normal(model), "sums binary").collect())  # 16 rows of a fixed size

    first = added(rows, None)
    if isinstance(first, int) or first[1] in (0, first[0]):
        constant = 0.5 if isinstance(first, int) else float(first[1] > 0)
        return Quality(*(np.zeros(0) for _ in range(6)), np.array([constant]))
    d = (len(first) - 2) // 2
    mean = first[2 : 2 + d] / first[0]
    scale = np.sqrt(np.maximum(first[2 + d :] / first[0] - mean**2, 0))
    rng = np.random.default_rng(seed)
    model = Quality(mean, np.where(scale > 1e-9, scale, 1), rng.normal(size=(d, waves)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.zeros(1), np.zeros(1))
    both = added(rows.where("part <> 0"), model)
    if isinstance(both, int):
        both = added(rows, model)
    k = waves + 1
    gram = both[: k * k].reshape(k, k)
    model.weights = np.linalg.solve(gram + ridge * gram[-1, -1] * np.eye(k), both[k * k :])
    held = rows.where("part = 0").select("x", "label", "times").collect()  # a fifth of max_labels rows
    held = held or rows.collect()
    raw, times = model.raw(np.array([r["x"] for r in held])), np.array([r["times"] for r in held])
    model.knots, model.values = isotonic(np.repeat(raw, times), np.repeat([float(r["label"]) for r in held], times))
    return model


def quality_scores(docs: DataFrame, model: Quality, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold); a null text counts as empty."""
    session_of(docs)
    docs = docs.withColumn("score", model.column(F.col("text")))
    return docs.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
