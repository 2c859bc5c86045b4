"""Language identification, quality scores and the language model: held-out accuracy and brute force."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from karst.llm import language_id as I
from karst.llm import lm_scoring as M
from karst.llm import quality as Q

held = lambda i, mod, rem: zlib.crc32(str(i).encode()) % mod == rem


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + [None]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(docs, order):
    rows = docs.select("doc_id", "text").collect()
    counts = collections.Counter()
    histories = collections.Counter()
    for r in rows:
        if r["doc_id"] is None or not held(r["doc_id"], 7, 2):
            w = ["<s>", *tokens(r["text"])]
            for k in range(1, len(w)):
                for n in range(1, min(order, k + 1) + 1):
                    counts[tuple(w[k - n + 1 : k + 1])] += 1
            histories["<s>"] += 1
    known = [c for g, c in counts.items() if len(g) == 1]
    total, kinds = sum(known), len(known)

    def score(w, k, n):
        p = (counts[(w[k],)] + 1) / (total + kinds + 1)
        for m in range(2, min(n, k + 1) + 1):
            h = tuple(w[k - m + 1 : k])
            c = histories["<s>"] if h == ("<s>",) else counts[h]
            if c:
                p = (counts[(*h, w[k])] + 100 * p) / (c + 100)
        return math.log10(p)

    want = collections.Counter()
    for r in rows:
        w = ["<s>", *tokens(r["text"])]
        sums = [sum(score(w, k, n) for k in range(1, len(w))) for n in (1, order)]
        want[(r["doc_id"], r["doc_id"] is not None and held(r["doc_id"], 7, 2), len(w) - 1, sum(counts[(x,)] > 0 for x in w[1:]), total, *(f"{x:.8g}" for x in sums))] += 1
    got = collections.Counter((*r[:5], f"{r[5]:.8g}", f"{r[6]:.8g}") for r in M.lm_scores(docs, order=order).collect())
    assert got == want


def test_many_blocks_and_buckets_give_the_same(docs, monkeypatch):
    key = lambda df: sorted(str((*r[:5], f"{r[5]:.8g}", f"{r[6]:.8g}")) for r in df.collect())
    want = key(M.lm_scores(docs))
    monkeypatch.setattr(M, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(M, "CHARS_A_BUCKET", 1000)
    assert key(M.lm_scores(docs)) == want


def walked(machine, lengths):
    """The weights by a plain walk over arcs and failure arcs, a token at a time."""
    out, i = [], 0
    for n in lengths:
        state = machine.start
        for _ in range(n):
            weight = 0.0
            while True:
                level = machine.level[state]
                arc = machine.at[level][i] if level < machine.order else -1
                if arc >= 0 and machine.count[arc] > 0 or level == 0:
                    state, weight = machine.target[arc], weight + machine.weight[arc]
                    break
                weight += machine.backoff[state]
                state = machine.fail[state]
            out.append(weight)
            i += 1
    return out


@pytest.mark.parametrize("order,lane", [(1, 4), (2, 3), (3, 1), (3, 7), (4, 2), (4, 256)])
def test_lanes_carry_states_as_a_walk_does(order, lane, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(order)
    monkeypatch.setattr(M, "LANE", lane)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(30)]
    words, codes, lengths = M.tokens(pa.array(texts, pa.large_string()))
    trained = np.repeat(np.arange(len(texts)) % 3 > 0, lengths)
    places, counts = [], []
    for _, unique, place in M.grams(words, codes, lengths, order):
        places.append(place)
        counts.append(np.bincount(place[(place >= 0) & trained], minlength=len(unique)))
    machine = M.Automaton(places, counts, lengths, 20, int(trained.sum()), int((counts[0] > 0).sum()), 100.0)
    assert np.allclose(machine.traverse(lengths), walked(machine, lengths), atol=1e-12)
    # all that leaves a state sums to one: its arcs, and its failure arc times what the next state's other arcs hold
    for state in range(2 if order > 1 else 0, len(machine.count)):
        if order > 1 and machine.level[state] == 1 and machine.count[state] > 0 and state != machine.at[0][-1]:  # nothing follows an end
            words_ = range(2, 2 + len(counts[0]))
            p = 10 ** machine.weight[list(words_)]
            unknown = 1 / (int(trained.sum()) + int((counts[0] > 0).sum()) + 1)
            seen = {}
            for i in np.flatnonzero(machine.at[1] >= 0):
                if i and machine.at[0][i - 1] == state and not any(i == e for e in np.cumsum(lengths)):
                    seen[machine.at[0][i]] = machine.at[1][i]
            arcs = sum(10 ** machine.weight[g] for g in seen.values() if machine.count[g] > 0)
            rest = sum(p[w - 2] for w in words_ if machine.count[w] > 0 and not (w in seen and machine.count[seen[w]] > 0)) + unknown
            assert abs(arcs + 10 ** machine.backoff[state] * rest - 1) < 1e-9


def test_empty_and_untrained(spark, empty):
    assert M.lm_scores(empty).count() == 0
    out = next(i for i in range(100) if held(i, 7, 2))
    one = M.lm_scores(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).first()
    assert (one["n_tokens"], one["n_known"], one["train_tokens"], one["score"]) == (3, 0, 0, 0.0)


ALPHABETS = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "абвгдежз"}


def language(rng, name, n=30):
    return " ".join("".join(rng.choice(ALPHABETS[name]) for _ in range(rng.randrange(1, 8))) for _ in range(n))


def test_languages_are_told_apart(spark):
    rng = random.Random(2)
    rows = [(k, language(rng, name), name if k % 7 else None) for k, name in enumerate(rng.choices(list(ALPHABETS), k=300))]
    truth = [next(n for n, a in ALPHABETS.items() if t.replace(" ", "")[0] in a) for _, t, _ in rows]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !", "bb"), (None, "abc", None), (1003, "ABC abc", None), (1004, language(rng, "bb", 20_000), None), rows[0]]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = I.language_ids(df, I.fit_languages(df)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert all(by[k]["lang_pred"] == truth[k] for k, _, _ in rows)
    assert [by[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lang_pred"] == "aa" and by[1004]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_no_language_and_no_rows(spark, empty):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in I.language_ids(df, I.fit_languages(df)).collect()} == {("und", 0.0)}
    assert I.language_ids(empty, I.fit_languages(empty)).count() == 0
    one = spark.createDataFrame([(k, "abc def", "en") for k in range(9)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in I.language_ids(one, I.fit_languages(one)).collect()} == {"en"}


def test_quality_is_told_apart(spark):
    rng = random.Random(3)
    good = lambda: " ".join(language(rng, "aa", 12).capitalize() + "." for _ in range(6))
    bad = lambda: rng.choice([language(rng, "aa", 3) + " " + "same " * 60, language(rng, "aa", 40).upper() + "!!", " | ".join(language(rng, "aa", 40).split())])
    rows = [(k, good() if k % 3 else bad()) for k in range(400)]
    labels = [(k, int(k % 3 > 0)) for k in range(400)] + [(5, None), (None, 1), (7, 1), (9999, 1), (8, 3)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "x" * 200_000), rows[1]], "doc_id long, text string").withColumn("predicted", F.lit("x"))
    known = spark.createDataFrame(labels, "doc_id long, label int").withColumn("text", F.lit("y"))
    model = Q.fit_quality(docs, known)
    got = {r["doc_id"]: r for r in Q.quality_scores(docs, model).collect()}
    out = [k for k in range(400) if held(k, 5, 0)]
    assert sum(got[k]["predicted"] == int(k % 3 > 0) for k in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and {900, 901, 902} <= set(got)
    assert got[900]["score"] == got[901]["score"]


def test_quality_without_labels(spark, empty):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int")
    assert {r["score"] for r in Q.quality_scores(docs, Q.fit_quality(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in Q.quality_scores(docs, Q.fit_quality(docs, ones)).collect()} <= {1.0, 0.5}
    assert Q.quality_scores(empty, Q.fit_quality(empty, none)).count() == 0


def test_isotonic_is_the_monotone_fit():
    import numpy as np

    knots, values = Q.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]))
    assert knots.tolist() == [1.0, 3.4] or np.all(np.diff(values) >= 0)
    assert np.all(np.diff(values) >= 0) and np.all(np.diff(knots) > 0)
