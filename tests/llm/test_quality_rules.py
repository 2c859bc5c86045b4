"""Counts, references and distances of the quality rules against plain Python."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from karst.llm.quality_rules import CLASSES, References, class_counts, learn_references, quality_rules, words_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
KIND = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "blank": "[\t-\r ]", "stop": "[-.,;:!?'\"()]", "mark": "[#*$%&|<>]", "high": "[^\x00-\x7f]"}


def lowered(w):
    return "".join(c.lower() if c.isascii() else c for c in w)


def kinds(text):
    out = {k: len(re.findall(p, text)) for k, p in KIND.items()}
    return [out.get(k, len(text) - sum(out.values())) for k in CLASSES]


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {i + d for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def references(rows, share):
    out = {}
    for text, lang in rows:
        w = [lowered(x) for x in WORDS.findall(text or "")]
        if lang is not None and len(w) >= 50:
            a, b = out.setdefault(lang, (Counter(), [0] * len(CLASSES)))
            a.update(w)
            b[:] = [x + y for x, y in zip(b, kinds(text), strict=True)]
    return {k: ({w: n / a.total() for w, n in a.items() if n * share >= a.total()}, [x / sum(b) for x in b]) for k, (a, b) in out.items()}


def jsd(p, q):
    kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return math.sqrt(max(0, kl(p, m) / 2 + kl(q, m) / 2))


def verdict(text, refs):
    w = [lowered(x) for x in WORDS.findall(text)]
    near = [1.0, 1.0]
    for words, classes in refs.values():
        many = Counter(x for x in w if x in words)
        p = [many[x] / len(w) for x in words]
        near[0] = min(near[0], jsd([*p, 1 - sum(p)], [*words.values(), 1 - sum(words.values())]))
        k = kinds(text)
        near[1] = min(near[1], jsd([x / sum(k) for x in k], classes))
    return near


TEXTS = ["", None, " \n\t ", "a", "a b c a b c a b c", "x\nx\n\nx\n \n y", "## *x* $1% <b>&|", "ünï çödé \U0001f600 日本", "\x0ba\x0cb\rc", "one two three " * 40, " lead and trail ", "\x00\x01 ctl", "UPPER lower 123"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    own = {"en": ["the", "of", "and", "to", "in"], "fr": ["le", "de", "et", "à", "un"]}
    out = [(t, "en") for t in TEXTS]
    for k in range(120):
        lang = ("en", "fr", None)[k % 3]
        common = own[lang or "en"]
        text = " ".join(rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(4000)}" for _ in range(rng.randrange(10, 400)))
        out.append((text.replace(" w1", "\nW1") if k % 7 else " | ".join(text.split()), lang))
    out += [(out[20][0].upper(), "en"), ("###$$$%%% " * 90 + " ".join(f"z{i}" for i in range(300)), "en"), ("long " + " ".join(f"q{i % 977}" for i in range(60_000)), "xx")]
    return out + out[30:33]


def test_common_words_are_exact(spark, rows):
    df = spark.createDataFrame([(t, g) for t, g in rows], "text string, lang string").repartition(7)
    for share in (500, 20):
        got, want = learn_references(df, share), references(rows, share)
        assert len(got.shares) == len(want) and set(got.words) == {w for words, _ in want.values() for w in words}
        for own, classes, (words, shares) in zip(got.shares, got.classes, (want[k] for k in sorted(want)), strict=True):
            assert {w: x for w, x in zip(got.words, own, strict=True) if x} == pytest.approx(words)
            assert list(classes) == pytest.approx(shares)


def test_rules_equal_brute_force(spark, rows):
    schema = "doc_id long, text string, lang string, kept string, n_words string"
    df = spark.createDataFrame([(k if k % 11 else None, t, g, "x", "y") for k, (t, g) in enumerate(rows)], schema).repartition(5)
    got = sorted([tuple(r) for r in quality_rules(df).collect()], key=str)
    refs, want = references(rows, 500), []
    for k, (t, _) in enumerate(rows):
        b = base(t)
        words, classes = verdict(t, refs) if b[0] else (1.0, 1.0)
        kept = not b[5] and words <= 0.27 + 1.3 / math.sqrt(b[0]) and (classes <= 0.3 or b[1] < 200)
        want.append((k if k % 11 else None, *b, kept))
        if b[0]:
            row = next(r for r in got if r[0] == want[-1][0] and r[1:7] == b)
            assert row[8] == pytest.approx(words) and row[9] == pytest.approx(classes)
    assert [r[:8] for r in got] == sorted(want, key=str)
    assert {r[7] for r in got} == {True, False} and any(not r[6] and not r[7] for r in got)


def test_white_space_texts_have_characters_but_no_words():
    texts = pa.array(["", " \n", "a é"], pa.large_string())
    assert words_of(texts).many.tolist() == [0, 0, 2]
    assert class_counts(texts).tolist() == [[0] * 8, [0, 0, 0, 2, 0, 0, 0, 0], [1, 0, 0, 1, 0, 0, 0, 1]]


def test_without_references_and_empty_tables(spark, empty):
    none = learn_references(empty)
    assert isinstance(none, References) and none.words == [] and len(none.classes) == 0
    assert quality_rules(empty).collect() == []
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), None), (2, "short", None)], "doc_id long, text string, lang string")
    assert {(r["doc_id"], r["kept"]) for r in quality_rules(df).collect()} == {(1, True), (2, False)}


def test_clean_documents_stay_and_most_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = quality_rules(docs).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.1 * len(bad)
