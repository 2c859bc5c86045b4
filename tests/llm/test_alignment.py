"""Groups, links and counts of two tokenizers against a version that goes token by token over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from karst.llm.alignment import Tokens, Units, align_tokens, aligned_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    return Tokens(A, B)


def brute(tokens, text):
    """(a ids, b ids, links as (a, b), groups as text), from the whole text's tokens; None without tokens."""
    if not text:
        return None
    want = (" " + text).encode()
    a = tokens.a.encode(" " + text, add_special_tokens=False).ids
    b = tokens.b.encode(text)
    bytes_a = [tokens.bytes_a[k].as_py() for k in a]
    bytes_b = [tokens.bytes_b[k].as_py() for k in b]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    spans = []
    for own in (bytes_a, bytes_b):
        at, out = 0, []
        for x in own:
            out.append((at, at + len(x)))
            at += len(x)
        spans.append(out)
    links = [(a[i], b[j]) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if max(p, r) < min(q, s)]
    ends = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
    groups, low = [], 0
    for end in ends:
        side = lambda ids, own: ",".join(str(t) for t, (p, q) in zip(ids, own, strict=True) if low <= p and q <= end)  # noqa: B023
        groups.append(f"{side(a, spans[0])}|{side(b, spans[1])}")
        low = end
    return a, b, links, groups


def rows(tokens, texts):
    found = [brute(tokens, t) for t in texts]
    counts = Counter(p for f in found if f for p in set(f[2]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for f in found:
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = f
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


ODD_TEXTS = [
    None, "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  b", "a\n\nb", "a\n   b \t c", "tab\there", "x\r\ny", "<|endoftext|> <s> </s> <unk> <0x41>", "▁", "a▁b ▁ c", "über Straße naïve", "日本語 テキスト", "\U0001f600 ok \U0001f468‍\U0001f469",
    "a\xa0b c", "a   \xa0 b", "　x y", "\x1c\x1d z", "\x00 a\x00b", "é é", "ﬁ ﬂ ①", "don't we'll I'M they're", "1234567 3.14", "=== --- ***", "a" * 3000, "the " * 500, "\t\t\tcode:\n\n\n    return  x", "end\n", "end\n\n ", "\n  lead",
]


def test_units_are_tokenized_as_whole_texts(tokens):
    assert tokens.cuts
    units = Units(A, B)
    texts = [t or "" for t in ODD_TEXTS]
    got = aligned_texts(units, texts)
    for k, t in enumerate(texts):
        want = brute(tokens, t)
        assert got["n_a"][k] == (len(want[0]) if want else 0), repr(t[:40])
        assert got["groups_sha256"][k] == (hashlib.sha256(";".join(want[3]).encode()).hexdigest() if want else ""), repr(t[:40])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\xa0 \x1f▁aAzé1.,'-_日\U0001f600"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(text):
    tokens = test_any_text.tokens = getattr(test_any_text, "tokens", None) or Tokens(A, B)
    units = test_any_text.units = getattr(test_any_text, "units", None) or Units(A, B)
    got, want = aligned_texts(units, [text]), brute(tokens, text)
    assert got["groups_sha256"][0] == (hashlib.sha256(";".join(want[3]).encode()).hexdigest() if want else "")
    assert sorted(got["code"].tolist()) == (sorted(a * tokens.many_b + b for a, b in want[2]) if want else [])


def corpus():
    rng = random.Random(4)
    known = ["the", "house", "naïve", "running", "antidisestablishment", "x1y2", "São", "don't", "日本"]
    return ODD_TEXTS + [" ".join(rng.choice(known) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["the house"] * 40 + ["word " * 3000]


@pytest.mark.parametrize("buckets,part,block_bytes,flush", [(128, 1024, 4 << 20, 4_000_000), (3, 1, 300, 20)])
def test_rows_equal_brute_force(spark, tokens, buckets, part, block_bytes, flush):
    texts = corpus()
    docs = spark.createDataFrame([(k if k % 9 else None, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, block int, bucket int").repartition(4)
    want = rows(tokens, texts)
    found = align_tokens(docs, A, B, buckets, part, block_bytes, flush)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted([tuple(r) for r in found.collect()], key=str)
    assert got == sorted([(k if k % 9 else None, *w) for k, w in enumerate(want)], key=str)


def test_empty_table(spark, empty):
    assert align_tokens(empty, A, B).collect() == []


def test_registered_query_equals_brute_force(spark, tokens):
    from karst.llm.queries import op13_token_alignment

    directory = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: w for (i, _), w in zip(docs, rows_of_long(tokens, [t for _, t in docs]), strict=True)}
    got = {r["doc_id"]: tuple(r)[1:] for r in op13_token_alignment(spark, directory).collect()}
    assert got == want and len(got) == len(docs)


def rows_of_long(tokens, texts):
    """As rows(), with a merge of the ends in place of all pairs."""
    found = []
    for t in texts:
        if not t:
            found.append(None)
            continue
        a, b = tokens.a.encode(" " + t, add_special_tokens=False).ids, tokens.b.encode(t)
        ends, at = [[], []], 0
        for own, ids, table in ((ends[0], a, tokens.bytes_a), (ends[1], b, tokens.bytes_b)):
            at = 0
            for x in ids:
                at += len(table[x].as_py())
                own.append(at)
        links, groups, i, j, ga, gb = [], [], 0, 0, [], []
        while i < len(a):
            links.append((a[i], b[j]))
            p, q = ends[0][i], ends[1][j]
            if p <= q:
                ga.append(a[i])
                i += 1
            if q <= p:
                gb.append(b[j])
                j += 1
            if p == q:
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                ga, gb = [], []
        found.append((a, b, links, groups))
    counts = Counter(p for f in found if f for p in set(f[2]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [(0,) * 6 + ("",) if not f else (len(f[0]), len(f[1]), len(f[3]), len(f[2]), sum(counts[p] == best[p[0]] for p in f[2]), sum(counts[p] for p in f[2]), hashlib.sha256(";".join(f[3]).encode()).hexdigest()) for f in found]
