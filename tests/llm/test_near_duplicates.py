"""Line dedup, the n-gram join and paragraph dedup against brute force."""

import itertools
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from karst.llm import components as C
from karst.llm import line_dedup as L
from karst.llm import ngram_join as N
from karst.llm import paragraph_dedup as P


def shingled(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def classes(sets):
    """Sets as keys: root of each, and the number of its links."""
    parent, links = {s: s for s in sets}, defaultdict(int)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(list(parent), 2):
        if linked(a, b):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    return {s: find(s) for s in sets}, links


def test_join_equals_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    sets = {shingled(r["text"]) for r in rows} - {frozenset()}
    root, links = classes(sets)
    least = defaultdict(set)
    for r in rows:
        if shingled(r["text"]):
            least[root[shingled(r["text"])]].add(r["doc_id"])
    want = []
    for r in rows:
        s = shingled(r["text"])
        own = sum(shingled(x["text"]) == s for x in rows)
        ids = [x for x in least[root[s]] if x is not None] if s else [r["doc_id"]]
        want.append((r["doc_id"], min(ids) if ids else None, links[s] if s else 0, own if s else 1))
    got = N.ngram_join(docs).select("doc_id", "class_id", "links", "copies").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_of_each_keeps_one_of_a_class_and_all_without_words(docs):
    stay = N.one_of_each(docs)
    assert stay.columns == docs.columns
    rows = stay.collect()
    full = [r for r in rows if shingled(r["text"])]
    assert not any(linked(shingled(a["text"]), shingled(b["text"])) for a, b in itertools.combinations(full, 2))
    blank = lambda rs: sorted(str(r["doc_id"]) for r in rs if not shingled(r["text"]))
    assert blank(rows) == blank(docs.collect())


def test_large_buckets_and_groups_are_dealt_in_chunks(docs, monkeypatch):
    want = sorted(map(str, N.ngram_join(docs).select("doc_id", "class_id", "links").collect()))
    for name, value in (("BLOCK", 3), ("SMALL", 2)):
        monkeypatch.setattr(N, name, value)
    monkeypatch.setattr(C, "CHUNK", 2)
    assert sorted(map(str, N.ngram_join(docs).select("doc_id", "class_id", "links").collect())) == want


def test_runs_reach_the_target():
    assert N.runs_for(0.8, 0.999) > N.runs_for(0.8, 0.9) >= 1
    b, r = P.tuned_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999


def test_empty_tables(empty):
    assert N.ngram_join(empty).count() == 0
    assert N.one_of_each(empty).columns == empty.columns
    assert P.paragraph_dedup(empty).count() == 0
    assert L.line_dedup(empty).count() == 0


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 1)], {1: 1}), ([(k, k + 1) for k in range(20)] + [(30, 31), (31, 32), (5, 5), (5, 6)], {**dict.fromkeys(range(21), 0), 30: 30, 31: 30, 32: 30})])
def test_components(spark, edges, want):
    got = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want


def test_lines_go_only_where_they_stand_elsewhere(docs):
    got = L.line_dedup(docs)
    assert set(got.columns) == {*docs.columns, "lines", "removed"}
    rows = got.select("doc_id", "text", "lines", "removed").collect()
    before = defaultdict(set)
    for r in docs.select("doc_id", "text").collect():
        before[r["doc_id"]].add(r["text"])
    kept = "\x00".join(r["text"] or "" for r in rows)
    removed = 0
    for r in rows:
        texts = [t for t in before[r["doc_id"]] if t is not None and len(t.split("\n")) == r["lines"]]
        if r["text"] is None:
            assert r["lines"] == 0 and not r["removed"]
            continue
        gone = {k for s in r["removed"] for k in range(s["first"], s["last"] + 1)}
        fits = [t for t in texts if "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) == r["text"]]
        assert fits
        for s in r["removed"]:
            assert s["last"] > s["first"]
            chunk = "\n".join(fits[0].split("\n")[s["first"] : s["last"] + 1])
            assert chunk in kept
            removed += 1
    assert removed > 10


def test_later_copies_of_many_lines_vanish(spark):
    text = "\n".join(f"line {k} of it" for k in range(30))
    rows = [(2, text), (1, text), (3, "another first line\nand a second one\n" + text)]
    got = {r["doc_id"]: r for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == text and got[2]["text"] == ""
    assert len(got[3]["text"].split("\n")) < 20


def test_chunks_differ_where_hashes_do_not(spark, monkeypatch):
    """Bytes decide: with a hash that makes all chunks equal nothing that differs is removed."""
    rows = [(k, f"first line {k}\nsecond line {k}") for k in range(4)] + [(9, "first line 1\nsecond line 1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def same(window, divisor):
        def chunked(batches):
            import pyarrow as pa

            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("content"), pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array([7] * n)], names=["doc_id", "content", "first", "last", "key"])

        return chunked

    monkeypatch.setattr(L, "_chunked", same)
    assert all(not r["removed"] for r in L.line_dedup(df).collect())


def test_paragraphs_equal_brute_force(docs):
    rows = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["text"] is not None}
    found = defaultdict(list)
    for doc, text in rows:
        for k, line in enumerate(text.split("\n")):
            if len(line.split()) >= 20:
                found[" ".join(line.split()).lower()].append((doc is None, doc, k))
    root, _ = classes({shingled(x) for x in found})
    groups = defaultdict(list)
    for line, places in found.items():
        groups[root[shingled(line)]] += places
    key = lambda p: (p[0], p[1] or 0, p[2])
    want = {(d, k, *min(v, key=key)[1:]) for v in groups.values() for _, d, k in v if (_, d, k) != min(v, key=key)}
    gone = P.paragraph_dedup(docs)
    got = {tuple(r) for r in gone.select("doc_id", "paragraph", "kept_doc_id", "kept_paragraph").collect()}
    assert got == want and len(got) > 10
    left = P.without_paragraphs(docs, gone)
    assert left.columns == docs.columns and left.count() == docs.count()
    again = P.paragraph_dedup(left.where(F.col("doc_id").isNotNull()))
    assert again.where("not exact").count() == 0 or again.count() < len(want) / 4
