"""Repeated runs of lines against brute force."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from karst.llm import line_dedup as L


def test_all_repeated_runs_of_lines_go(spark):
    """Runs of 2 to 10 lines in other surroundings, at the start, inside and at the end, go whole; nothing else does."""
    rng = random.Random(8)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(6))
    shared = {n: [line() for _ in range(n)] for n in range(2, 11)}
    rows, want = [], {}
    for n, run in shared.items():
        for k in range(4):
            doc, before, after = 10 * n + k, [0, 3, 1, 4][k], [5, 2, 0, 1][k]
            text = [*(line() for _ in range(before)), *run, *(line() for _ in range(after))]
            rows.append((doc, "\n".join(text)))
            want[doc] = text if k == 0 else text[:before] + text[before + n :]
    single = line()
    for doc in (1, 2):
        text = [line(), single, line()]
        rows.append((doc, "\n".join(text)))
        want[doc] = text
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {d: "\n".join(t) for d, t in want.items()}
    assert all(len(r["removed"]) == (r["doc_id"] > 2 and r["doc_id"] % 10 > 0) for r in got)


def test_lines_that_go_stand_before(docs):
    """Each two neighbours that stand at an earlier place, and not beside it, go; each line that goes is in such a pair."""
    found = L.line_dedup(docs).select("doc_id", "lines", "removed").collect()
    texts = {r["doc_id"]: r["text"].split("\n") for r in docs.select("doc_id", "text").collect() if r["text"] is not None}
    first, gone = {}, {}
    for doc in sorted(texts, key=lambda d: (d is None, d or 0)):
        for k in range(len(texts[doc]) - 1):
            d, at = first.setdefault(tuple(texts[doc][k : k + 2]), (doc, k))
            if d != doc or k - at > 1:
                gone.setdefault(doc, set()).update((k, k + 1))
    assert len(gone) > 10
    for r in found:
        if r["lines"]:
            assert {k for s in r["removed"] for k in range(s["first"], s["last"] + 1)} == gone.get(r["doc_id"], set())


def test_borders_depend_on_what_stands_around_them():
    """With coarse borders a passage's inner chunks are the same wherever it stands; all chunks of a text are side by side."""
    rng = random.Random(9)
    line = lambda: f"l{rng.randrange(10**9)}"
    passage = [line() for _ in range(60)]
    texts = ["\n".join([*(line() for _ in range(n)), *passage, *(line() for _ in range(5))]) for n in (0, 1, 7, 30)] + ["", "one", "one\ntwo", "x\n" * 9]
    doc, first, last, key = L.chunks(pa.array(texts), 2, 4)
    inner = [{int(k) for k, a, z in zip(key[doc == d], first[doc == d], last[doc == d], strict=True) if n < a and z < n + 60} for d, n in enumerate((0, 1, 7, 30))]
    assert len(set.intersection(*inner)) >= 5
    for d, text in enumerate(texts):
        a, z = first[doc == d], last[doc == d]
        assert (z > a).all() and (a[1:] == z[:-1] + 1).all()
        assert (a.tolist()[:1], z.tolist()[-1:]) == (([0], [text.count("\n")]) if "\n" in text else ([], []))


def test_clashing_names_and_no_rows(spark, docs):
    """Columns with names that the operator uses inside pass through as they are."""
    names = ("_doc", "_content", "_marks", "_differ", "content", "key", "first", "removed", "lines", "c")
    clash = docs.select("doc_id", "text", *(F.lit(n).alias(n) for n in names))
    got = L.line_dedup(clash)
    assert set(got.columns) == {"doc_id", "text", *names}
    rows = got.collect()
    assert len(rows) == docs.count() and all(r[n] == n for r in rows for n in names if n not in ("removed", "lines"))
    assert sorted(map(str, got.select("doc_id", "text", "lines", "removed").collect())) == sorted(map(str, L.line_dedup(docs).select("doc_id", "text", "lines", "removed").collect()))
    nothing = L.line_dedup(spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")).collect()
    assert [(r["text"], r["lines"], r["removed"]) for r in nothing] == [(None, 0, [])] * 2
