"""Packing, archives, decontamination, nearest neighbours and the pipeline against round trips and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from karst.llm import decontamination as D
from karst.llm import nearest as V
from karst.llm import packing as K
from karst.llm import warc as W

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_word_encoder_equals_tokenizer(tokenizer):
    import pyarrow as pa

    rng = random.Random(4)
    odd = ["it's 12'345 we'll", "Ünïcödé Straße É́ é", "<|endoftext|>x <|startoftext|>", "a b c\u0085d", "ΣΣ İI", "日本語 テスト", "\U0001f600!!??", "x" * 5000, "", " \n\t", "ª²½ × ÷", "\x1c\x1d", "don'T CAN'RE", "--..''\"\"", "\u0001\u0002", "ẞ ﬁ Å"]
    texts = odd + ["".join(rng.choice("aB'é.,!9ß́ \n<|>ÑΣ漢") for _ in range(60)) for _ in range(300)]
    ids, lengths = K.WordEncoder(PATH, 1)(pa.array(texts, pa.large_string()))
    at = 0
    for t, n in zip(texts, lengths, strict=True):
        assert ids[at : at + n].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1], repr(t)
        at += n
    assert at == len(ids)


def checked(rows, docs, tokenizer, length):
    """Each id in one piece, sequences without gaps, full or a power of two."""
    want = Counter((r["doc_id"], tuple([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in docs)
    pieces = Counter()
    for (doc, ids), n in want.items():
        pieces[doc, len(ids)] += n
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == pieces
    of = defaultdict(list)
    for (doc, ids), _ in want.items():
        of[doc, len(ids)].append(np.array(ids, "<u4"))
    covered = Counter()
    for r in rows:
        crcs = {zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for ids in of[r["doc_id"], r["doc_tokens"]]}
        assert r["length"] > 0 and r["ids_crc32"] in crcs
        covered[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert covered == Counter({k: k[1] * n for k, n in pieces.items()})
    seq = defaultdict(list)
    for r in rows:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for parts in seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(s == length or s < length and s & (s - 1) == 0 for s in sizes)
    assert sum(s < length for s in sizes) <= length.bit_length()


@pytest.mark.parametrize("window,buckets,mixture", [(1 << 17, 20_000, None), (512, 3, None), (1024, 2, {"s0": 3.0, "s1": 1.0, "gone": 2.0})])
def test_packing_round_trip(docs, tokenizer, window, buckets, mixture):
    rows = K.pack_documents(docs, PATH, length=256, window=window, grain=32, bucket_rows=buckets, mixture=mixture).collect()
    checked(rows, docs.select("doc_id", "text").collect(), tokenizer, 256)


def test_windows_hold_the_target_shares(spark, tokenizer):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["the", "of", "and"]) for _ in range(rng.randrange(5, 200))), "a" if rng.random() < 0.6 else "b") for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {k: s for k, _, s in rows}
    got = K.pack_documents(df, PATH, length=256, window=4096, grain=64).collect()
    total, share = sum(r["length"] for r in got), sum(r["length"] for r in got if source[r["doc_id"]] == "a")
    per = defaultdict(Counter)
    for r in got:
        per[r["sequence_id"] // 16][source[r["doc_id"]]] += r["length"]
    full = [c for k, c in sorted(per.items())[:-2]]
    assert len(full) > 20 and all(abs(c["a"] / sum(c.values()) - share / total) < 0.05 for c in full)


def test_packing_nothing(empty):
    assert K.pack_documents(empty, PATH).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "ä" * 200
    rows = [(5, "http://a/x", big, "q"), (3, "http://b/\r\nX: y", big, "q"), (None, None, big, "q"), (7, "http://c", "small", None), (8, "http://d", "small", "q"), (9, "", None, "q"), (10, "http://e", "", "q"), (3, "http://b/again", big, "q"), (11, "http://f", "x" * 3_000_000, "q"), (12, "http://g", "HTTP/1.1 200\r\n\r\nbody" * 20, "q"), (13, "u", big, "q"), (None, "v", "z" * 150, None), (None, "v", "z" * 150, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)


def test_archives_round_trip(spark, pages, tmp_path):
    index = W.write_archives(pages, f"file://{tmp_path}/warc")
    rows = W.resolved(W.read_archives(index)).collect()
    source = pages.collect()
    data = lambda r: (r["html"] or "").encode()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in rows) == Counter((r["page_id"], len(data(r)), hashlib.sha256(data(r)).hexdigest()) for r in source)
    groups = defaultdict(list)
    for r in rows:
        groups[r["payload_digest"]].append(r)
    for g in groups.values():
        if g[0]["payload_bytes"] < 100:
            assert all(r["record_type"] == "response" and r["refers_to"] is None for r in g)
        else:
            first = [r for r in g if r["record_type"] == "response"]
            ids = [r["page_id"] for r in g if r["page_id"] is not None]
            assert len(first) == 1 and first[0]["page_id"] == (min(ids) if ids else None)
            assert all(r["refers_to"] == first[0]["page_id"] for r in g if r["record_type"] == "revisit")
    texts = {r["payload_digest"]: bytes(r["payload"]) for r in W.read_archives(index).collect() if r["payload"] is not None}
    assert all(texts[hashlib.sha256(data(r)).hexdigest()] == data(r) for r in source)


def test_selected_records_only_and_the_format(spark, pages, tmp_path, monkeypatch):
    import gzip

    index = W.write_archives(pages, f"file://{tmp_path}/warc")
    monkeypatch.setattr(W, "GAP_BYTES", 0)
    some = W.read_archives(index.where("page_id in (7, 10)")).collect()
    assert sorted(r["page_id"] for r in some) == [7, 10]
    files = list((tmp_path / "warc").glob("*.warc.gz"))
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert raw.count(b"WARC/1.1\r\n") == pages.count() + len(files) and b"\nX: y" not in raw
    assert W.write_archives(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        t[k : k + 1] = rng.choice([[], ["q"], [t[k], "z"]])
    return "".join(t)


def test_contamination_found_and_clean_texts_left(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(rng.randrange(15, 60)).capitalize() + ".") for k in range(12)] + [(50, ""), (51, None), (52, "tiny"), (3, None), (None, prose(30))]
    rows, want = [], set()
    for k in range(60):
        text = prose(rng.randrange(1, 200))
        if k % 3 == 0:
            item, passage = items[k % 12]
            text = f"{text}\n{edited(rng, passage, 2).upper() if k % 2 else passage} {prose(5)}"
            want.add((k, item))
        rows.append((k, text))
    rows += [(100, None), (101, ""), (102, "tiny"), (103, prose(40_000)), (None, items[1][1]), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn
    docs = docs("item_id", __import__("pyspark").sql.functions.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(docs, bench)
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found == want | {(None, 1)}
    left = D.without_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {r[0] for r in rows} - {d for d, _ in found}
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    bench = spark.createDataFrame([(k, prose(20)) for k in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(r["item_id"], f"{prose(10)} {r['text']} {prose(10)}") for r in bench.collect()], "doc_id long, text string")
    want = {(k, k) for k in range(20)}
    monkeypatch.setattr(D, "BLOCK_CHARS", 700)
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()} == want


def test_alignment_is_the_edit_distance():
    rng = random.Random(10)
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(n)) for n in (8, rng.randrange(0, 14)))
        row = [0] * (len(t) + 1)
        for c in p:
            new = [row[0] + 1]
            for j, d in enumerate(t):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (c != d)))
            row = new
        got = D.aligned(code(p), code(t), 4)
        assert (got is None) == (min(row) > 4) or min(row) >= 4
        if got:
            assert got[2] == min(row)


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            out[i] = sorted((-float((x * v).sum()), j) for j, x in good if j != i)[:k]
    return out


@pytest.mark.parametrize("n,k", [(900, 20), (15, 20)])
def test_neighbours_against_brute_force(spark, n, k, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(V, "LIST_CHUNK", 50)
    monkeypatch.setattr(V, "QUERY_CHUNK", 7)
    monkeypatch.setattr(V, "SAMPLE", 200)
    x = rng.normal(size=(n, 8)) * rng.uniform(0.5, 2, size=(n, 1))
    x[5:25] = x[5] if n > 100 else x[5:25]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    rows += [(5000, None), (5020, [0.0] * 8), (5040, [None] * 8), (5060, [float("nan")] * 8), (5080, [float("inf")] * 8), (5100, [1.0] * 3), (None, [1.0] * 8), (5120, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as score", "1 as list").repartition(4)
    want, got = brute(rows, k), defaultdict(list)
    for r in V.nearest(df, k).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = total = 0
    by = dict(rows)
    for q, best in want.items():
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1))
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        assert all(abs(s - float(np.dot(by[q], by[v]))) < 1e-9 for _, v, s in own)
        hits += len({v for _, v, _ in own} & {j for _, j in best})
        total += len(best)
    assert hits >= 0.9 * total


def test_no_vectors(spark):
    assert V.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert V.nearest(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stages(spark, tmp_path, tokenizer):
    """Each stage on what the one before kept, held against what it must do."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = [docs]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, seen[-1], sf)
        path = str(tmp_path / f"{k}")
        out.write.parquet(path)
        seen.append(spark.read.parquet(path))
        if k < len(cp.STAGES) - 1:
            assert seen[-1].schema.names == docs.schema.names, name
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen[:5]]
    assert ids[1] < ids[0] and sum(labels.get(i) == 1 for i in ids[0] - ids[1]) + sum(labels.get(i) == 0 for i in ids[1]) <= 0.01 * len(labels)
    text = [{r["doc_id"]: r for r in d.collect()} for d in seen[:5]]
    assert all(text[2][i]["n_chars"] == len(text[2][i]["text"]) for i in ids[2])
    assert any(len(text[2][i]["text"]) < len(text[1][i]["text"]) for i in ids[2])
    shingled = lambda t: (lambda w: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))(t.lower().split())
    sets = {i: shingled(text[3][i]["text"]) for i in ids[3]}
    close = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    items = sorted(sets)
    assert not any(close(sets[a], sets[b]) for n, a in enumerate(items) for b in items[:n])
    gone = ids[2] - ids[3]
    before = {i: shingled(text[2][i]["text"]) for i in ids[2]}
    assert gone and all(any(close(before[i], before[j]) for j in ids[2] if j != i) for i in gone)
    assert ids[3] - ids[4] == {i for i in ids[3] if any(b in text[3][i]["text"] for b in bench)}
    checked(seen[5].collect(), list(text[4].values()), tokenizer, 2048)
