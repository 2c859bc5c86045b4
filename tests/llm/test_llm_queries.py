"""The registered queries on whole tables against their contracts."""

import zlib

import pytest

DIR = "/root/testdata/sf0.001"
held = lambda i, mod, rem: zlib.crc32(str(i).encode()) % mod == rem


@pytest.fixture(scope="module")
def run(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    return lambda name: queries[name](spark, DIR)


@pytest.fixture(scope="module")
def ids(spark):
    return sorted(r["doc_id"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("name,mod,rem", [("op2_language_id", 3, 1), ("op7_quality", 5, 0), ("op9_lm_scoring", 7, 2)])
def test_models_score_each_document(run, ids, name, mod, rem):
    rows = run(name).collect()
    assert sorted(r["doc_id"] for r in rows) == ids
    assert all(r["held_out"] == held(r["doc_id"], mod, rem) for r in rows)
    if name == "op9_lm_scoring":
        assert all(r["base_score"] < 0 and r["score"] <= 0 and 0 < r["n_tokens"] and r["n_known"] <= r["n_tokens"] for r in rows)
        assert len({r["train_tokens"] for r in rows}) == 1 and rows[0]["train_tokens"] == sum(r["n_tokens"] for r in rows if not r["held_out"])
        assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    else:
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name == "op7_quality":
        assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_lines_and_classes_cover_all_documents(run, ids):
    assert sorted(r["doc_id"] for r in run("op1_line_dedup").select("doc_id").collect()) == ids
    rows = run("op4_ngram_join").collect()
    assert sorted(r["doc_id"] for r in rows) == ids and {r["class_id"] for r in rows} <= set(ids)
    assert all(r["class_id"] <= r["doc_id"] for r in rows)


def test_found_rows_name_documents(run, ids):
    for name in ("op3_decontamination", "op6_substring_dedup"):
        assert {r["doc_id"] for r in run(name).select("doc_id").collect()} <= set(ids)


def test_neighbours_and_pieces(run, ids):
    rows = run("op8_nearest").collect()
    by = {}
    for r in rows:
        assert r["query_id"] % 20 == 0 and r["vec_id"] != r["query_id"]
        by.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert all(sorted(v) == sorted(v, key=lambda x: x[1:]) and [x[0] for x in sorted(v)] == list(range(1, 21)) for v in by.values())
    pieces = run("op10_packing").collect()
    total = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert sorted(total) == ids
    for doc in ids:
        at = 0
        for start, length in sorted((r["start"], r["length"]) for r in pieces if r["doc_id"] == doc):
            assert start == at
            at += length
        assert at == total[doc]
