"""Removal of multi-line chunks that occur elsewhere in the corpus.

A rolling hash over the last ``window`` line hashes marks the lines that end a chunk, so borders depend on what stands around them and
on nothing before. With a ``divisor`` above 1 one line in about ``divisor`` ends a chunk, and a repeated passage is found only where it
holds a whole chunk. With ``divisor`` 1, the default, every line does and each run of ``window`` lines is a chunk: chunks overlap, and a
repeated passage is found whatever stands around it and wherever it begins.

Only numbers move to find chunks that occur more than once (group-by with map-side pre-aggregation: a chunk in a third of all documents
costs one row per task); the first occurrence stays. Then the bytes of the repeated chunks are compared: one pre-aggregated least and
greatest text for each key. Where they differ, if anywhere, each occurrence is held against the first, and those that differ are kept.
Texts move once, and are cut by built-in functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import large, mix, session_of, staged, task

#: Marks of a text as sorted spans of lines that do not overlap; the first and the last marks of each run of overlapping ones.
_SPANS = """transform(array(array_sort({})), a -> transform(arrays_zip(
  filter(a, (m, k) -> k = 0 or a[k - 1].last < m.first), filter(a, (m, k) -> k = size(a) - 1 or a[k + 1].first > m.last)),
  s -> struct(s.`0`.first as first, s.`1`.last as last)))[0]"""
#: The lines of a text outside the spans, joined again: the slices between them, so that the work is in proportion to the text.
_CUT = """transform(array(split(text, '\\n')), l -> array_join(flatten(transform(sequence(0, size(removed)), k -> slice(l,
  if(k = 0, 0, removed[k - 1].last + 1) + 1,
  if(k = size(removed), size(l), removed[k].first) - if(k = 0, 0, removed[k - 1].last + 1)))), '\\n'))[0]"""
#: The text of each mark.
_CHUNKS = """explode(transform(array(split(text, '\\n')), l -> transform(_marks, m -> struct(m.key as key, m.stays as stays, m.first as first,
  array_join(slice(l, m.first + 1, m.last - m.first + 1), '\\n') as chunk)))[0]) as c"""


def chunks(texts: pa.Array, window: int = 2, divisor: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first line, last line (both from 0) and key of each chunk of two lines and more."""
    lists = pc.split_pattern(large(texts), "\n")
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    known = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    h = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)
    base = np.cumsum(counts) - counts
    at = np.arange(len(h)) - base[doc]
    rolling = h.copy()
    for back in range(1, min(window, len(h))):
        rolling[back:] = mix(rolling[back:], h[: len(h) - back])
    if divisor == 1:
        last = np.flatnonzero(at >= max(window, 2) - 1)
        return doc[last], at[last] - max(window, 2) + 1, at[last], rolling[last]
    ends = (rolling % np.uint64(divisor) == 0) & (at >= max(window, 2) - 1)
    ends[1:] &= ~ends[:-1]  # borders stand two lines apart at least
    final = base + counts - 1
    ends[final[counts > 1] - 1] = False
    ends[final] = True
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    odd, sums = 0x9E3779B97F4A7C15, np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):  # a polynomial of the line hashes, from prefix sums, so that its place in the batch cancels out
        powers, inverse = (np.cumprod(np.full(len(h), x, np.uint64), dtype=np.uint64) for x in (odd, pow(odd, -1, 1 << 64)))
        np.cumsum(mix(h, h) * powers, out=sums[1:], dtype=np.uint64)
        key = mix((sums[last + 1] - sums[first]) * inverse[first], (last - first).astype(np.uint64))
    many = last > first
    return doc[last[many]], at[first[many]], at[last[many]], key[many]


def _chunked(window: int, divisor: int):
    def chunked(batches):
        for b in batches:
            doc, first, last, key = chunks(b.column("text"), window, divisor)
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(own), b.column("content").take(own), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(key.view(np.int64))], names=["doc_id", "content", "first", "last", "key"])

    return task(chunked)


def _is(doc: Column | str = "doc_id", text: str = "text") -> Column:
    """Whether a row is the document that _doc and _content name."""
    return F.col(doc).cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_content"))


def line_dedup(docs: DataFrame, window: int = 2, divisor: int = 1) -> DataFrame:
    """docs with text cleaned, lines (how many there were) and removed (array of first and last line, from 0).

    docs: doc_id long, text string; other columns pass through, but for columns named lines or removed, which are replaced. A
    chunk is a run of ``window`` lines, two at least (with a divisor above 1: two lines at least, between borders); of equal chunks
    the one with the smallest doc_id (null last), then the first in its text stays, but for lines that
    another chunk takes: each line that goes stays somewhere before. A chunk that overlaps the first of its kind stays too. Chunks
    that overlap are removed as one. A text of which nothing stays becomes empty; a null text stays null and has 0 lines. Rows that
    repeat both doc_id and text are one document: all of them are treated alike.
    """
    session_of(docs)
    own = [c for c in docs.columns if c not in ("lines", "removed", "text")]
    named = {c: f"_own_{k}" for k, c in enumerate(own) if c != "doc_id"}  # no column of docs can be taken for one of ours
    docs = docs.select(F.col("doc_id"), *(F.col(f"`{c}`").alias(n) for c, n in named.items()), F.col("text").cast("string").alias("text"))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    found = staged(rows.mapInArrow(_chunked(window, divisor), "doc_id long, content long, first int, last int, key long"))
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "first")
    firsts = found.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(at).alias("at")).where("many > 1").select("key", "at")
    beside = F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("content") == F.col("at.content")) & (F.col("first") - F.col("at.first") <= F.col("last") - F.col("first"))
    marks = found.join(firsts, "key").select(F.col("doc_id").alias("_doc"), F.col("content").alias("_content"), F.struct("first", "last", "key", beside.alias("stays")).alias("mark"))
    marks = marks.distinct().groupBy("_doc", "_content").agg(F.collect_list("mark").alias("_marks"))
    marked = staged(docs.join(marks, _is(), "left").drop("_doc", "_content"))

    texts = marked.where("_marks is not null").select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_content"), F.expr(_CHUNKS)).select("_doc", "_content", "c.*")
    unlike = staged(texts.groupBy("key").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).where("least <> most").select("key"))
    goes = "filter(coalesce(_marks, array()), m -> not m.stays)"
    if not unlike.isEmpty():  # equal hashes of different chunks
        some = texts.join(unlike, "key")
        stays = some.where("stays").groupBy("key").agg(F.min("chunk").alias("_first"))
        differ = some.where("not stays").join(stays, "key").where("chunk <> _first").groupBy("_doc", "_content").agg(F.collect_set("first").alias("_differ"))
        marked = marked.join(differ, _is(), "left")
        goes = "filter(coalesce(_marks, array()), m -> not m.stays and not array_contains(coalesce(_differ, array()), m.first))"
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("int")
    done = marked.select("*", F.expr(_SPANS.format(goes)).alias("removed")).withColumn("lines", lines)
    text = F.expr(f"case when size(removed) = 0 then text else {_CUT} end").alias("text")
    return done.select(*(F.col("doc_id") if c == "doc_id" else F.col(named[c]).alias(c) for c in own), text, "lines", "removed")
