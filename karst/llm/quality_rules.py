"""Quality rules over whole texts: counts of words, symbols and repetition, and how far a text's histograms are from those of languages.

For each language of the corpus two reference histograms are learned from all of its documents that are long enough: of character
classes, and of its common words, which are those that make at least one in ``share`` of all its words; all others are one bin. A
document's histograms are held against every language by Jensen-Shannon distance (base 2, so from 0 to 1), and the nearest counts:
the language that a document is said to have plays no part. A histogram of few words is noisy, and the noise falls with the root of
their number; so does the limit on the distance of words.

Common words are found exactly and without counting all words: in some block a common word makes at least half its share, so only
words that do so in a block of texts are reported, and what no block reports is bounded. At most 2 * share words of a language can
reach the bound; those alone are counted in a second pass over all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, gathered, large, session_of, task

#: Classes of characters: those of ASCII by name, and all others.
CLASSES = ("lower", "upper", "digit", "blank", "stop", "mark", "other", "high")
BLANK = bytes([9, 10, 11, 12, 13, 32])
STOP, MARK = b".,;:!?'\"()-", b"#*$%&|<>"


def _table() -> np.ndarray:
    """The class of each byte; bytes that go on a character have a number of their own, after the classes."""
    table = np.full(256, CLASSES.index("other"), np.int64)
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", BLANK), ("stop", STOP), ("mark", MARK), ("high", range(192, 256))):
        table[list(chars)] = CLASSES.index(name)
    table[128:192] = len(CLASSES)
    return table


TABLE = _table()


@dataclass
class Words:
    """The words of a block of texts: their strings, the text of each, and how many each text has."""

    strings: pa.Array
    doc: np.ndarray
    many: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Words are what ASCII white space separates."""
    lists = pc.ascii_split_whitespace(texts)
    flat = pc.list_flatten(lists)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    real = pc.greater(pc.binary_length(flat), 0)
    if pc.all(real).as_py() is False:  # white space at either end leaves empty strings
        flat, doc = flat.filter(real), doc[real.to_numpy(zero_copy_only=False)]
    return Words(flat, doc, np.bincount(doc, minlength=len(texts)))


def _codes(strings: pa.Array) -> np.ndarray:
    return pc.dictionary_encode(strings).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def class_counts(texts: pa.Array) -> np.ndarray:
    """Characters of each class, one row for each text."""
    n, width = len(texts), len(CLASSES) + 1
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    kinds = TABLE[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.int64)
    kinds += np.repeat(np.arange(n) * width, np.diff(offsets))
    return np.bincount(kinds, minlength=n * width).reshape(n, width)[:, :-1]


def repeated_words(words: Words) -> np.ndarray:
    """For each text, its words in 3-word windows that stand in it twice or more, the first included."""
    codes, doc, n = _codes(words.strings), words.doc, len(words.many)
    if len(codes) < 3:
        return np.zeros(n, np.int64)
    _, pair = np.unique(codes[:-1] << 32 | codes[1:], return_inverse=True)
    _, window = np.unique(pair[:-1] << 32 | codes[2:], return_inverse=True)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    _, own, times = np.unique(doc[at] << 32 | window[at], return_inverse=True, return_counts=True)
    again = at[times[own] > 1]
    inside = np.zeros(len(codes), bool)
    for k in range(3):
        inside[again + k] = True
    return np.bincount(doc[inside], minlength=n)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """For each text, its lines with a word that equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    flat = pc.list_flatten(lists)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    real = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0)
    doc = doc[real.to_numpy(zero_copy_only=False)]
    different = np.unique(doc << 32 | _codes(flat.filter(real)))
    return np.bincount(doc, minlength=len(texts)) - np.bincount(different >> 32, minlength=len(texts))


@dataclass
class References:
    """Histograms of languages: at most ``languages`` times 2 * share words, whatever the corpus.

    words: the common words of all languages; shares: for each language the share of each of them (0: not common there); classes: for each
    language the shares of the character classes.
    """

    words: list[str]
    shares: np.ndarray
    classes: np.ndarray


def _usable(block: pa.Table, least: int):
    """Words, languages (as codes and names) and class counts of the texts of a block that have a language and enough words."""
    texts, lang = large(block["text"]), block["lang"].combine_chunks()
    some = pc.is_valid(lang)
    texts, lang = texts.filter(some), lang.filter(some)
    words = words_of(texts)
    long = pa.array(words.many >= least)
    texts, lang = texts.filter(long), pc.dictionary_encode(lang.filter(long))
    words = words_of(texts)
    return texts, Words(pc.ascii_lower(words.strings), words.doc, words.many), lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), lang.dictionary.to_pylist()


def _reported(share: int, least: int):
    """For each block and language the words that make one in 2 * share of its words; its number of words under a null word."""

    def reported(batches):
        for block in gathered(batches, BATCH_BYTES):
            texts, words, lang, names = _usable(block, least)
            if not len(texts):
                continue
            coded = pc.dictionary_encode(words.strings)
            own = lang[words.doc]
            totals = np.bincount(own, minlength=len(names))
            keys, many = np.unique(own << 32 | coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            common = many * 2 * share >= totals[keys >> 32]
            keys, many = keys[common], many[common]
            spelled = coded.dictionary.take(pa.array(keys & 0xFFFFFFFF)).cast(pa.string())
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([names[k] for k in keys >> 32] + names, pa.string()),
                "word": pa.concat_arrays([spelled, pa.nulls(len(names), pa.string())]),
                "n": np.concatenate([many, totals]),
                "seen": np.concatenate([totals[keys >> 32], totals]),
            })

    return task(reported)


def _counted(vocabulary: list[str], langs: list[str], least: int):
    """Occurrences of each word of a vocabulary and characters of each class, by language; at: the word, or below 0 the class."""

    def counted(batches):
        known, width = pa.array(vocabulary, pa.large_string()), len(vocabulary) + len(CLASSES)
        sums = np.zeros((len(langs), width), np.int64)
        for block in gathered(batches, BATCH_BYTES):
            texts, words, lang, names = _usable(block, least)
            place = np.array([langs.index(x) if x in langs else -1 for x in names], np.int64)
            own = place[lang] if len(lang) else lang
            found = pc.fill_null(pc.index_in(words.strings, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            use = (found >= 0) & (own[words.doc] >= 0)
            sums += np.bincount(own[words.doc][use] * width + found[use], minlength=sums.size).reshape(sums.shape)
            np.add.at(sums[:, len(vocabulary) :], own[own >= 0], class_counts(texts)[own >= 0])
        row, at = np.nonzero(sums)
        if len(row):
            yield pa.RecordBatch.from_pydict({"lang": row, "at": np.where(at < len(vocabulary), at, len(vocabulary) - 1 - at), "n": sums[row, at]})

    return task(counted)


def learn_references(docs: DataFrame, share: int = 500, least_words: int = 50, languages: int = 64) -> References:
    """The references of the ``languages`` languages with the most words, from all texts of ``least_words`` words and more.

    docs: text string, lang string. A null text or language teaches nothing; repeated rows count once each; without any document with
    a language and enough words there are no references.
    """
    session_of(docs)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(_reported(share, least_words), "lang string, word string, n long, seen long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    totals = sums.where("word is null").select("lang", F.col("n").alias("all")).orderBy(F.desc("all"), "lang").limit(languages)
    able = sums.where("word is not null").join(F.broadcast(totals), "lang")  # at most ``languages`` rows
    found = totals.select("lang", "all", F.lit(None).cast("string").alias("word")).unionAll(able.where(f"2 * {share} * n + all - seen >= 2 * all").select("lang", "all", "word")).collect()
    every = {r["lang"]: r["all"] for r in found}
    langs, vocabulary = sorted(every), sorted({r["word"] for r in found if r["word"] is not None})
    counts = np.zeros((len(langs), len(vocabulary) + len(CLASSES)))
    if langs:
        summed = rows.mapInArrow(_counted(vocabulary, langs, least_words), "lang long, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
        for r in summed.collect():  # at most a word or class of a language each
            counts[r["lang"], r["at"] if r["at"] >= 0 else len(vocabulary) - 1 - r["at"]] = r["n"]
    whole = np.array([every[x] for x in langs], float).reshape(-1, 1)
    words, classes = counts[:, : len(vocabulary)], counts[:, len(vocabulary) :]
    shares = np.where(words * share >= whole, words / np.maximum(whole, 1), 0)
    used = shares.any(axis=0) if langs else np.zeros(len(vocabulary), bool)
    return References([w for w, u in zip(vocabulary, used, strict=True) if u], shares[:, used], classes / np.maximum(classes.sum(axis=1, keepdims=True), 1))


def _halves(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What bins with shares p and q add to twice the squared distance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(2 * p / (p + q)), 0) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0)


def distances(words: Words, classes: np.ndarray, refs: References) -> tuple[np.ndarray, np.ndarray]:
    """For each text its distance of words and of classes to the nearest language; a text without words or characters is as far as can be."""
    n = len(words.many)
    of_words, of_classes = np.ones(n), np.ones(n)
    found = pc.fill_null(pc.index_in(pc.ascii_lower(words.strings), pa.array(refs.words, pa.large_string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    keys, many = np.unique((words.doc << 32 | found)[found >= 0], return_counts=True)
    doc, word = keys >> 32, keys & 0xFFFFFFFF
    p = many / words.many[doc]
    share = classes / np.maximum(classes.sum(axis=1, keepdims=True), 1)
    some, full = words.many > 0, classes.sum(axis=1) > 0
    for own, kinds in zip(refs.shares, refs.classes, strict=True):
        q = own[word]
        common = q > 0
        add = lambda x: np.bincount(doc[common], weights=x[common], minlength=n)  # noqa: B023, E731
        twice = add(_halves(p, q)) + (own.sum() - add(q)) + _halves(np.maximum(1 - add(p), 0), np.full(n, 1 - own.sum()))
        of_words = np.where(some, np.minimum(of_words, np.sqrt(np.clip(twice / 2, 0, 1))), 1)
        of_classes = np.where(full, np.minimum(of_classes, np.sqrt(np.clip(_halves(share, np.broadcast_to(kinds, share.shape)).sum(axis=1) / 2, 0, 1))), 1)
    return of_words, of_classes


def _judged(refs: References, least_words: int, least_chars: int, most_repeated: int, classes_limit: float, words_limit: float, words_noise: float):
    def judged(batches):
        for block in gathered(batches, BATCH_BYTES):
            texts = large(block["text"])
            words, classes, repeated = words_of(texts), class_counts(texts), None
            repeated = repeated_words(words)
            chars = classes.sum(axis=1) - classes[:, CLASSES.index("blank")]
            failed = (words.many < least_words) | (100 * repeated > most_repeated * words.many)
            kept = ~failed
            far_words, far_classes = distances(words, classes, refs)
            if len(refs.classes):
                kept &= far_words <= words_limit + words_noise / np.sqrt(np.maximum(words.many, 1))
                kept &= (far_classes <= classes_limit) | (chars < least_chars)
            yield from pa.table({
                "doc_id": block["doc_id"], "n_words": words.many, "word_chars": chars, "n_symbols": classes[:, CLASSES.index("mark")], "n_dup_lines": repeated_lines(texts),
                "n_repeat_words": repeated, "base_failed": failed, "kept": kept, "word_distance": far_words, "class_distance": far_classes,
            }).to_batches()

    return task(judged)


def quality_rules(
    docs: DataFrame,
    refs: References | None = None,
    least_words: int = 50,
    most_repeated: int = 50,
    least_chars: int = 200,
    classes_limit: float = 0.3,
    words_limit: float = 0.27,
    words_noise: float = 1.3,
) -> DataFrame:
    """One row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, word_distance, class_distance.

    docs: doc_id long, text string, and lang string where no references are given; other columns are ignored. A text fails the base with
    fewer than least_words words, or where more than most_repeated of 100 words stand in 3-word windows that it has twice. Else it
    is kept if its distance of words is at most words_limit + words_noise / sqrt(n_words), and that of classes at most classes_limit (not
    asked of texts with fewer than least_chars characters that are no white space). Without references nothing but the base is asked.

    A null or empty text has zeros, distances of 1, and fails; a null doc_id is judged as any other; repeated rows are judged once each;
    an empty table gives no rows.
    """
    session_of(docs)
    refs = learn_references(docs, least_words=least_words) if refs is None else refs
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, word_distance double, class_distance double"
    return rows.mapInArrow(_judged(refs, least_words, least_chars, most_repeated, classes_limit, words_limit, words_noise), schema)
