"""The queries opN_<name> over the tables of a data folder, each through its operator with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def _remainder(mod: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without runs of lines that stand before elsewhere; see line_dedup() for nulls, ties and repeated rows."""
    from .line_dedup import line_dedup

    return line_dedup(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those with remainder 0 or 2; `und` without a letter. See language_ids()."""
    from .language_id import fit_languages, language_ids

    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = language_ids(docs.drop("lang"), fit_languages(docs))
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark; null and empty texts hold none. See contaminated()."""
    from .decontamination import contaminated

    return contaminated(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its similar texts and its number of links; texts without words are alone. See ngram_join()."""
    from .ngram_join import ngram_join

    return ngram_join(_read(spark, sf_dir, "documents", "doc_id", "text")).drop("content", "root")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record says after writing and reading the archives; a null html is an empty payload. See resolved()."""
    from .warc import archive_folder, read_archives, resolved, write_archives

    index = write_archives(_read(spark, sf_dir, "pages", "page_id", "url", "html"), archive_folder(spark))
    return resolved(read_archives(index, payloads=False))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of rows: paragraphs (from paragraph_dedup) and runs of words (from passage_dedup), whose columns are null in the other kind."""
    from .common import collected
    from .paragraph_dedup import paragraph_dedup
    from .passage_dedup import passage_dedup

    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    passages = passage_dedup(docs)
    collected(spark)
    return paragraph_dedup(docs).unionByName(passages, allowMissingColumns=True).drop("content")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels whose remainder is not 0; empty texts have a score too. See quality_scores()."""
    from .quality import fit_quality, quality_scores

    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    model = fit_quality(docs, _read(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("quality", "label"))
    return quality_scores(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each vec_id divisible by 20; unusable vectors take no part. See nearest()."""
    from .nearest import nearest

    return nearest(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability and its base score, learned from those whose remainder is not 2; a null text is empty. See lm_scores()."""
    from .lm_scoring import lm_scores

    return lm_scores(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens; a null text gives its separator alone. See pack_documents()."""
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents", "doc_id", "text", "source"), public_tokenizers.path("word_bpe_49k.json"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every usable vector after ten exact rounds; see ball_tree_clusters() for what is unusable."""
    from .ball_tree import ball_tree_clusters

    return ball_tree_clusters(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; a null text has zeros and fails. See quality_rules()."""
    from .quality_rules import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents", "doc_id", "text", "lang")).drop("word_distance", "class_distance")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and their counts of every document; texts that their tokens do not spell have zeros. See align_tokens()."""
    import public_tokenizers

    from .alignment import align_tokens

    return align_tokens(_read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_language_id, op3_decontamination, op4_ngram_join, op5_warc, op6_substring_dedup, op7_quality, op8_nearest, op9_lm_scoring, op10_packing, op11_centroid_clusters,
    op12_quality_rules, op13_token_alignment,
)}

def _clusters_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Rounds as common tables: a<r> gives each vector its nearest centroid of c<r>, c<r + 1> has the floors of the means."""
    parts = [
        f"""kept as materialized (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings
            where vec_id is not null and len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x) and abs(x::double) <= 131072)) = {dims})""",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || vec_id), v) - 1 c, v from kept order by c limit {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as materialized (select vec_id, v, c, d from (select e.vec_id, e.v, c.c, list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from kept e, c{r} c)
            qualify row_number() over (partition by vec_id order by d, c) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} as materialized (select c, coalesce(m.v, o.v) v from c{r} o left join (select c, list((s - ((s % n) + n) % n) // n order by i)::bigint[] v
            from (select c, i, sum(x) s, count(*) n from (select c, unnest(v) x, unnest(range({dims})) i from a{r}) group by c, i) group by c) m using (c))""")
    return f"""with {", ".join(parts)}
        select vec_id, c::int as cluster, d::bigint distance, (sum(d) over (partition by c))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, sha256(array_to_string(o.v, ',')) centroid_sha256
        from a{rounds} join c{rounds} o using (c)"""


_KINDS = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "blank": "[\\t-\\r ]", "stop": "[-.,;:!?''\"()]", "mark": "[#*$%&|<>]", "high": "[^\\x00-\\x7f]"}
_BIN = "case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end"
_RULES = f"""with d as (select doc_id, row_number() over () r, lang, coalesce("text", '') t from documents),
    w as materialized (select r, i, w, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from (select r, unnest(l) w, unnest(range(len(l))) i from (select r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') l from d))),
    n as (select r, count(*) n, sum(length(w)) chars from w group by r),
    win as (select r, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o k from w window o as (partition by r order by i)),
    rep as (select r, count(distinct i + s) n from (select r, i from win where k is not null qualify count(*) over (partition by r, k) > 1), range(3) x(s) group by r),
    dup as (select r, count(*) - count(distinct l) n from (select r, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by r),
    kinds as (select r, length(t) all_, {", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) {k}" for k, p in _KINDS.items())} from d),
    cls as materialized (select r, k, case k when 'other' then all_ - {" - ".join(_KINDS)} {" ".join(f"when '{k}' then {k}" for k in _KINDS)} end n, all_ from kinds, (select unnest([{", ".join(f"'{k}'" for k in [*_KINDS, "other"])}]) k)),
    use as (select r, lang from d join n using (r) where lang is not null and n.n >= 50),
    tot as (select lang, sum(n.n) n from use join n using (r) group by lang),
    ref as materialized (select lang, low, c.n / tot.n q from (select lang, low, count(*) n from use join w using (r) group by lang, low) c join tot using (lang) where c.n * 500 >= tot.n),
    cref as (select lang, k, sum(n) / sum(sum(n)) over (partition by lang) q from use join cls using (r) group by lang, k),
    hist as (select w.r, lang, low, count(*) / any_value(n.n) p, any_value(q) q from w join n using (r) join ref using (low) group by w.r, lang, low),
    rest as (select lang, sum(q) q from ref group by lang),
    far as (select r, min(sqrt(least(1, greatest(0, (bins + unseen + ({_BIN})) / 2)))) far from (
        select n.r, coalesce(bins, 0) bins, rest.q - coalesce(seen, 0) unseen, greatest(1 - coalesce(mass, 0), 0) p, 1 - rest.q q from n cross join rest
        left join (select r, lang, sum({_BIN}) bins, sum(q) seen, sum(p) mass from hist group by r, lang) h on h.r = n.r and h.lang = rest.lang) group by r),
    cfar as (select r, min(x) far from (select r, lang, sqrt(least(1, greatest(0, sum({_BIN}) / 2))) x from (select r, lang, n / all_ p, q from cls join cref using (k) where all_ > 0) group by r, lang) group by r),
    base as (select doc_id, r, coalesce(n.n, 0) n_words, coalesce(n.chars, 0)::bigint word_chars, mark n_symbols, coalesce(dup.n, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words
        from d join kinds using (r) left join n using (r) left join dup using (r) left join rep using (r))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
        not base_failed and coalesce(far.far, 0) <= 0.27 + 1.3 / sqrt(greatest(n_words, 1)) and (coalesce(cfar.far, 0) <= 0.3 or word_chars < 200) kept
    from base left join far using (r) left join cfar using (r)"""

#: SQL for the queries that DuckDB can express.
ORACLES: dict[str, str] = {
    "op5_warc": """
        with p as (select page_id, url, coalesce(html, '') h, strlen(coalesce(html, '')) b from pages),
        f as (select h, min(page_id) m from p where b >= 100 group by h)
        select p.page_id, p.b payload_bytes, sha256(p.h) payload_digest,
               case when f.m <> p.page_id then 'revisit' else 'response' end record_type,
               case when f.m <> p.page_id then f.m end refers_to, p.url
        from p left join f using (h)""",
    "op11_centroid_clusters": _clusters_sql(),
    "op12_quality_rules": _RULES,
}
