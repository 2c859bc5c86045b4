"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

quality: documents that the classifier of ``labels.quality`` rejects go. lines: multi-line chunks that occur elsewhere are cut out
of the texts; a document of which nothing is left goes. near duplicates: one document of each class of similar texts stays.
benchmark: documents that hold a passage of ``benchmark`` go. packing: what is left is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import staged
from karst.llm.decontamination import without_contaminated
from karst.llm.line_dedup import line_dedup
from karst.llm.ngram_join import one_of_each
from karst.llm.packing import pack_documents
from karst.llm.quality import fit_quality, quality_scores


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be of label 1; empty and null texts are judged as empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality_scores(docs, fit_quality(docs, labels)).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that stand elsewhere; n_chars follows. What came empty stays; what becomes empty goes."""
    cut = F.size("removed") > 0
    found = line_dedup(docs).where(~(cut & (F.trim(F.col("text")) == "")))
    return found.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts, that with the smallest doc_id; texts without words and null texts all stay."""
    return one_of_each(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none. Repeated rows are judged alike."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens; null and empty texts give their separator, repeated rows are packed once each."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]

#: The classifier cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) else staged(docs)
    return docs
