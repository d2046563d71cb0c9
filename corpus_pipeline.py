"""From raw documents to packed training sequences, each stage one operator of ``spanlake.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet
and read again. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import decontaminate, jaccard, langid, suffixes
from spanlake.llm.common import stored, table
from spanlake.llm.queries import packed

#: Words of the shortest passage that may not repeat, and of its substrings that copies are found by.
PASSAGE_WORDS, PASSAGE_GRAM = 51, 18


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told: texts of which a learned n-gram supports some language.

    Learns as the query of the operator does; where no language can be learned, all texts with a letter stay.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    if not model.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.identify(docs, model, pred="lang_pred", score="score").where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") > 0)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the smallest doc_id."""
    return jaccard.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of over 50 words that the corpus repeats; n_chars follows the text."""
    kept = suffixes.remove_repeats(docs, span=PASSAGE_WORDS, gram=PASSAGE_GRAM, words=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    return packed(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Language ID, tokens and edit distances have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir) if n == len(STAGES) - 1 else stored(stage(spark, docs, sf_dir), f"stage-{n + 1}")
    return docs
