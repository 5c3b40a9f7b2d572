"""The corpus pipeline: stages over documents, each applying one training-data operator to all that the one before kept.

1. language ID: documents whose language is not identified with a margin go;
2. n-gram Jaccard join: one document of each class of near duplicates stays, that of the smallest doc_id;
3. suffix-array dedup: bytes under a repeated 100-byte string go, all but the first time; the document stays;
4. benchmark decontamination: documents that hold a window of a benchmark item go;
5. SentencePiece encoding and decoding: ids are made, decoded again and digested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontam, langid, ngram_join, queries, sp_fst, suffix_dedup
from palimpsest.session import drop_stored, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_fst.round_trip(docs, queries.tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding and decoding", sentencepiece),
]
#: Compression, suffix sorting and tokenization are not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:  # nothing reads the table before any more
            drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)
