"""A training-data pipeline over `documents`, in five stages; each is written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import bpe, decontaminate, language, simhash, suffix_dedup
from redactlake.llm.common import saved, table


def _in_batches(docs: DataFrame) -> None:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the network has learned go: null texts, texts without a letter, and those of which it isn't sure."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    _in_batches(docs)
    return language.keep_languages(docs, *language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; of a group without ids, the one with the least key."""
    _in_batches(docs)
    return simhash.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that occur elsewhere (about 35 words: passages of 50 words are longer) are cut out, n_chars follows, and documents with nothing left go. Null ids and repeated rows are rows like others."""
    _in_batches(docs)
    cut = suffix_dedup.remove_repeats(docs, 200)
    return cut.where(F.length("text") > 0).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a good part of one, go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    _in_batches(docs)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None  # networks, fingerprints and token ids are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
