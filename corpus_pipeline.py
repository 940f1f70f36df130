"""The corpus pipeline over `documents`: each stage's result is written as Parquet and is the next one's input.

1. quality: documents that the additive quality model rejects go (score below its threshold).
2. near_duplicates: the first document of each near-duplicate class stays.
3. substrings: sentences in repeated passages go from all documents but the first; n_chars follows the text.
4. decontaminate: documents that hold a benchmark item go.
5. tokenize: the remaining texts as BPE ids, decoded again.

Stages 1 to 4 return the columns of documents. ORACLE_SQL is None: SQL can't express the learnt model, the alignment
or the tokenizer, so tests compare run() with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_stream, chosen_path, gam_quality, qgram_decontam, sentence_spans
from tidemark.llm._common import table, through_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return gam_quality.accept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = sentence_spans.remove_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return qgram_decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = bpe_stream.tokenize(docs)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontaminate", decontaminate), ("tokenize", tokenize)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
