"""The queries opN_<name> of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_stream, chosen_path, ef_trie, gam_quality, html_hostsa, media_jpeg, noisy_toxicity, qgram_decontam, sentence_spans, warc_revisit
from ._common import table


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a progressive JPEG, read back, with digests of what was read."""
    return media_jpeg.media_digest(media_jpeg.read_media(media_jpeg.store_media(table(spark, sf_dir, "documents"))))


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the streaming transducer and decoded again, as digests."""
    return bpe_stream.token_digest(bpe_stream.tokenize(table(spark, sf_dir, "documents")))


def op8_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for quality by the additive model."""
    return gam_quality.quality_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_hostsa.extract(table(spark, sf_dir, "pages"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified revisit among captures of all pages, resolved to its earlier response."""
    return warc_revisit.revisit_rows(table(spark, sf_dir, "pages"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that loses sentences to repeated passages, with the removed spans and the text that is left."""
    return sentence_spans.changed_documents(table(spark, sf_dir, "documents"))


def op6_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a benchmark item in a document, within the edit budget."""
    return qgram_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for toxicity after deobfuscation."""
    return noisy_toxicity.toxicity_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count and its near-duplicate class."""
    return chosen_path.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op10_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the n-gram trie of the documents outside of the held-out fold."""
    return ef_trie.score_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_progressive_jpeg,
        op2_bpe_transducer,
        op3_host_suffix_array,
        op4_warc_revisits,
        op5_sentence_spans,
        op6_qgram_decontamination,
        op7_noisy_channel_toxicity,
        op8_additive_quality,
        op9_chosen_path,
        op10_elias_fano_lm,
    )
}

ORACLE: dict[str, str] = {"op4_warc_revisits": warc_revisit.ORACLE, "op9_chosen_path": chosen_path.ORACLE}
