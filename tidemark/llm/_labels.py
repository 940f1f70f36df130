"""Labelled documents, all or a bounded sample, for the operators that learn from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: At most so many labelled rows are used for fitting, those of lowest hash of the document's id.
SAMPLE_ROWS = 20_000


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo `folds`; a null id is in no fold."""
    return F.crc32(F.col(column).cast("string")) % folds


def held_out(column: str, folds: int, remainder: int):
    """True for rows whose labels are never learnt from; false for a null id."""
    return F.coalesce(fold(column, folds) == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, remainder: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most `rows` labelled documents outside the held-out fold.

    Repeated label rows of a document count once (the largest label). The chosen ids are bounded, so they are
    broadcast and the documents are only filtered; of several texts under one id the least is used.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", folds, remainder))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, remainder: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of every labelled document outside the held-out fold.

    Repeated label rows and several texts under one id are settled as in the sample. Labels grow with the corpus, so
    they aren't broadcast: the texts of the other folds are shuffled.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", folds, remainder))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, remainder))
    return own.join(chosen.hint("merge"), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def within_bytes(sample: DataFrame, most: int) -> DataFrame:
    """The rows of a bounded sample, in order of their ids' hash, up to `most` bytes of text. Only sizes are gathered."""
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sample.select("doc_id", F.octet_length("text").cast("long").alias("_size")).withColumn("_all", F.sum("_size").over(order))
    return sample.join(F.broadcast(sizes.where(F.col("_all") <= most).select("doc_id")), "doc_id", "left_semi")
