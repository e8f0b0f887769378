"""The labelled rows from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents fit a model; the choice is by a hash of the id.
SAMPLE = 8192
FOLDS = 5


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE, folds: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """doc_id, text and label of at most `limit` labelled documents of the folds, which leave fold 0 out.

    Labels that are null or whose id is null are left out; of repeated ids one
    row counts, that with the smallest label or text.  The chosen ids are
    bounded by `limit`, so they are broadcast and the documents are scanned
    without a shuffle.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & fold("doc_id").isin(*(f for f in folds if f)))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
