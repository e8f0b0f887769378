"""A corpus pipeline of five stages, each a thin call of one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
it as Parquet to the shared folder and reads it again as the next one's docs.
All but the last return the columns of docs.  SQL cannot express the learned
and tokenising stages, so there is no ORACLE_SQL; the tests compare run() with
a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, decontamination, minhash, pii, queries, ranking
from barloom.llm.shared import keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = ranking.fit_quality(docs, queries.table(spark, sf_dir, "labels"))
    return ranking.keep_quality(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id.  Shingles have five words; similarity is 0.8 or more."""
    queries.bounded_batches(spark)
    gone = minhash.near_duplicates(docs, shingle=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted again."""
    queries.bounded_batches(spark)
    return pii.redact_pii(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers), and the digest of the bytes they decode to."""
    queries.bounded_batches(spark)
    vocabulary, pattern = queries.tokenizer()
    coded = byte_bpe.decode(byte_bpe.encode(docs, vocabulary, pattern), vocabulary)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in order."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
