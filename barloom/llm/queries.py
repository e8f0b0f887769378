"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, licences, manifest, minhash, oracle, pieces, pii, ranking, repetition, runs, secret_scan, substring_dedup, toxicity


#: Bytes of an Arrow batch: texts are long, and a batch is held by the JVM and by the task's Python at once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """The session sends at most BATCH_BYTES, or one row, in an Arrow batch.

    This is configuration of the application that runs these queries.  The
    operators set nothing: without it they get Spark's own bound (64 MB).
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read with bounded_batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate_substrings(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def op5_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.scan_pii(table(spark, sf_dir, "documents")), pii.BASE_KINDS)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")), secret_scan.BASE_KINDS)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", ranking.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ranking.score_quality(docs, ranking.fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", ranking.held_out().alias("held_out"), "score", (F.col("score") >= ranking.CUT).cast("int").alias("predicted"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def tokenizer() -> tuple[str, str]:
    """Path of the vocabulary and the pattern of pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = tokenizer()
    tokens = byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary, pattern)
    return byte_bpe.decode(tokens, vocabulary).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repetition.quality_rules(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return runs.run_digest(runs.periodic_runs(docs.select("doc_id", runs.planted(F.col("text"), F.col("doc_id")).alias("text"))))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest.manifest_digest(manifest.merkle_manifest(docs, manifest.COVERED, others={"tampered": manifest.tampered_leaf(docs)}))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    tokens = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_licence_scan, op3_decontamination, op4_toxicity, op5_pii_scan, op6_secret_scan, op7_quality, op8_near_duplicates, op9_byte_bpe, op10_repetition_rules,
        op11_periodic_runs, op12_merkle_manifest, op13_sentence_pieces,
    )
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op2_licence_scan": licences.oracle_sql(),
    "op3_decontamination": oracle.CONTAMINATION,
    "op8_near_duplicates": oracle.NEAR_DUPLICATES,
    "op10_repetition_rules": oracle.REPETITION,
    "op11_periodic_runs": oracle.PERIODIC_RUNS,
    "op12_merkle_manifest": oracle.MERKLE,
}
