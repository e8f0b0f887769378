"""Clashing columns, null and repeated ids, long texts, empty tables, and executors without this package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import brute
import numpy as np
import pytest

from barloom.llm import byte_bpe, decontamination, labelled, minhash, pii, queries, ranking, repetition, secret_scan, substring_dedup, toxicity
from barloom.llm.pii import span_digest

#: Columns named like results of the operators, with other types.
CLASHING = "doc_id long, body string, text int, items string, n_words string, hit_words int, longest_match string, longest_at date, contamination double, score string, quality_score string, decoded int, fold string, label string"
PASSAGE = " ".join(f"passage{i} of words" for i in range(12))
TEXTS = [(1, PASSAGE), (2, "nothing of it here"), (3, None), (4, ""), (None, "before " + PASSAGE), (1, "another row of one id"), (1, PASSAGE)]


def clashing(spark):
    return spark.createDataFrame([(i, t, n, f"i{n}", f"w{n}", n, f"m{n}", None, n / 2, f"s{n}", f"q{n}", n, "f", "l") for n, (i, t) in enumerate(TEXTS)], CLASHING)


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_clashing_columns_come_back_as_they_were(spark):
    docs = clashing(spark)
    bench = spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string")
    before = rows_of(docs, docs.columns)
    kept = decontamination.decontaminate(docs, bench, text_col="body")
    assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
    assert rows_of(kept, docs.columns) == [r for r in before if PASSAGE not in (r[1] or "")]
    # find_contamination puts its results in the places of columns named like them, and leaves the others alone
    found = decontamination.find_contamination(docs, bench, text_col="body", block_bytes=40)
    others = [c for c in docs.columns if c not in decontamination.RESULTS]
    assert rows_of(found, others) == rows_of(docs, others)
    assert sorted(len(r["items"]) for r in found.collect()) == [0, 0, 0, 0, 1, 1, 1]
    model = ranking.fit_pairs(np.zeros((0, len(ranking.FEATURES))), np.zeros(0))
    assert rows_of(ranking.keep_quality(docs, model, text_col="body"), docs.columns) == before
    with pytest.raises(ValueError):
        ranking.score_quality(docs, model, text_col="body")
    clean = pii.redact_pii(docs, text_col="body")
    assert clean.columns == docs.columns and rows_of(clean, docs.columns) == before


def test_other_operators_read_only_their_columns(spark):
    docs = clashing(spark)
    path, pattern = queries.tokenizer()
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    plain = docs.select("doc_id", docs["body"].alias("text"))
    for f in (
        lambda d, **c: substring_dedup.deduplicate_substrings(d, **c), lambda d, **c: pii.scan_pii(d, **c), lambda d, **c: secret_scan.scan_secrets(d, **c), lambda d, **c: minhash.near_duplicates(d, **c),
        lambda d, **c: repetition.quality_rules(d, **c), lambda d, **c: byte_bpe.decode(byte_bpe.encode(d, path, pattern, **c), path), lambda d, **c: toxicity.score_toxicity(d, toxicity.fit_toxicity(plain, labels), **c),
    ):
        got, want = f(docs, text_col="body"), f(plain)
        assert got.count() == len(TEXTS) and rows_of(got, got.columns) == rows_of(want, got.columns)


def test_repeated_ids_in_labels_do_not_shrink_the_sample(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 40) for _ in range(5)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 40)], "doc_id long, text string")
    assert labelled.training_sample(docs, labels, "quality", limit=12).count() == 12


def test_null_and_repeated_ids(spark):
    rows = [(None, "mail a@b.co now"), (7, "password = abcdefghijklm"), (7, "password = abcdefghijklm"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for found, base in ((pii.scan_pii(df), pii.BASE_KINDS), (secret_scan.scan_secrets(df), secret_scan.BASE_KINDS)):
        got = sorted((r.doc_id or -1, r.base_sha256) for r in span_digest(found, base).collect())
        make = brute.pii if base is pii.BASE_KINDS else brute.secrets
        assert got == sorted((i or -1, make(t)[-1]) for i, t in rows)
    kept = repetition.quality_rules(df).collect()
    assert sorted((r.doc_id or -1, r.n_words) for r in kept) == sorted((i or -1, len((t or "").split())) for i, t in rows)
    model = ranking.fit_pairs(np.zeros((0, len(ranking.FEATURES))), np.zeros(0))
    scored = ranking.score_quality(df, model).collect()
    assert sorted((r.doc_id or -1) for r in scored) == [-1, 7, 7, 7, 8] and all(0 <= r.score <= 1 for r in scored)


def test_texts_longer_than_a_piece(spark):
    """One text of 6 MB, more than any piece, and its copy with another beginning."""
    text = " ".join(f"w{i * 7919 % 999983}" for i in range(800_000)) + " mail x@y.org"
    docs = [(1, text), (2, "other words before it " + text), (3, "short text of a few words only here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(text) > substring_dedup.PIECE and len(text) > decontamination.PIECE
    removed = {r.doc_id: tuple(r)[1:] for r in substring_dedup.deduplicate_substrings(df, digest=True).collect()}
    assert removed == brute.substring_dedup(docs)
    near = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(df).collect()}
    assert near == brute.near_duplicates(docs, 5)
    bench = [(9, " ".join(text.split()[400_000:400_020]))]
    found = decontamination.find_contamination(df, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.doc_id, len(r.hit_words), r.longest_match) for r in found) == [(1, 20, 20), (2, 20, 20), (3, 0, 0)]
    assert {r.doc_id: [s.kind for s in r.spans] for r in pii.scan_pii(df).collect()} == {1: ["email"], 2: ["email"], 3: []}
    assert {r.doc_id: r.n_words for r in repetition.repetition_measures(df).collect()} == {i: len(t.split()) for i, t in docs}
    path, pattern = queries.tokenizer()
    back = byte_bpe.decode(byte_bpe.encode(df, path, pattern), path).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == dict(docs)


def test_encoding_does_not_hang_on_the_order_of_rows(spark):
    """A plan that deals its rows anew each time it runs gives the ids of the texts all the same."""
    import tiktoken
    from pyspark.sql import functions as F

    path, pattern = queries.tokenizer()
    reference = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    docs = [(i, f"text {i} with words{i % 7} and more {'x' * (i % 50)}") for i in range(400)]
    shuffled = spark.createDataFrame(docs, "doc_id long, text string").repartition(5, F.rand())
    found = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in byte_bpe.encode(shuffled, path, pattern).collect()}
    assert found == {i: reference.encode_ordinary(t) for i, t in docs}


def test_pipeline_of_empty_tables(spark, sf, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from barloom.llm import queries
for name in sorted(queries.QUERIES):
    assert queries.QUERIES[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_executors_need_not_have_this_package(sf, tmp_path):
    """Workers begin in another folder and without the driver's path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in out.stdout, out.stderr[-3000:]
