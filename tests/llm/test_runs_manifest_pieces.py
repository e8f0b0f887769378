"""Periodic runs, the Merkle manifest and sentence pieces against brute force, a library, and edge cases."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import manifest, pieces, queries, runs

TEXTS = [
    (None, "null id " * 4), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a a a a a"), (6, "a a a a a a"), (7, "a b a b a b a b"), (7, "a b a b a b a b"), (8, "x a b c a b c a b c a b c a y a y a y a y"),
    (9, "w " * 3000), (10, " ".join(f"w{i}" for i in range(2000)) + " end" * 9), (11, "é ü " * 9 + "\x0b日本 日本\x0c" * 5), (12, "  lead and trail  "), (13, "\x00 nul ​ zero 😀 " * 3), (14, "▁ marks▁inside ▁▁"),
]
NAMES = "doc_id long, text string, lang string, ids string, runs int, at int, tree string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, "x", 1, 2, None) for i, t in rows], NAMES)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- periodic runs


def found_runs(texts):
    codes = np.array([x for t in texts for x in t], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    out = [[] for _ in texts]
    for text, start, stop, period in zip(*(a.tolist() for a in runs.find(codes, bounds)), strict=True):
        out[text].append((start - int(bounds[text]), stop - start, period))
    return out


def test_the_cover_meets_every_difference():
    apart = {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER}
    assert apart == set(range(runs.MODULUS))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=4), st.integers(1, 40), st.integers(1, 300))
def test_runs_of_small_alphabets(texts, period, size):
    texts = [*texts, [i % period for i in range(size)]]
    assert found_runs(texts) == [brute.periodic_runs(t) for t in texts]


def test_runs_of_nested_and_long_periods(monkeypatch):
    chance = random.Random(7)
    texts = []
    for _ in range(60):
        inner = [chance.randrange(3) for _ in range(chance.randint(1, 9))] * chance.randint(1, 8)
        texts.append([chance.randrange(5) for _ in range(20)] + (inner + [9]) * chance.randint(1, 9) + [chance.randrange(5) for _ in range(20)])
    expected = [brute.periodic_runs(t) for t in texts]
    assert any(expected) and found_runs(texts) == expected
    monkeypatch.setattr(runs, "PAIRS", 17)  # the pairs asked in many parts, suffixes sorted again
    assert found_runs(texts) == expected


def test_a_million_words_take_seconds():
    """One word, two words at random, and a long period."""
    chance = np.random.default_rng(1)
    for codes, many in ((np.zeros(300_000), 1), (chance.integers(0, 2, 300_000), None), (np.tile(chance.integers(0, 9999, 500), 600), 1)):
        text, *_ = runs.find(codes.astype(np.int64), np.array([0, 300_000]))
        assert many is None or len(text) == many


def test_periodic_runs(spark):
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(frame(spark, TEXTS)).collect()))
    expected = [(i or 0, len(words(t)), brute.periodic_runs(words(t)), brute.collapsed(words(t), brute.periodic_runs(words(t)))) for i, t in TEXTS]
    assert got == sorted(expected)
    assert runs.periodic_runs(frame(spark, [])).count() == 0


def test_planted_words(spark):
    import zlib

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b"), (5000, None)]
    got = {r.doc_id: r.t for r in frame(spark, rows).select("doc_id", runs.planted(queries.F.col("text"), queries.F.col("doc_id")).alias("t")).collect()}
    changed = 0
    for i, t in rows:
        w, h = words(t), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += 1
            assert got[i] == " ".join(w)
        else:
            assert got[i] == t
    assert changed > 10


# ---- Merkle manifest


def proofs(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.doc_id, r.lang), []).append((r.leaf, r.subroot, r.root, [(p.left.hex(), p.right.hex()) for p in r.path]))
    return out


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_manifest(spark, arity):
    rows = TEXTS + [(i, f"text {i}") for i in range(100, 100 + 3 * arity * arity + 1)]
    df = frame(spark, rows).repartition(3)
    columns = ["doc_id", "text", "lang", "at"]
    expected = brute.merkle([(r.doc_id, r.lang, [r[c] for c in columns]) for r in df.collect()], arity)
    found = manifest.merkle_manifest(df, columns, arity=arity)
    got = proofs(found)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    back = found.select("root", manifest.folded(queries.F.col("leaf"), queries.F.col("path")).alias("f"), manifest.folded(queries.F.sha2("leaf", 256), queries.F.col("path")).alias("g")).collect()
    assert all(r.f == r.root and r.g != r.root for r in back)


def test_manifest_of_few_rows(spark):
    df = frame(spark, [(1, "only")])
    (row,) = manifest.merkle_manifest(df, ["text"]).collect()
    assert row.leaf == row.subroot == row.root and row.path == []
    assert manifest.merkle_manifest(frame(spark, []), ["text"]).count() == 0
    with pytest.raises(ValueError):
        manifest.merkle_manifest(df, ["text"], arity=1)


def test_manifest_of_many_groups(spark):
    """Every row a group of its own: the subroots are the leaves."""
    rows = [(i, f"t{i}", f"g{i % 70:02}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    expected = brute.merkle([(i, g, [i, t]) for i, t, g in rows], 4)
    assert proofs(manifest.merkle_manifest(df, ["doc_id", "text"], arity=4)) == expected


# ---- sentence pieces


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


PARTS = [" ", "  ", "▁", "a", "the", "ing", "é", "日", "本", "\n", "\t", "1", "20", "<s>", "</s>", "<0x41>", "😀", "\x00", "ﬁ", "zz", "qx", "er", " t", "​", "ß"]


def test_segments_are_encoded_as_the_library_does(model, library):
    with open(model, "rb") as file:
        read = pieces.Model(file.read())
    chance = random.Random(3)
    texts = ["".join(chance.choices(PARTS, k=chance.randint(1, 40))) for _ in range(4000)] + [" " * k + "x" * (k % 3) + " " * (k // 2) for k in range(1, 120)]
    for t in texts:
        assert read.segment("▁" + t.replace(" ", "▁")) == library.encode(t), t


def test_sentence_pieces(spark, model, library):
    chance = random.Random(4)
    rows = TEXTS + [(1000 + i, "".join(chance.choices(PARTS, k=chance.randint(0, 60)))) for i in range(400)] + [(2000, "ab" * 30_000), (2001, " " * 5000 + "end"), (2002, "long words " * 40_000)]
    found = pieces.decode(pieces.encode(frame(spark, rows), model), model).collect()
    expected = [(i or 0, [*library.encode(t or ""), library.eos_id()]) for i, t in rows]
    assert sorted((r.doc_id or 0, r.ids) for r in found) == sorted(expected)
    assert sorted((r.doc_id or 0, r.decoded) for r in found) == sorted((i, library.decode(ids)) for i, ids in expected)
    assert pieces.encode(frame(spark, []), model).count() == 0


def test_any_ids_are_decoded_as_the_library_does(spark, model, library):
    chance = random.Random(5)
    some = lambda: chance.choice([chance.randrange(32000), chance.randrange(260), 28705, 0, 1, 2])
    lists = [[some() for _ in range(chance.randint(1, 12))] for _ in range(3000)]
    df = spark.createDataFrame([*enumerate(lists), (-1, None), (-2, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in pieces.decode(df, model).collect()}
    assert got == {-1: "", -2: ""} | {i: library.decode(x) for i, x in enumerate(lists)}
    with pytest.raises(Exception, match="does not have"):
        pieces.decode(spark.createDataFrame([(1, [32000])], "doc_id long, ids array<int>"), model).collect()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(b"")


def test_planted_query_of_pieces(spark, sf, model, library):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {tuple(r) for r in queries.op13_sentence_pieces(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for r in docs:
        ids = [*library.encode(r.text or ""), library.eos_id()]
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == want
