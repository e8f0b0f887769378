"""Texts made so that a weak hash takes unlike words, lines and sets for equal ones, and families of like texts."""

from __future__ import annotations

import random

import brute
import pytest

from barloom.llm import common, decontamination, minhash, repetition, substring_dedup

SCHEMA = "doc_id long, text string"


def frame(spark, texts, parts=3):
    return spark.createDataFrame(texts, SCHEMA).repartition(parts)


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def thue_morse(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


ONE = [thue_morse(1024, a, b) for a, b in ("ab", "ba")]
TWO = [thue_morse(2048, a, b) for a, b in ("ab", "ba")]


@pytest.fixture
def weak(monkeypatch):
    """Hashes of three bits at the first seed: nearly everything collides, and only comparing the bytes tells words apart."""
    plain = common.Spans.hashes
    monkeypatch.setattr(common.Spans, "hashes", lambda self, seed=0: plain(self, seed) & common.np.uint64(7) if seed == 0 else plain(self, seed))


def texts_of(pair):
    rng = random.Random(1)
    out = []
    for i in range(6):
        own = [f"w{rng.randrange(10**6)}" for _ in range(25)]
        out.append((i, " ".join([*own[:12], pair[i % 2], *own[12:]])))
    # the same words but for the colliding pair, in lines and in windows
    out += [(10 + k, "\n".join([f"{w} stands in this line" for w in (w1, w2, w1)] + ["a b c d e f g h"])) for k, (w1, w2) in enumerate((pair, pair[::-1]))]
    out += [(20 + k, " ".join([w] * 1 + [f"c{j}" for j in range(8)] + [w2] + [f"d{j}" for j in range(12)])) for k, (w, w2) in enumerate((pair, pair[::-1]))]
    return out + [(30, " ".join([pair[0]] * 30)), (31, " ".join([pair[1]] * 30)), (32, pair[0]), (33, pair[1]), (34, pair[0] + " " + pair[1])]


@pytest.mark.parametrize("pair", [ONE, TWO])
def test_colliding_words(spark, pair):
    check(spark, texts_of(pair), pair)


def test_words_whose_hashes_all_collide(spark, weak):
    check_local(texts_of(ONE))


def check(spark, texts, pair):
    df = frame(spark, texts)
    assert by_id(substring_dedup.deduplicate_substrings(df, digest=True)) == brute.substring_dedup(texts)
    assert by_id(minhash.near_duplicates(df, shingle=4)) == brute.near_duplicates(texts, 4)
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in repetition.quality_rules(df).collect()}
    assert found == {i: brute.repetition(t) for i, t in texts}
    items = [(1, texts[0][1]), (2, pair[0] + " c0 c1 c2 c3 c4 c5 c6 c7 " + pair[1] + " d0"), (3, pair[1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(df, bench).collect()
    assert {r.doc_id: (r.n_words, len(r.hit_words), len(r["items"]), brute.sha(",".join(sorted(r["items"]))), bool(r.hit_words)) for r in found} == brute.contamination(texts, items)


def check_local(texts):
    """The steps that decide, without Spark, so that the weak hash holds in them."""
    import pyarrow as pa

    column = pa.array([t for _, t in texts])
    number, bounds = minhash.exact_sets(column, 4)
    sets = [frozenset(number[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    truth = [brute.shingles(t, 4) for _, t in texts]
    for x, s in zip(truth, sets):
        for y, t in zip(truth, sets):
            assert (len(x), len(x & y)) == (len(s), len(s & t))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in texts], type=pa.int64()), "text": column})
    for r in pa.Table.from_batches(repetition._measures(iter([batch]), (5,))).to_pylist():
        t = dict(texts)[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.repetition(t)[:5]
    items = [(str(i), t) for i, t in texts if i in (0, 20, 33)]
    tests = decontamination.TestSet([i for i, _ in items], pa.array([t for _, t in items]))
    words, vocabulary = decontamination._words(column), tests.vocabulary
    position, window, _ = decontamination._hits(words, tests, vocabulary, vocabulary.hashes(tests.seed))
    expected = brute.contamination(texts, items)
    for d, (i, _) in enumerate(texts):
        some = words.doc[position] == d
        hit = {p + k for p, w in zip(position[some].tolist(), tests.size[window[some]].tolist()) for k in range(w)}
        assert len(hit) == expected[i][1]


def family(n, words, changed, seed):
    """n texts that share a template; each has `changed` words of its own."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for p in range(changed):
            w[(p * words) // changed] = f"o{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_family_below_the_threshold_gives_no_rows(spark, monkeypatch):
    """All pairs of the family have a similarity near 0.75: they are compared inside tasks, and none is given out."""
    texts = list(enumerate(family(300, 120, 2, 3) + family(60, 200, 6, 4)))
    monkeypatch.setattr(minhash, "BLOCK", 64 * minhash.LEAST)
    given = []
    plain = minhash.across
    monkeypatch.setattr(minhash, "across", lambda *a: given.append(plain(*a)) or given[-1])
    seen = []
    monkeypatch.setattr(minhash, "discard", lambda t: seen.append(t))
    assert by_id(minhash.near_duplicates(frame(spark, texts), shingle=5)) == brute.near_duplicates(texts, 5)
    assert given[0].count() < len(texts)


def test_families_of_many_blocks(spark, monkeypatch):
    """Buckets of many groups, some of more than a block, in one bucket; hot keys are told from others."""
    rng = random.Random(9)
    texts = family(150, 60, 1, 5)
    words = texts[0].split()
    for _ in range(150):
        w = list(words)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[3]] * 40
    texts = list(enumerate(texts))
    monkeypatch.setattr(minhash, "BLOCK", 16 * minhash.LEAST)
    monkeypatch.setattr(minhash, "STAR", 16)
    for hot in (3, 2000):
        monkeypatch.setattr(minhash, "HOT", hot)
        assert by_id(minhash.near_duplicates(frame(spark, texts), shingle=4)) == brute.near_duplicates(texts, 4)


def test_one_document_many_times(spark):
    texts = [(i, "one notice that stands in very many places of the corpus") for i in range(20_000)] + [(50_000, "something else entirely that is only here")]
    found = by_id(minhash.near_duplicates(frame(spark, texts)))
    assert len(found) == len(texts) and all(x[1] == 0 for i, x in found.items() if i < 50_000) and found[50_000][1:] == (50_000, True)
    assert sum(x[2] for x in found.values()) == 2


def test_one_passage_in_all_documents_and_items(spark):
    """The count of rows and pairs stays that of the documents."""
    passage = " ".join(f"p{i}" for i in range(12))
    texts = [(i, f"own{i} {passage} tail{i} " + " ".join(f"x{i}-{j}" for j in range(12))) for i in range(600)]
    items = [(i, f"item{i} {passage} and{i}") for i in range(500)]
    tests = decontamination.TestSet([str(i) for i, _ in items], common.pa.array([t for _, t in items]))
    words = decontamination._words(common.pa.array([t for _, t in texts]))
    assert len(decontamination._hits(words, tests, tests.vocabulary, tests.vocabulary.hashes(tests.seed))[0]) == 3 * len(texts)
    found = decontamination.find_contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(len(r["items"]) == 500 and len(r.hit_words) == 12 and r.longest_match == 12 and r.longest_at == 1 for r in found)
    removed = by_id(substring_dedup.deduplicate_substrings(frame(spark, texts), window=10, digest=True))
    assert removed == brute.substring_dedup(texts, 10)
