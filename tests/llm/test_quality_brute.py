"""The quality operator against measures counted in plain Python and a loss minimised another way."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

from barloom.llm import queries, ranking

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ["", " \n ", "one", "ONE!! two, two. 3#", "a b c a b c a b c\nsame line\nsame line\n|x|", "日本 é ü. Éa " * 3, "x" * 400, "the the the the the the"]


def measures(text: str | None) -> list[float]:
    """One row of FEATURES of a text."""
    text = text or ""
    words, raw = WORD.findall(text), text.encode()
    n, chars = max(len(words), 1), max(len(text), 1)
    letters = max(sum(c.isascii() and c.isalpha() for c in text), 1)
    count = lambda chosen: sum(c in chosen for c in text)
    lines = [x for x in text.split("\n") if x]
    often = Counter(lines)

    def same_grams(k: int) -> float:
        grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        seen = Counter(grams)
        return len({i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(k)}) / n

    shares = [
        count("#*$%&<>{}[]~^\\") / chars, count("|") / n, sum("A" <= c <= "Z" for c in text) / letters, count("!?") / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(often[x] > 1 for x in lines) / max(len(lines), 1), same_grams(3), same_grams(5), count("0123456789") / chars,
    ]
    rest = [len(set(words)) / n**0.85, sum(map(len, words)) / n / 10, count(".") / n, count(",") / n, count("\n") / n, sum("A" <= w[0] <= "Z" for w in words) / n, (len(raw) - chars) / chars, math.log1p(len(words)) / 10]
    return [min(x, 3.0) for x in [*shares, *map(math.sqrt, shares), *rest]]


def test_scores_of_the_smallest_table(spark, sf):
    """Scores of all rows by the learned weights over measures counted one by one; the labels of held-out rows change nothing."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()} | {-1 - i: t for i, t in enumerate(EDGES)} | {-100: None}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = ranking.fit_quality(frame, labels)
    got = {r.doc_id: r.score for r in ranking.score_quality(frame, model).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        z = model.slope * (float(np.dot(measures(text), model.weights)) - model.cut) + math.log(ranking.CUT / (1 - ranking.CUT))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))) < 1e-6, i
    turned = labels.withColumn("quality", queries.F.when(ranking.held_out(), 1 - queries.F.col("quality")).otherwise(queries.F.col("quality")))
    again = ranking.fit_quality(frame, turned)
    assert np.array_equal(again.weights, model.weights) and again.cut == model.cut
    # the cut is the best one for the labelled rows of its fold, none of which drew a pair
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 5 == ranking.CUT_FOLD}
    strength = {i: float(np.dot(measures(docs[i]), model.weights)) for i in known}
    right = lambda cut: sum((strength[i] >= cut) == (known[i] == 1) for i in known)
    assert right(model.cut) == max(right(c + d) for c in strength.values() for d in (-1e-9, 1e-9))


def test_weights_minimise_the_pairwise_loss():
    """At the learned weights no step in any direction lowers the loss over the pairs that were drawn."""
    rng = np.random.default_rng(3)
    x, y = rng.random((120, 6)), (rng.random(120) < 0.3).astype(int)
    x[y == 1, 0] += 0.5
    scale, good, bad = np.maximum(x.std(axis=0), 1e-6), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = ranking.pair_weights(x, y) * scale
    draw = np.random.default_rng(7)
    pairs = min(len(good), len(bad)) * ranking.PAIRS_EACH
    d = (x[draw.choice(good, pairs)] - x[draw.choice(bad, pairs)]) / scale

    def loss(v):
        return sum(math.log1p(math.exp(-float(z))) for z in d @ v) + 0.5 * float(v @ v)

    least = loss(w)
    for k in range(6):
        for step in (-1e-3, 1e-3):
            v = w.copy()
            v[k] += step
            assert loss(v) >= least
    assert w[0] > 0.5
