"""Quality classifier by Bradley-Terry pairwise ranking.

Every document becomes a short vector of measures of its whole text.  From a
bounded sample of labelled documents, preference pairs (a good one over a bad
one) are drawn, and weights are learned by logistic loss on the differences of
their vectors.  A document's strength is the weighted sum; the cut is a
quantile of the strengths of labelled documents that drew no pairs (fold 1),
that which tells their labels apart best, and scores are scaled so that it is
0.3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LINE, NON_BLANK, Spans, byte_table, covered, flat, gram_hashes, gram_starts, mix, per_doc, pieces, repeated
from .labelled import SAMPLE, fold, training_sample

CUT = 0.3
#: Pairs drawn for each document of the rarer class, and in total at most; both are parameters of the fit.
PAIRS_EACH, PAIRS = 24, 100_000
#: Fold whose labelled documents choose the cut instead of drawing pairs.
CUT_FOLD = 1
PIECE = 2 << 20

SHARES = ["symbols", "bars", "capitals", "shouts", "stutter", "same_lines", "same_grams3", "same_grams5", "digits"]
FEATURES = [*SHARES, *(f"root_{x}" for x in SHARES), "distinct", "word_size", "stops", "commas", "lines", "first_capital", "beyond_ascii", "words"]


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    data, offsets = flat(column)
    words = Spans(data, offsets, NON_BLANK)
    n = np.maximum(words.counts, 1)
    head = (data & 0xC0) != 0x80
    chars = np.maximum(per_doc(head, offsets), 1)
    count = lambda chosen: per_doc(byte_table(chosen)[data], offsets)
    letters = np.maximum(count(bytes([*range(65, 91), *range(97, 123)])), 1)
    hashes, doc = words.hashes(), words.doc
    salt = mix(np.arange(1, len(offsets), dtype=np.uint64))
    next_same = np.zeros(len(words), dtype=bool)
    next_same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    lines = Spans(data, offsets, LINE)
    same_line = repeated(mix(lines.hashes() ^ salt[lines.doc]))
    own = mix(hashes ^ salt[doc])
    order = np.argsort(own, kind="stable")
    fresh = np.ones(len(own), dtype=bool)
    fresh[order[1:]] = own[order[1:]] != own[order[:-1]]

    def same_grams(k: int) -> np.ndarray:
        starts = gram_starts(words.bounds, k)
        if not len(starts):
            return np.zeros(len(n))
        twice = repeated(mix(gram_hashes(hashes, k)[starts] ^ salt[doc[starts]]))
        return per_doc(covered(starts[twice], k, len(words)), words.bounds) / n

    first = data[words.start] if len(words) else np.zeros(0, dtype=np.uint8)
    shares = [
        count(b"#*$%&<>{}[]~^\\") / chars,
        count(b"|") / n,
        count(bytes(range(65, 91))) / letters,
        count(b"!?") / n,
        per_doc(next_same, words.bounds) / n,
        per_doc(same_line, lines.bounds) / np.maximum(lines.counts, 1),
        same_grams(3),
        same_grams(5),
        count(b"0123456789") / chars,
    ]
    rest = [
        per_doc(fresh, words.bounds) / n**0.85,
        per_doc(words.inside & head, offsets) / n / 10,
        count(b".") / n,
        count(b",") / n,
        count(b"\n") / n,
        per_doc((first >= 65) & (first <= 90), words.bounds) / n,
        (np.diff(offsets) - chars) / chars,
        np.log1p(words.counts) / 10,
    ]
    return np.minimum(np.stack([*shares, *(np.sqrt(x) for x in shares), *rest], axis=1), 3.0)


@dataclass
class Ranking:
    weights: np.ndarray
    cut: float
    slope: float
    #: The share of the strengths below the cut.
    quantile: float = float("nan")

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (x @ self.weights - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def pair_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, seed: int = 7, pairs_each: int = PAIRS_EACH, most_pairs: int = PAIRS) -> np.ndarray:
    """Bradley-Terry weights by Newton steps on the logistic loss of feature differences; 0 without both classes."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    pairs = min(most_pairs, min(len(good), len(bad)) * pairs_each)
    difference = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    scale = np.maximum(x.std(axis=0), 1e-6)
    difference = difference / scale
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -40, 40)))
        gradient = difference.T @ (1 - p) - ridge * w
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def fit_pairs(x: np.ndarray, y: np.ndarray, chooses: np.ndarray | None = None, **options) -> Ranking:
    """The ranking of rows x with labels y; rows of `chooses` choose the cut, the others draw the pairs.

    Without both classes there are no pairs: all weights are 0 and every score
    is on the side of the only class.  Where one of the two parts lacks a
    class, all rows serve for both.
    """
    if not len(y) or y.min() == y.max():
        return Ranking(np.zeros(x.shape[1]), -1.0 if not len(y) or y[0] == 1 else 1.0, 1.0)
    chooses = np.zeros(len(y), dtype=bool) if chooses is None else chooses
    if any(len(set(y[part].tolist())) < 2 for part in (chooses, ~chooses)):
        w, own, label = pair_weights(x, y, **options), x, y
    else:
        w, own, label = pair_weights(x[~chooses], y[~chooses], **options), x[chooses], y[chooses]
    strength = own @ w
    # the quantile, midway between two strengths, that tells the labels apart best
    order = np.argsort(strength, kind="stable")
    ranked, s = label[order], strength[order]
    right = np.concatenate(([0], np.cumsum(ranked == 0))) + (ranked == 1).sum() - np.concatenate(([0], np.cumsum(ranked == 1)))
    edges = np.concatenate(([s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]))
    free = np.concatenate(([True], s[1:] > s[:-1], [True]))
    best = np.flatnonzero(free & (right == right[free].max()))
    best = int(best[len(best) // 2])
    cut = float(edges[best])
    # the slope of a logistic curve through the cut
    spread, slope = strength - cut, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * spread + np.log(CUT / (1 - CUT)), -40, 40)))
        g, h = float(((label - p) * spread).sum()), float((p * (1 - p) * spread**2).sum()) + 1e-6
        slope = float(np.clip(slope + np.clip(g / h, -0.5, 0.5), 0.05, 20))
    return Ranking(w, cut, slope, best / len(s))


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, and features of every row; a null text counts as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            x = features(batch.column("text"))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            rest = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*rest, values], ["doc_id", *keep, "features"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).cast("string").alias("text"))
    extra = "".join(f"{c} {kept.schema[c].dataType.simpleString()}, " for c in keep)
    return kept.mapInArrow(measure, f"doc_id long, {extra}features array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE, **options) -> Ranking:
    """The ranking learned from at most `limit` labelled documents outside the held-out fold; options go to pair_weights."""
    sample = quality_features(training_sample(docs, labels, label, limit=limit), keep=("label",)).withColumn("fold", fold("doc_id")).orderBy("doc_id").toArrow()
    if not sample.num_rows:
        return fit_pairs(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(sample.column("features").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    return fit_pairs(x, np.array(sample.column("label")), np.array(sample.column("fold")) == CUT_FOLD, **options)


def score_quality(docs: DataFrame, model: Ranking, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs, all columns, with the score of every row in score_col; a null text counts as empty.

    A column that is already named so is an error, not overwritten.
    """
    if score_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {score_col}")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, PIECE):
            yield batch.append_column(score_col, pa.array(model.score(features(batch.column(text_col)))))

    return docs.mapInArrow(score, docs.withColumn(score_col, F.lit(0.0)).schema)


def keep_quality(docs: DataFrame, model: Ranking, text_col: str = "text", least: float = CUT) -> DataFrame:
    """docs, all columns as they are, without the rows of a lower score."""
    name = "quality_score"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return score_quality(docs, model, text_col, name).where(F.col(name) >= least).drop(name)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(fold(id_col) == 0, F.lit(False))
