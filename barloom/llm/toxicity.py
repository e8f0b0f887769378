"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the lower-cased words, all of them.  A bounded sample of labelled
documents is the index; inverse document frequencies of its terms are counted
over all documents.  As toxic words are few among many random ones, each term's
inverse document frequency is weighed by how surely its presence tells the
sample's labels apart (a factor between 0 and 1, never 0): plain frequencies
find neighbours that share rare harmless words.

The index has postings for every term, in blocks of examples with the largest
weight of each block.  A block is evaluated only if its bound reaches the k-th
best cosine.  A document's vote is the distance-weighted one of its nearest
examples, where all that tie for the last place count alike; scores are votes
calibrated on labelled documents that are not in the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WIDE, FOLD, Spans, flat, pieces
from .labelled import training_sample
from .shared import discard, keep

#: Labelled documents in the index, and those for calibration, at most.
EXAMPLES, CALIBRATION = 4096, 1024
INDEX_FOLDS, CALIBRATION_FOLDS = (2, 3, 4), (1,)
NEIGHBOURS, BLOCK = 15, 64
#: How much evidence (a squared z-score) gives a term half its weight, and documents that each label is assumed to have besides.
DOUBT, PRIOR = 20.0, 4.0
PIECE = 4 << 20
#: Tasks over which a sample is spread.
TASKS = 16
#: Texts searched together; few, so that their cosines stay near the processor.
QUERIES = 16


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the text of each."""
    data, offsets = flat(column)
    words = Spans(FOLD[data], offsets, ALNUM_WIDE)
    return words.hashes(), words.doc


class Finder:
    """Places of hashes in a sorted set; a table of flags turns most of the others away first."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.low = np.uint64((1 << min(max((8 * len(terms)).bit_length(), 16), 23)) - 1)
        self.table = np.zeros(int(self.low) + 1, dtype=bool)
        self.table[(terms & self.low).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.table[(hashes & self.low).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        at = np.searchsorted(self.terms, hashes[maybe])
        at[at == len(self.terms)] = 0
        good = self.terms[at] == hashes[maybe]
        return maybe[good], at[good]


def term_counts(column: pa.Array, finder: Finder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place of the term in the finder, and occurrences, for each term of each text; in order of both."""
    hashes, docs = terms_of(column)
    where, which = finder.find(hashes)
    width = max(len(finder.terms), 1)
    key, n = np.unique(docs[where] * width + which, return_counts=True)
    return key // width, key % width, n


def unit_vectors(doc: np.ndarray, at: np.ndarray, n: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """Weights of the terms' occurrences, so that those of a text have length 1."""
    x = (1 + np.log(n)) * weight[at]
    return x / np.maximum(np.sqrt(np.bincount(doc, x * x, texts)), 1e-300)[doc]


def sample_terms(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of all terms of the sample."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            yield pa.RecordBatch.from_pydict({"term": np.unique(terms_of(batch.column("text"))[0]).view(np.int64)})

    found = sample.select("text").mapInArrow(distinct, "term long").distinct().toArrow().column("term")
    return np.sort(np.array(found, dtype=np.int64).view(np.uint64))


def document_frequencies(docs: DataFrame, terms: np.ndarray, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and their number."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, n = Finder(sent.value), 0
        total = np.zeros(len(finder.terms), dtype=np.int64)
        for batch in pieces(batches, "text", PIECE):
            total += np.bincount(term_counts(batch.column("text"), finder)[1], minlength=len(total))
            n += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": np.concatenate(([-1], some)), "n": np.concatenate(([n], total[some]))})

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, dtype=np.int64)
    out[np.array(rows.column("at"), dtype=np.int64) + 1] = np.array(rows.column("n"), dtype=np.int64)
    return out[1:], int(out[0])


def term_weights(doc: np.ndarray, at: np.ndarray, labels: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Inverse document frequencies times z² / (z² + DOUBT), z the score of the log ratio of a term's shares in both classes."""
    n = len(idf)
    with_term, toxic = np.bincount(at, minlength=n), np.bincount(at, labels[doc], n)
    share = (labels.sum() + 1) / (len(labels) + 2)
    a, b = toxic + PRIOR * share, with_term - toxic + PRIOR * (1 - share)
    ratio = np.log(a / (labels.sum() + PRIOR)) - np.log(b / ((1 - labels).sum() + PRIOR))
    z2 = ratio**2 / (1 / a + 1 / b)
    return idf * np.maximum(z2 / (z2 + DOUBT), 1e-6)


def clusters(n: int, doc: np.ndarray, at: np.ndarray, value: np.ndarray, terms: int, columns: int = 512, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """A group of like examples for each, and its cosine with the group's mean, over the terms of largest weight.

    Only the order of the examples hangs on this, and so how narrow the blocks'
    bounds are; the results do not.
    """
    if not len(doc):
        return np.zeros(n, dtype=np.int64), np.zeros(n)
    mass = np.bincount(at, value * value, terms)
    top = np.argsort(-mass, kind="stable")[:columns]
    column = np.full(terms, -1, dtype=np.int64)
    column[top] = np.arange(len(top))
    x = np.zeros((n, len(top)), dtype=np.float32)
    some = column[at] >= 0
    x[doc[some], column[at[some]]] = value[some]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    means = x[:: max(1, n // max(1, n // BLOCK))]
    for _ in range(rounds):
        group = (x @ means.T).argmax(axis=1)
        means = np.stack([x[group == g].sum(axis=0) for g in range(len(means))])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    like = x @ means.T
    group = like.argmax(axis=1)
    return group, np.round(like[np.arange(n), group], 4)


@dataclass
class Index:
    """Postings of the examples, term by term and block by block.

    Term t has the entries entries[t] to entries[t + 1]; an entry is a block, the
    largest weight there, and the postings postings[e] to postings[e + 1]:
    examples and their weights.
    """

    terms: np.ndarray
    weights: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    entries: np.ndarray
    block: np.ndarray
    most: np.ndarray
    postings: np.ndarray
    example: np.ndarray
    value: np.ndarray
    #: Examples without any term.
    bare: np.ndarray
    #: Scores are 1 / (1 + exp(-(slope * logit(vote) + shift))).
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def build(cls, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, labels: np.ndarray, doc: np.ndarray, at: np.ndarray, value: np.ndarray, block: int = BLOCK) -> Index:
        """From the terms (at) of examples (doc) and their weights."""
        n = len(ids)
        group, near = clusters(n, doc, at, value, len(terms))
        order = np.lexsort((ids, -near, group))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        doc = place[doc]
        by = np.lexsort((doc, at))
        doc, at, value = doc[by], at[by], value[by]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (at[1:] != at[:-1]) | (doc[1:] // block != doc[:-1] // block)
        first = np.flatnonzero(fresh)
        most = np.maximum.reduceat(value, first) if len(first) else value
        bare = np.ones(n, dtype=bool)
        bare[doc] = False
        entries = np.searchsorted(at[first], np.arange(len(terms) + 1))
        return cls(terms, weights, ids[order], labels[order], entries, doc[first] // block, most, np.append(first, len(at)), doc, value, bare)

    def plain(self) -> dict:
        """What is sent to the tasks: arrays and numbers only, so that they need not know this class."""
        return dict(self.__dict__)

    def cosines(self, doc: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int, k: int = NEIGHBOURS, block: int = BLOCK) -> np.ndarray:
        """Cosines of n texts with all examples; -1 in blocks whose bound is below the k-th best."""
        total = len(self.ids)
        blocks = -(-total // block)
        sizes = self.entries[at + 1] - self.entries[at]
        entry = np.arange(int(sizes.sum())) + np.repeat(self.entries[at] - (np.cumsum(sizes) - sizes), sizes)
        pair = np.repeat(doc * blocks, sizes) + self.block[entry]
        q = np.repeat(weight, sizes)
        bound = np.bincount(pair, q * self.most[entry], n * blocks).reshape(n, blocks) + 1e-5
        out = np.zeros(n * blocks * block)
        done = np.zeros((n, blocks), dtype=bool)

        def evaluate(chosen: np.ndarray) -> None:
            some = np.flatnonzero(chosen.ravel()[pair])
            e = entry[some]
            many = self.postings[e + 1] - self.postings[e]
            where = np.arange(int(many.sum())) + np.repeat(self.postings[e] - (np.cumsum(many) - many), many)
            row = np.repeat(pair[some] // blocks * (blocks * block), many)
            nonlocal out
            out += np.bincount(row + self.example[where], np.repeat(q[some], many) * self.value[where], len(out))
            done[chosen] = True

        k = min(k, total)
        seeds = min(blocks, -(-k // block) + 1)
        first = np.zeros((n, blocks), dtype=bool)
        np.put_along_axis(first, np.argpartition(-bound, seeds - 1, axis=1)[:, :seeds], True, axis=1)
        evaluate(first)
        so_far = np.where(np.repeat(done, block, axis=1), out.reshape(n, -1), -1)[:, :total]
        least = np.partition(so_far, total - k, axis=1)[:, total - k]
        evaluate((bound >= least[:, None]) & ~done)
        return np.where(np.repeat(done, block, axis=1), out.reshape(n, -1), -1)[:, :total]

    def votes(self, cosine: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Distance-weighted share of toxic ones among the k nearest; those that tie for the last places share them."""
        cosine = np.round(cosine, 6)
        k = min(k, cosine.shape[1])
        least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]
        above, level = cosine > least, cosine == least
        weight = above + level * ((k - above.sum(axis=1, keepdims=True)) / level.sum(axis=1, keepdims=True))
        weight = weight * (cosine >= 0) / (0.02 + np.maximum(1 - cosine, 0))
        return weight @ self.labels / np.maximum(weight.sum(axis=1), 1e-9)

    def own(self, ids: pa.Array) -> np.ndarray:
        """The example that each id is itself, or -1."""
        wanted = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.argsort(self.ids)
        at = order[np.minimum(np.searchsorted(self.ids, wanted, sorter=order), len(order) - 1)] if len(order) else np.zeros(len(wanted), dtype=np.int64)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known & (self.ids[at] == wanted), at, -1) if len(order) else np.full(len(wanted), -1)

    def search(self, ids: pa.Array, column: pa.Array, finder: Finder, k: int = NEIGHBOURS) -> tuple[np.ndarray, list[list[int]]]:
        """Votes, and the ids of up to three nearest examples, nearest first; an example is none of its own."""
        n = len(column)
        base = (self.labels.sum() + 1) / (len(self.labels) + 2)
        vote, evidence = np.full(n, (self.labels[self.bare].sum() + base) / (self.bare.sum() + 1)), [[] for _ in range(n)]
        doc, at, count = term_counts(column, finder)
        if len(doc):
            weight = unit_vectors(doc, at, count, self.weights, n)
            itself = self.own(ids)
            for rows, extra in ((np.unique(doc[itself[doc] < 0]), 0), (np.unique(doc[itself[doc] >= 0]), 1)):
                if not len(rows):
                    continue
                chosen = itself[doc] >= 0 if extra else itself[doc] < 0
                # a document that is an example leaves itself, so it needs one more
                cosine = self.cosines(np.searchsorted(rows, doc[chosen]), at[chosen], weight[chosen], len(rows), k + extra)
                if extra:
                    cosine[np.arange(len(rows)), itself[rows]] = -1
                vote[rows] = np.where((cosine < 0).all(axis=1), vote[rows], self.votes(cosine, k)) if extra else self.votes(cosine, k)
                near = np.argsort(-np.round(cosine, 6), axis=1, kind="stable")[:, :3] if cosine.shape[1] <= 3 else _top3(np.round(cosine, 6))
                for j, found, close in zip(rows.tolist(), self.ids[near].tolist(), np.take_along_axis(cosine, near, axis=1).tolist(), strict=True):
                    evidence[j] = [i for i, c in zip(found, close, strict=True) if c >= 0]
        return vote, evidence

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        vote = np.clip(vote, 0.005, 0.995)
        return 1 / (1 + np.exp(-(self.slope * np.log(vote / (1 - vote)) + self.shift)))

    def calibrate(self, vote: np.ndarray, label: np.ndarray) -> None:
        """Fit slope and shift by Newton steps on the logistic loss, held near 1 and 0."""
        if not len(vote):
            return
        vote = np.clip(vote, 0.005, 0.995)
        x = np.stack([np.log(vote / (1 - vote)), np.ones(len(vote))], axis=1)
        start = w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            gradient = x.T @ (label - p) - (w - start)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), gradient)
            w = w + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.shift = max(float(w[0]), 0.05), float(w[1])


def _top3(cosine: np.ndarray) -> np.ndarray:
    near = np.sort(np.argpartition(-cosine, 2, axis=1)[:, :3], axis=1)
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(cosine, near, axis=1), axis=1, kind="stable"), axis=1)


def _search(index: dict, k: int, also: tuple[str, ...]):
    """A step for mapInArrow: doc_id, the columns `also`, vote and evidence of each row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Index(**index.value)
        finder = Finder(e.terms)
        for piece in pieces(batches, "text", PIECE):
            for i in range(0, piece.num_rows, QUERIES):
                batch = piece.slice(i, QUERIES)
                vote, evidence = e.search(batch.column("doc_id"), batch.column("text"), finder, k)
                rest = [batch.column(c) for c in ("doc_id", *also)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(e.calibrated(vote)), pa.array(vote), pa.array(evidence, type=pa.list_(pa.int64()))], ["doc_id", *also, "score", "vote", "evidence"])

    return step


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = EXAMPLES, calibration: int = CALIBRATION, k: int = NEIGHBOURS) -> Index:
    """The index of at most `limit` labelled documents, calibrated on at most `calibration` others, none of the held-out fold.

    Both samples are bounded and chosen by a hash of the id; document
    frequencies are those of all documents.
    """
    sample = keep(training_sample(docs, labels, label, limit=limit, folds=INDEX_FOLDS).repartition(TASKS), "examples")
    terms = sample_terms(sample)
    frequencies, n = document_frequencies(docs, terms)
    idf = np.log((1 + n) / (1 + frequencies)) + 0.1
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for batch in pieces(batches, "text", PIECE):
            doc, at, n = term_counts(batch.column("text"), finder)
            rows = [pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(x.astype(np.int32))) for x in (at, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *rows], ["doc_id", "label", "at", "n"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(count, "doc_id long, label int, at array<int>, n array<int>").toArrow().sort_by("doc_id").combine_chunks()
    ids, truth = np.array(rows.column("doc_id"), dtype=np.int64), np.array(rows.column("label"), dtype=np.int64)
    at, counts = (np.array(pa.compute.list_flatten(rows.column(c)), dtype=np.int64) for c in ("at", "n"))
    doc = np.repeat(np.arange(len(ids)), np.array(pa.compute.list_value_length(rows.column("at")), dtype=np.int64))
    weights = term_weights(doc, at, truth, idf)
    index = Index.build(terms, weights, ids, truth, doc, at, unit_vectors(doc, at, counts, weights, len(ids)))
    if len(ids):
        others = training_sample(docs, labels, label, limit=calibration, folds=CALIBRATION_FOLDS).repartition(TASKS)
        sent_index = docs.sparkSession.sparkContext.broadcast(index.plain())
        known = others.mapInArrow(_search(sent_index, k, ("label",)), "doc_id long, label int, score double, vote double, evidence array<long>").select("doc_id", "vote", "label").toArrow().sort_by("doc_id")
        index.calibrate(np.array(known.column("vote"), dtype=float), np.array(known.column("label"), dtype=float))
    discard(sample)
    return index


def score_toxicity(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", k: int = NEIGHBOURS) -> DataFrame:
    """Per row: doc_id, score, and evidence (ids of the nearest examples, nearest first, at most three).

    Texts without any term of the index (null and empty ones too) get the share
    of toxic examples among those without any term, and no evidence.  A row whose
    id is an example's is scored by the others.  Rows are scored one by one: ids
    may be null or repeated, other columns are not read.
    Without examples every score is 0.5.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index.plain())
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(_search(sent, k, ()), "doc_id long, score double, vote double, evidence array<long>").drop("vote")
