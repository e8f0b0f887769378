"""Periodic runs of words: stretches that repeat themselves with some period.

A run is found where two of its words, one period apart, agree and their common
extensions to both sides are long enough.  A run of period q and at least 4q
words holds a multiple of 3q among its first words whose partner q further on
is inside too, so for each q only every 3q-th word is asked: a harmonic grid of
about n log(n) / 3 pairs, most of which differ at once.

Common extensions come from a difference cover.  The residues of COVER have
every difference modulo MODULUS, so any two positions reach, at most MODULUS - 1
words further on and together, two sampled ones.  The words up to there are
compared; behind them only sampled suffixes (a fifth of all) are sorted, by
doubling blocks of MODULUS words, and the least common prefix between two of
them is a range minimum in a sparse table.  The suffixes of a text are sorted
only if a query gets that far.  Extensions to the left use the words backwards.

Texts are read one Arrow batch at a time, no shuffle: a task holds one piece of
texts (one longer text alone) and arrays over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_BLANK, Spans, covered_by, flat, pieces

#: A perfect difference set.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: A run has at least so many words, and periods.
LEAST, PERIODS = 6, 4
#: Text bytes of a piece, and pairs asked at once.
PIECE, PAIRS = 2 << 20, 1 << 20


def _shifts() -> np.ndarray:
    """For two residues, the words after which both are of the cover."""
    inside = np.zeros(MODULUS, dtype=bool)
    inside[list(COVER)] = True
    a, b, d = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return np.argmax(inside[(a + d) % MODULUS] & inside[(b + d) % MODULUS], axis=2)


class Extensions:
    """Common extensions of positions i < j of one text in a sequence of codes; texts are the ranges between bounds."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        self.codes, self.bounds = codes, bounds
        self.shifts = _shifts()
        self.sorted_texts = np.zeros(0, dtype=np.int64)
        self.place = None

    def ask(self, i: np.ndarray, j: np.ndarray, text: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i and j on agree, at most `most` (which stays inside the text)."""
        out = np.zeros(len(i), dtype=np.int64)
        reach = np.minimum(self.shifts[i % MODULUS, j % MODULUS], most)
        left = np.flatnonzero(reach > 0)
        far = [np.flatnonzero((reach == 0) & (most > 0))]
        step = 0
        while len(left):
            left = left[self.codes[i[left] + step] == self.codes[j[left] + step]]
            step += 1
            out[left] = step
            done = reach[left] == step
            far.append(left[done])
            left = left[~done]
        far = np.concatenate(far)
        far = far[reach[far] < most[far]]
        if len(far):
            self._sort(text[far])
            out[far] = np.minimum(reach[far] + self._sampled(i[far] + reach[far], j[far] + reach[far]), most[far])
        return out

    def _sort(self, texts: np.ndarray) -> None:
        """Have the sampled suffixes of these texts sorted, with the ones sorted already."""
        texts = np.unique(texts)
        if np.isin(texts, self.sorted_texts, assume_unique=True).all():
            return
        self.sorted_texts = np.union1d(texts, self.sorted_texts)
        inside = np.zeros(MODULUS, dtype=bool)
        inside[list(COVER)] = True
        lengths = self.bounds[self.sorted_texts + 1] - self.bounds[self.sorted_texts]
        at = np.arange(int(lengths.sum())) + np.repeat(self.bounds[self.sorted_texts] - np.cumsum(lengths) + lengths, lengths)
        chosen = inside[at % MODULUS]
        at, owner = at[chosen], np.repeat(self.sorted_texts, lengths)[chosen]
        m = len(at)
        self.place = np.full(len(self.codes) + MODULUS, m, dtype=np.int64)
        self.place[at] = np.arange(m)
        # the sample a block further on, or m behind the last one of the text
        after = self.place[at + MODULUS]
        after[at + MODULUS >= self.bounds[owner + 1]] = m
        after = np.append(after, m)
        rank = np.append(self._blocks(at), -1)
        ranks, nexts = [rank], [after]
        while (nexts[-1] < m).any() and ranks[-1].max(initial=-1) < m - 1:
            rank, after = ranks[-1], nexts[-1]
            pair = (rank[:m] * (m + 1)) + rank[after[:m]] + 1
            ranks.append(np.append(np.unique(pair, return_inverse=True)[1], -1))
            nexts.append(after[after])
        order = np.argsort(ranks[-1][:m], kind="stable")
        self.rank = np.empty(m, dtype=np.int64)
        self.rank[order] = np.arange(m)
        self._minima(self._neighbours(at, order, ranks, nexts))

    def _blocks(self, at: np.ndarray) -> np.ndarray:
        """The rank of the MODULUS words at each sample among them."""
        padded = np.concatenate((self.codes + 1, np.zeros(MODULUS, dtype=np.int64)))
        bits = max(int(padded.max(initial=0)).bit_length(), 1)
        each = max(62 // bits, 1)
        keys = []
        for k in range(0, MODULUS, each):
            key = padded[at + k]
            for more in range(k + 1, min(k + each, MODULUS)):
                key = (key << bits) | padded[at + more]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        fresh = np.zeros(len(at), dtype=bool)
        for key in keys:
            fresh[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(at), dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        return rank

    def _neighbours(self, at: np.ndarray, order: np.ndarray, ranks: list[np.ndarray], nexts: list[np.ndarray]) -> np.ndarray:
        """Common words of suffixes next to each other in order; more than there are where both texts end in one block."""
        m = len(at)
        x, y = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(x), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            same = np.flatnonzero((ranks[k][x] == ranks[k][y]) & (x < m) & (y < m))
            common[same] += MODULUS << k
            x[same], y[same] = nexts[k][x[same]], nexts[k][y[same]]
        left = np.flatnonzero((x < m) & (y < m))
        a, b, step = at[x[left]], at[y[left]], 0
        n = len(self.codes)
        while len(left) and step < MODULUS:
            inside = (a + step < n) & (b + step < n)
            left, a, b = left[inside], a[inside], b[inside]
            same = self.codes[a + step] == self.codes[b + step]
            left, a, b = left[same], a[same], b[same]
            common[left] += 1
            step += 1
        return common

    def _minima(self, values: np.ndarray) -> None:
        """A sparse table: level k has the least of 2^k values from each place on."""
        self.table = [values]
        while 2 << (len(self.table) - 1) <= len(values):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[self.place[i]], self.rank[self.place[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for k in np.unique(level):
            these = np.flatnonzero(level == k)
            row = self.table[k]
            out[these] = np.minimum(row[low[these]], row[high[these] - (1 << int(k))])
        return out


def find(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, end and smallest period of all runs, by text, start and period; positions are of the whole sequence."""
    n = len(codes)
    sizes = np.diff(bounds)
    forth, back = Extensions(codes, bounds), Extensions(codes[::-1], n - bounds[::-1])
    texts = len(sizes)
    periods = np.where(sizes >= LEAST, sizes // PERIODS, 0)
    owner = np.repeat(np.arange(texts), periods)
    q = np.arange(len(owner)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    grid = (PERIODS - 1) * q
    many = (sizes[owner] - q - 1) // grid + 1
    upto = np.cumsum(many)
    found, begin = [np.zeros((4, 0), dtype=np.int64)], 0
    while begin < len(many):
        end = max(int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right")), begin + 1)
        part = np.repeat(np.arange(begin, end), many[begin:end])
        nth = np.arange(len(part)) - np.repeat(upto[begin:end] - many[begin:end] - (upto[begin - 1] if begin else 0), many[begin:end])
        i = bounds[owner[part]] + nth * grid[part]
        same = np.flatnonzero(codes[i] == codes[i + q[part]])
        part, i = part[same], i[same]
        step, text = q[part], owner[part]
        before = back.ask(n - i - step, n - i, texts - 1 - text, np.minimum(i - bounds[text], grid[part]))
        # a run that goes on for a whole grid step before is met there
        first = np.flatnonzero(before < grid[part])
        i, step, text, before = i[first], step[first], text[first], before[first]
        after = forth.ask(i, i + step, text, bounds[text + 1] - i - step)
        long = np.flatnonzero(before + after + step >= np.maximum(LEAST, PERIODS * step))
        found.append(np.stack((text[long], (i - before)[long], (i + step + after)[long], step[long])))
        begin = end
    text, start, stop, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, stop, start, text))
    text, start, stop, period = text[order], start[order], stop[order], period[order]
    smallest = np.ones(len(text), dtype=bool)
    smallest[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    text, start, stop, period = text[smallest], start[smallest], stop[smallest], period[smallest]
    order = np.lexsort((period, start, text))
    return text[order], start[order], stop[order], period[order]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE):
        data, offsets = flat(batch.column("text"))
        words = Spans(data, offsets, NON_BLANK)
        text, start, stop, period = find(words.exact()[0], words.bounds)
        kept = np.flatnonzero(~covered_by(start + period, stop, len(words)))
        collapsed = joined(words, kept)
        lists = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(start - words.bounds[text]), pa.array(stop - start), pa.array(period)], fields=list(RUN))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(lists), runs), collapsed], ["doc_id", "n_words", "runs", "collapsed"]
        )


def joined(words: Spans, kept: np.ndarray) -> pa.Array:
    """Per text its kept words, joined by one blank."""
    sizes = words.end[kept] - words.start[kept]
    last = np.searchsorted(kept, words.bounds[1:]) - 1
    gap = np.ones(len(kept), dtype=np.int64)
    some = np.searchsorted(kept, words.bounds[:-1]) <= last
    gap[last[some]] = 0
    ends = np.cumsum(sizes + gap)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
    begin = ends - sizes - gap
    # the bytes of a word move by one distance
    chars = np.repeat(words.start[kept] - begin, sizes)
    to = np.arange(len(chars)) + np.repeat(np.cumsum(gap) - gap, sizes)
    out[to] = words.data[to + chars]
    bounds = np.concatenate(([0], ends))[np.concatenate(([0], last + 1))]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]).cast(pa.large_string()).cast(pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length and smallest period in words, by start, then period) and the collapsed text.

    Words are maximal stretches without blanks.  A run is a stretch of words
    with smallest period q (words q apart are equal) of at least 6 words and 4
    periods, which no neighbouring word extends with that period; runs may
    overlap.  The collapsed text has the words that no run holds after its first
    q, joined by one blank.  A null text is an empty one: no words, no runs, an
    empty collapsed text.  Rows are taken one by one, so repeated rows and null
    ids come back as they are; other columns are not read.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(_found, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """The text for most rows; for a tenth of them its words with the end replaced by repetitions, of a place and period that the id decides.

    With h the crc32 of the id as text and g a tenth of it: where h ends in 0,
    word i from a = g % n on is word a + (i - a) % p, and p = 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")

    def moved(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)).cast("long") + 1
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))

    # an array of one array binds the words, which each element would split again otherwise
    laid = F.array_join(F.flatten(F.transform(F.array(words), moved)), " ")
    return F.when((h % 10 == 0) & (n > 0), laid).otherwise(text)


def run_digest(found: DataFrame) -> DataFrame:
    """The number of runs, the one with most periods (then the first, then the smallest period), and digests of all runs and of the collapsed text."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    better = lambda a, b: a["length"] * b["period"] < b["length"] * a["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
    out = found.withColumn("_best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("_best")[c].alias(c) for c in ("start", "length", "period")),
        F.call_function("div", F.col("_best.length") * 1000, F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.concat(listed, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
