"""Exact substring deduplication with compressed FM-indexes per shard.

A window is a fixed number of consecutive words.  Words covered by a window
whose word sequence starts earlier in the corpus are removed.

1.  Anchors: of a window's short grams the one with the smallest hash names
    the window, so equal windows have equal anchors.  Anchors that occur once
    in the corpus cannot be in a repeated window; they are counted with a
    partial aggregate and dropped.
2.  What is left of a document is cut into segments, runs of windows with the
    same smallest gram of another kind.  Equal windows fall into segments of
    the same key.  Equal segments are one row, with their first place.
3.  Segments are dealt by key.  A shard is a run of keys of bounded size: its
    task builds an FM-index (wavelet matrix over the Burrows-Wheeler transform)
    of the segments and streams them through it backwards.  The matching
    statistics give each window's interval, and so its first place.
    Keys of more words than a shard are hot: their segments are cut into single
    windows, which are dealt by a digest of all their words.
4.  The places come back by document, where the words are removed.

A passage in a third of all documents is one row for each task in step 2 and
one row after it.

Anchors and keys are hashes and only deal windows out.  What decides is exact:
segments are equal by their text, words of a shard by their bytes, and windows
of hot keys by a digest of 128 bits (BLAKE2) of their whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, NON_BLANK, Spans, covered, flat, gram_hashes, mix, pieces
from .decontamination import suffix_array
from .shared import keep

WINDOW = 20
#: Words of an anchor, and of the grams by which segments are cut and dealt.
ANCHOR, CUT = 6, 3
#: Longest segment, in windows, and words of a shard.
RUN, SHARD = 64, 1_000_000
PIECE = 2 << 20


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of n consecutive values from every position."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Windows:
    """Windows of a piece of texts: starts (word positions), documents, anchors and, if asked for, segment keys."""

    def __init__(self, column: pa.Array, window: int, keys: bool = True):
        data, offsets = flat(column)
        self.words = Spans(data, offsets, NON_BLANK)
        hashes = self.words.hashes()
        counts = np.maximum(self.words.counts - window + 1, 0)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        at = np.cumsum(counts) - counts
        self.start = np.arange(len(self.doc)) + np.repeat(self.words.bounds[:-1] - at, counts)
        size = min(ANCHOR, window)
        self.grams = gram_hashes(hashes, size)
        self.anchor = sliding_min(self.grams, window - size + 1)[self.start] if len(self.start) else self.grams[:0]
        if keys:
            size = min(CUT, window)
            cut = mix(gram_hashes(hashes, size) + GOLDEN)
            self.key = sliding_min(cut, window - size + 1)[self.start] if len(self.start) else cut[:0]


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(anchor, doc_id, n): a document's anchors, and whether one place (1) or more (2) have it."""
    for batch in pieces(batches, "text", PIECE):
        w = Windows(batch.column("text"), window, keys=False)
        if not len(w.start):
            continue
        fresh = np.ones(len(w.start), dtype=bool)
        fresh[1:] = (w.doc[1:] != w.doc[:-1]) | (w.anchor[1:] != w.anchor[:-1]) | (w.grams[w.start[:-1]] == w.anchor[:-1])
        anchor, doc = w.anchor[fresh], w.doc[fresh]
        order = np.lexsort((anchor, doc))
        anchor, doc = anchor[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
        n = np.minimum(np.diff(np.concatenate((first, [len(anchor)]))), 2)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), batch.column("doc_id").take(pa.array(doc[first])), pa.array(n)], ["anchor", "doc_id", "n"])


def text_digest(text: bytes | None) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True) if text is not None else 0


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are about to be shuffled, with a digest that tells rows of one id apart."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in pieces(batches, "text", PIECE):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        digests = pa.array([text_digest(t) for t in texts], type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), digests, pa.array([pack(t) for t in texts], type=pa.binary())], ["doc_id", "digest", "packed"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        i = batch.schema.get_field_index("packed")
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            yield part.append_column("text", pa.array([unpack(t) for t in part.column(i).to_pylist()], type=pa.large_binary()))


def segments(w: Windows, anchors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First and last window (positions in w) of each segment of the windows with a repeated anchor."""
    none = np.zeros(0, dtype=np.int64)
    if not len(w.start):
        return none, none
    found = np.zeros(len(w.start), dtype=bool)
    bounds = np.searchsorted(w.doc, np.arange(len(anchors) + 1))
    for d, hits in enumerate(anchors):
        a, b = bounds[d], bounds[d + 1]
        if b > a:
            found[a:b] = np.isin(w.anchor[a:b], np.array(hits.values, dtype=np.int64).view(np.uint64))
    opens = found.copy()
    opens[1:] &= ~found[:-1] | (w.doc[1:] != w.doc[:-1]) | (w.key[1:] != w.key[:-1])
    first = np.flatnonzero(opens)
    closes = found.copy()
    closes[:-1] &= ~found[1:] | opens[1:]
    last = np.flatnonzero(closes)
    many = (last - first) // RUN + 1
    part = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    first, last = np.repeat(first, many) + part * RUN, np.repeat(last, many)
    return first, np.minimum(first + RUN - 1, last)


def _segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(_unpack(batches), "text", PIECE):
        w = Windows(batch.column("text"), window)
        first, last = segments(w, batch.column("anchors"))
        texts = batch.column("text").to_pylist()
        out, split, now = [], [], -1
        base = w.words.bounds
        for d, a, b in zip(w.doc[first].tolist(), (w.start[first] - base[w.doc[first]]).tolist(), (w.start[last] - base[w.doc[first]]).tolist(), strict=True):
            if d != now:
                split, now = texts[d].split(), d
            out.append(b" ".join(split[a : b + window]))
        rows = pa.array(w.doc[first])
        yield pa.RecordBatch.from_arrays(
            [pa.array(w.key[first].view(np.int64)), pa.array(out, type=pa.binary()), batch.column("doc_id").take(rows), batch.column("digest").take(rows), pa.array((w.start[first] - base[w.doc[first]]).astype(np.int32))],
            ["key", "segment", "doc_id", "digest", "start"],
        )


class WaveletMatrix:
    """Packed bits of a sequence of numbers, level by level, with rank over each level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.n, self.levels = len(values), levels
        self.bits, self.before, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, dtype=bool))), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.uint32)[:-1])).astype(np.uint32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate((values[~bit], values[bit]))

    def path(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` of the sequence comes to when it follows the bits of symbol; less that of 0, the rank."""
        at = at.astype(np.int64)
        for i in range(self.levels):
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            mask = (np.uint64(1) << shift) - np.uint64(1)
            ones = self.before[i][word].astype(np.int64) + np.bitwise_count(self.bits[i][word] & mask)
            bit = (symbol >> (self.levels - 1 - i)) & 1
            at = np.where(bit == 1, self.zeros[i] + ones, at - ones)
        return at


class FMIndex:
    """An index of coded segments for windows of a fixed length.

    Kept are the wavelet matrix of the transform, the symbols' counts, the
    borders of suffixes that agree on one word less than a window, and the
    first place of each window; the text and the suffix array are not.
    """

    def __init__(self, codes: np.ndarray, window: int):
        """codes: words from 1 on; every segment is followed by a 0.  Segments come in the order of their places."""
        n = len(codes)
        self.window, self.n = window, n
        order = suffix_array(codes, np.arange(n), window)
        levels = max(1, int(codes.max()).bit_length())
        self.matrix = WaveletMatrix(codes[order - 1], levels)
        counts = np.bincount(codes, minlength=int(codes.max()) + 1)
        self.smaller = np.cumsum(counts) - counts
        self.origin = self.matrix.path(np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64))
        # words up to which neighbours in the array agree, no further than a window or a segment's end
        agree = np.zeros(n, dtype=np.int64)
        alive = np.arange(1, n)
        for depth in range(window):
            x = codes[np.minimum(order[alive] + depth, n - 1)]
            alive = alive[(x == codes[np.minimum(order[alive - 1] + depth, n - 1)]) & (x > 0)]
            agree[alive] += 1
        self.short = np.cumsum(agree < window - 1) - 1
        self.short_starts = np.append(np.flatnonzero(agree < window - 1), n)
        whole = np.flatnonzero(agree < window)
        self.class_of = np.cumsum(agree < window) - 1
        self.first = np.minimum.reduceat(order, whole)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.smaller[symbol] + self.matrix.path(symbol, at) - self.origin[symbol]

    def first_places(self, codes: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For every position of codes the first place in the index of the window that begins there, or -1.

        Each range [start, end) is streamed backwards, all ranges together.
        The state is the interval of the longest match, at most a window long;
        before it grows past that, its last word is dropped by going to the
        interval of the shorter word sequence.  A word that cannot be put
        before the match makes the stream begin again one word short of it.
        """
        out = np.full(len(codes), -1, dtype=np.int64)
        at, size = ends - 1, np.zeros(len(ends), dtype=np.int64)
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.n, dtype=np.int64)
        alive = np.flatnonzero(at >= starts)
        while len(alive):
            p, lo, hi, m = at[alive], low[alive], high[alive], size[alive]
            full = m == self.window
            group = self.short[lo[full]]
            lo[full], hi[full] = self.short_starts[group], self.short_starts[group + 1]
            m = m - full
            symbol = codes[p]
            known = (symbol > 0) & (symbol < len(self.smaller))
            look = np.where(known, symbol, 0)
            both = self.step(np.concatenate((look, look)), np.concatenate((lo, hi)))
            lo, hi = both[: len(p)], both[len(p) :]
            good = known & (lo < hi)
            m = m + 1
            done = good & (m == self.window)
            out[p[done]] = self.first[self.class_of[lo[done]]]
            # where no match goes on: the next window to try ends one word before this match's end
            again = np.where(known & (m > 1), p + m - 2, p - 1)
            low[alive], high[alive] = np.where(good, lo, 0), np.where(good, hi, self.n)
            size[alive] = np.where(good, m, 0)
            at[alive] = np.where(good, p - 1, again)
            alive = alive[at[alive] >= starts[alive]]
        return out


def _shard(rows: pa.Table, window: int, shard: int) -> pa.RecordBatch:
    """Windows of each segment whose first place in the shard is before their own.

    More words than a shard takes, which only one key can have, are indexed in
    parts, and all segments are streamed through every part.
    """
    rows = rows.sort_by([("doc_id", "ascending"), ("digest", "ascending"), ("start", "ascending")])
    text = rows.column("segment").combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    words = Spans(*flat(text), NON_BLANK)
    coded = words.exact()[0]
    counts = words.counts
    ends = np.cumsum(counts + 1) - 1
    starts = ends - counts
    codes = np.zeros(int((counts + 1).sum()), dtype=np.int64)
    codes[np.arange(len(coded)) + words.doc] = coded + 1
    first = np.full(len(codes), len(codes), dtype=np.int64)
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + shard, side="right")))
        begin = int(starts[a])
        places = FMIndex(codes[begin : ends[b - 1] + 1], window).first_places(codes, ends, starts)
        first = np.where(places >= 0, np.minimum(first, places + begin), first)
        a = b
    earlier = first < np.arange(len(codes))
    flags = [np.packbits(earlier[s : e - window + 1], bitorder="little").tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id").combine_chunks(), "digest": rows.column("digest").combine_chunks(), "start": rows.column("start").combine_chunks(), "earlier": pa.array(flags, type=pa.binary())})


def _index(batches: Iterator[pa.RecordBatch], window: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Cut rows that come sorted by key into shards between keys."""
    held, words, key = [], 0, None
    for batch in batches:
        keys, n = np.array(batch.column("key")), batch.num_rows
        sizes = np.cumsum(pa.compute.binary_length(batch.column("segment")).to_numpy() // 6 + 1)
        a = 0
        while a < n:
            done = int(sizes[a - 1]) if a else 0
            if words < shard:
                b = min(n, int(np.searchsorted(sizes, done + shard - words)) + 1)
            else:  # the rest of the key at hand, and then a new shard
                other = np.flatnonzero(keys[a:] != key)
                b = a + int(other[0]) if len(other) else n
                if b == a:
                    yield _shard(pa.Table.from_batches(held), window, shard)
                    held, words = [], 0
                    continue
            held.append(batch.slice(a, b - a))
            words += int(sizes[b - 1]) - done
            key, a = keys[b - 1], b
    if held:
        yield _shard(pa.Table.from_batches(held), window, shard)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Digests of the windows of segments, with the place of the segment and that of the window (at)."""
    for batch in pieces(batches, "segment", PIECE):
        out, rows, at = [], [], []
        for i, (segment, start) in enumerate(zip(batch.column("segment").to_pylist(), batch.column("start").to_pylist(), strict=True)):
            words = segment.split()
            n = len(words) - window + 1
            out += [hashlib.blake2b(b" ".join(words[j : j + window]), digest_size=16).digest() for j in range(n)]
            rows += [i] * n
            at += range(start, start + n)
        rows = pa.array(rows, type=pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary()), *(batch.column(c).take(rows) for c in ("doc_id", "digest", "start")), pa.array(at, type=pa.int32())], ["window", "doc_id", "digest", "start", "at"])


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of a number, as the shards give them."""
    for batch in batches:
        bits = pa.array([x.to_bytes(8, "little", signed=True) for x in batch.column("bits").to_pylist()], type=pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "digest", "start")), bits], ["doc_id", "digest", "start", "earlier"])


def hot_places(segments: DataFrame, window: int) -> DataFrame:
    """The same as the shards give, for keys of any size: windows are dealt by their whole content, in joins that may be split."""
    windows = segments.mapInArrow(lambda batches: _windows(batches, window), "window binary, doc_id long, digest long, start int, at int")
    first = windows.groupBy("window").agg(F.min(F.struct("doc_id", "digest", "at")).alias("first"))
    earlier = F.struct("doc_id", "digest", "at") > F.col("first")
    bit = F.when(earlier, F.expr("shiftleft(1L, at - start)")).otherwise(F.lit(0).cast("long"))
    bits = windows.join(first, "window").groupBy("doc_id", "digest", "start").agg(F.bit_or(bit).alias("bits"))
    return bits.mapInArrow(_flags, "doc_id long, digest long, start int, earlier binary")


def _kept(text: bytes, digest: bool) -> str:
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


def _remove(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """Words to remove: of segments that are not the first of their kind all windows, of the others those found earlier."""
    for batch in pieces(_unpack(batches), "text", PIECE):
        w = Windows(batch.column("text"), window)
        first, last = segments(w, batch.column("anchors"))
        local = w.start - w.words.bounds[w.doc] if len(w.start) else w.start
        own = [{s["start"]: s["earlier"] for s in x or ()} for x in batch.column("places").to_pylist()]
        gone = []
        for d, a, b in zip(w.doc[first].tolist(), first.tolist(), last.tolist(), strict=True):
            flags = own[d].get(int(local[a]))
            if flags is None:
                gone.append(np.arange(a, b + 1))
            else:
                gone.append(a + np.flatnonzero(np.unpackbits(np.frombuffer(flags, dtype=np.uint8), count=b - a + 1, bitorder="little")))
        hit = w.start[np.concatenate(gone)] if gone else np.zeros(0, dtype=np.int64)
        removed = covered(hit, window, len(w.words))
        n_words, bounds = w.words.counts, w.words.bounds
        kept, n_removed = [], []
        for d, t in enumerate(batch.column("text").to_pylist()):
            flags = removed[bounds[d] : bounds[d + 1]]
            kept.append(_kept(b" ".join(compress(t.split(), (~flags).tolist())), digest))
            n_removed.append(int(flags.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n_removed, type=pa.int64()), pa.array(kept, type=pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _plain(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows as they are if nothing is removed."""
    for batch in pieces(batches, "text", PIECE):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        split = [(t or b"").split() for t in texts]
        kept = [_kept(b" ".join(x), digest) for x in split]
        columns = [batch.column("doc_id"), pa.array([text_digest(t) for t in texts], type=pa.int64()), pa.array([len(x) for x in split], type=pa.int64()), pa.array([0] * len(split), type=pa.int64()), pa.array(kept, type=pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_words", "n_removed", "kept"])


def deduplicate_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD, digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words left, joined by one blank).

    With digest=True kept is the SHA-256 of that text in hexadecimal digits,
    and no text but the suspects' leaves its task.

    Earlier means a smaller id, or the same row and an earlier start; rows of
    one id with different texts are told apart and ordered by a digest of the
    text, and equal rows of one id count as the same document.  Texts shorter
    than a window, empty and null texts lose nothing, and rows with a null id
    are compared with none.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    anchors = named.mapInArrow(lambda batches: _anchors(batches, window), "anchor long, doc_id long, n long")
    repeated = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("anchor")
    hits = anchors.select("anchor", "doc_id").join(repeated, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    packed = named.mapInArrow(_pack, "doc_id long, digest long, packed binary")
    suspects = keep(packed.join(hits, "doc_id"), "suspects")

    cut = suspects.mapInArrow(lambda batches: _segments(batches, window), "key long, segment binary, doc_id long, digest long, start int")
    distinct = cut.groupBy("key", "segment").agg(F.min(F.struct("doc_id", "digest", "start")).alias("place")).select("key", "segment", "place.*")
    distinct = keep(distinct, "segments")
    # at most one key for every `shard` words of the corpus
    hot = F.broadcast(distinct.groupBy("key").agg(F.sum(F.expr("length(segment) div 6 + 1")).alias("words")).where(F.col("words") > shard).select("key"))
    dealt = distinct.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    places = dealt.mapInArrow(lambda batches: _index(batches, window, shard), "doc_id long, digest long, start int, earlier binary")
    places = places.union(hot_places(distinct.join(hot, "key", "left_semi"), window))
    by_doc = places.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "earlier")).alias("places"))
    schema = "n_words long, n_removed long, kept string"
    cleaned = suspects.join(by_doc, ["doc_id", "digest"], "left").mapInArrow(lambda batches: _remove(batches, window, digest), f"doc_id long, {schema}")
    others = texts.mapInArrow(lambda batches: _plain(batches, digest), f"doc_id long, digest long, {schema}")
    others = others.join(suspects.select("doc_id", "digest").distinct(), ["doc_id", "digest"], "left_anti")
    return cleaned.union(others.drop("digest"))
