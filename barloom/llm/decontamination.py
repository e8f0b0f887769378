"""Benchmark decontamination with training suffix arrays.

Each piece of training texts is a shard.  Its task sorts the shard's word
suffixes by prefix doubling and finds every distinct window of the test
suffixes in that suffix array by binary search.  Where one occurs, the suffix
of the training text is searched in the sorted test suffixes that begin with
the window, which gives the longest verbatim match there and its place.  Only
training suffixes that begin a run of test words long enough to match are
sorted; no other can begin a match, so the results are those of the full array.

Words are found by hashes and compared by their bytes.  Equal windows of many
items are one window with a list of items, so no pairs of occurrences and test
positions are made.

The test set is a stated query set.  Its words are sent to the tasks in blocks
of at most BLOCK_BYTES.  A larger test set takes a pass for each block; the
result of each is written to the shared folder before the next one begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WIDE, FOLD, Spans, flat, grams_of, pieces
from .shared import discard, keep

#: Words of a window; an item with fewer words is one window.
WINDOW = 10
BLOCK_BYTES = 8 << 20
PIECE = 4 << 20


def _words(column: pa.Array) -> Spans:
    data, offsets = flat(column)
    return Spans(FOLD[data], offsets, ALNUM_WIDE)


def suffix_array(codes: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts, sorted by the codes that follow them, to a depth of at least `depth`.

    codes must end every document with its own smallest code 0, and starts
    hold every position but those codes'.
    """
    rank = np.zeros(len(codes) + 1, dtype=np.int64)
    rank[: len(codes)] = codes
    order, size = starts, 1
    while True:
        first = rank[starts]
        second = np.where(first > 0, rank[np.minimum(starts + size, len(codes))], 0)
        key = first * (int(rank.max()) + 1) + second
        by = np.argsort(key)
        order, key = starts[by], key[by]
        new = np.cumsum(np.concatenate(([1], key[1:] != key[:-1])))
        rank[order] = new
        size *= 2
        if size >= depth or new[-1] == len(order):
            return order


class TestSet:
    """A block of test items: its vocabulary, its distinct windows, and its sorted suffixes."""

    def __init__(self, ids: list[str], texts: pa.Array):
        words = _words(texts)
        codes, first, self.seed = words.exact()
        # the distinct words, in the order of their hashes
        size = (words.end - words.start)[first]
        at = np.cumsum(size) - size
        self.letters = words.data[np.arange(int(size.sum())) + np.repeat(words.start[first] - at, size)]
        self.offsets = np.append(at, int(size.sum()))
        self.codes = np.append(codes + 1, 0)
        self.ids = list(dict.fromkeys(ids))
        name = {x: i for i, x in enumerate(self.ids)}
        item_of = np.array([name[x] for x in ids], dtype=np.int64)
        left = words.bounds[1:][words.doc] - np.arange(len(words))
        own = np.minimum(words.counts, WINDOW)[words.doc]
        starts = np.flatnonzero(left >= own)
        size = own[starts]
        number = grams_of(codes, starts, size)
        by = np.argsort(number, kind="stable")
        #: Of each distinct window a place, its size, and the number of its list of items.
        some = by[np.searchsorted(number[by], np.arange(int(number.max(initial=-1)) + 1))]
        self.place, self.size = starts[some], size[some]
        lists: dict[bytes, int] = {}
        width = max(len(self.ids), 1)
        pair = np.unique(number * width + item_of[words.doc[starts]])
        window, item = pair // width, (pair % width).astype(np.int32)
        bounds = np.searchsorted(window, np.arange(len(some) + 1)).tolist()
        self.list = np.array([lists.setdefault(item[a:b].tobytes(), len(lists)) for a, b in zip(bounds, bounds[1:])], dtype=np.int64)
        self.lists = [np.frombuffer(x, dtype=np.int32) for x in lists]
        self.least = int(self.size.min(initial=WINDOW))
        self.longest = int(words.counts.max(initial=0))
        #: Suffixes of the items long enough to go beyond a window, sorted, and where those of each window are.
        closed = np.zeros(len(words) + len(ids) + 1, dtype=np.int64)
        place = np.arange(len(words)) + words.doc
        closed[place] = codes + 1
        self.closed = closed
        long = np.zeros(len(closed), dtype=bool)
        long[place[starts[size == WINDOW]]] = True
        order = suffix_array(closed, place, self.longest) if len(place) else place
        self.order = order[long[order]]
        self.low, self.high = search(closed, self.order, self.codes, self.place, np.where(self.size == WINDOW, self.size, 0))

    def plain(self) -> dict:
        """What is sent to the tasks: arrays, numbers and lists only, so that they need not know this class."""
        return self.__dict__

    @classmethod
    def of(cls, plain: dict) -> TestSet:
        out = cls.__new__(cls)
        out.__dict__.update(plain)
        return out

    @property
    def vocabulary(self) -> Spans:
        """The distinct words, by number."""
        return Spans(self.letters, self.offsets, ~np.zeros(256, dtype=bool))


def narrow(codes: np.ndarray, order: np.ndarray, depth: np.ndarray | int, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts [lo, hi) of a suffix array those whose suffixes have `word` at `depth`, by binary search."""
    ends, m = [], max(len(order), 1)
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while (a < b).any():
            mid = (a + b) >> 1
            seen = codes[np.minimum(order[np.minimum(mid, m - 1)] + depth, len(codes) - 1)]
            go = (seen <= word if right else seen < word) & (a < b)
            a, b = np.where(go, mid + 1, a), np.where(go, b, np.minimum(mid, b))
        ends.append(a)
    return ends[0], ends[1]


def search(codes: np.ndarray, order: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the suffix array `order` of codes that begin with words[s : s + size]; all at once, word by word."""
    first, last = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    low, high = first.copy(), np.full(len(starts), len(order), dtype=np.int64)
    alive, depth = np.flatnonzero((sizes > 0) & (high > 0)), 0
    while len(alive):
        lo, hi = narrow(codes, order, depth, words[starts[alive] + depth], low[alive], high[alive])
        depth += 1
        found = lo < hi
        alive, lo, hi = alive[found], lo[found], hi[found]
        low[alive], high[alive] = lo, hi
        whole = sizes[alive] == depth
        first[alive[whole]], last[alive[whole]] = lo[whole], hi[whole]
        alive = alive[sizes[alive] > depth]
    return first, last


def _hits(words: Spans, tests: TestSet, vocabulary: Spans, known_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all occurrences of distinct test windows in a shard: first word, window, length of the longest match there."""
    none = np.zeros(0, dtype=np.int64)
    if not len(words) or not len(tests.place):
        return none, none, none
    hashes, doc = words.hashes(tests.seed), words.doc
    at = np.searchsorted(known_hashes, hashes)
    at[at == len(known_hashes)] = 0
    known = known_hashes[at] == hashes
    maybe = np.flatnonzero(known)
    known[maybe] = words.same(maybe, vocabulary, at[maybe])
    opens = known & np.concatenate(([True], ~known[:-1] | (doc[1:] != doc[:-1])))
    run = np.cumsum(opens) - 1
    keep = np.flatnonzero(known)
    keep = keep[np.bincount(run[keep], minlength=1)[run[keep]] >= tests.least]
    if not len(keep):
        return none, none, none
    # the runs end to end, each closed by a 0
    fresh = np.concatenate(([0], run[keep][1:] != run[keep][:-1]))
    place = np.arange(len(keep)) + np.cumsum(fresh)
    codes = np.zeros(int(place[-1]) + 2, dtype=np.int64)
    codes[place] = at[keep] + 1
    back = np.zeros(len(codes), dtype=np.int64)
    back[place] = keep
    order = suffix_array(codes, place, WINDOW)
    first, last = search(codes, order, tests.codes, tests.place, tests.size)
    found = np.flatnonzero(last > first)
    many = last[found] - first[found]
    window = np.repeat(found, many)
    spot = order[np.arange(int(many.sum())) + np.repeat(first[found] - (np.cumsum(many) - many), many)]
    length = tests.size[window].copy()
    alive = np.flatnonzero(tests.high[window] > tests.low[window])
    lo, hi = tests.low[window[alive]], tests.high[window[alive]]
    while len(alive):
        word = codes[spot[alive] + length[alive]]
        lo, hi = narrow(tests.closed, tests.order, length[alive], word, lo, hi)
        goes = (word > 0) & (lo < hi)
        alive, lo, hi = alive[goes], lo[goes], hi[goes]
        length[alive] += 1
    return back[spot], window, length


RESULTS = ["n_words", "hit_words", "items", "longest_match", "longest_at"]
RESULT = "struct<n_words:bigint,hit_words:array<int>,items:array<string>,longest_match:bigint,longest_at:bigint>"


def _scan(batches: Iterator[pa.RecordBatch], tests: TestSet, text: str, result: str) -> Iterator[pa.RecordBatch]:
    """Fill the column `result`, adding to what an earlier pass left there."""
    vocabulary = tests.vocabulary
    known_hashes = vocabulary.hashes(tests.seed)
    for batch in pieces(batches, text, PIECE):
        words = _words(batch.column(text))
        position, window, length = _hits(words, tests, vocabulary, known_hashes)
        doc = words.doc[position]
        earlier = dict(zip(RESULTS, batch.column(result).flatten(), strict=True))
        hit = covered_by(position, tests.size[window], len(words))
        items = [list(x) for x in earlier["items"].to_pylist()]
        width = max(len(tests.lists), 1)
        chosen = np.unique(doc * width + tests.list[window])
        for d in np.unique(chosen // width).tolist():
            lists = (chosen[np.searchsorted(chosen, d * width) : np.searchsorted(chosen, (d + 1) * width)] % width).tolist()
            have = set(items[d])
            items[d] += [x for i in np.unique(np.concatenate([tests.lists[x] for x in lists])).tolist() if (x := tests.ids[i]) not in have]
        best, where = (earlier[c].to_numpy(zero_copy_only=False).copy() for c in ("longest_match", "longest_at"))
        top = np.lexsort((position, -length, doc))
        top = top[np.unique(doc[top], return_index=True)[1]]
        top = top[length[top] > best[doc[top]]]
        best[doc[top]], where[doc[top]] = length[top], position[top] - words.bounds[doc[top]]
        new = [pa.array(words.counts.astype(np.int64)), _positions(hit, words.bounds, earlier["hit_words"]), pa.array(items, type=pa.list_(pa.string())), pa.array(best), pa.array(where)]
        yield batch.set_column(batch.schema.get_field_index(result), result, pa.StructArray.from_arrays(new, RESULTS))


def covered_by(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    steps = np.bincount(starts, minlength=n + 1).astype(np.int64) - np.bincount(starts + sizes, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def _positions(hit: np.ndarray, bounds: np.ndarray, earlier: pa.Array) -> pa.Array:
    """Per document the positions of its hit words, those of earlier passes included."""
    counts = pa.compute.list_value_length(earlier).to_numpy()
    hit[np.repeat(bounds[:-1], counts) + earlier.flatten().to_numpy()] = True
    at = np.flatnonzero(hit)
    ends = np.searchsorted(at, bounds)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((at - np.repeat(bounds[:-1], np.diff(ends))).astype(np.int32)))


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[pa.Table]:
    """The test items in blocks of at most block_bytes of text, one longer item alone."""
    sized = items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("item").isNotNull())
    blocks = int(sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * 2 // block_bytes + 1
    if blocks == 1:
        yield sized.toArrow()
        return
    # a hash deals the items to blocks of half that size on average; what exceeds it is cut again
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    for b in range(blocks):
        table, at = dealt.where(F.col("block") == b).drop("block").toArrow(), 0
        while at < table.num_rows:
            size, end = 0, at
            while end < table.num_rows and (end == at or size <= block_bytes):
                size += len(table.column("text")[end].as_py().encode())
                end += 1
            yield table.slice(at, end - at)
            at = end


def _with_result(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id: str, item_text: str, block_bytes: int) -> tuple[DataFrame, str]:
    """docs, all columns, with the results in one more column, and that column's name, which none of docs has."""
    spark, result = docs.sparkSession, "contamination"
    while result.lower() in (c.lower() for c in docs.columns):
        result += "_"
    start = "named_struct('n_words', 0L, 'hit_words', array(), 'items', array(), 'longest_match', 0L, 'longest_at', -1L)"
    out = docs.withColumn(result, F.expr(start).cast(RESULT))
    schema, kept = out.schema, None
    for f in schema.fields:
        f.nullable = True
    for block in item_blocks(benchmark, item_id, item_text, block_bytes):
        if kept is not None:  # not the first block: the passes before it end here
            out, old = keep(out, "contamination"), kept
            if old is not docs:
                discard(old)
            kept = out
        else:
            kept = docs
        sent = spark.sparkContext.broadcast(TestSet(block.column("item").to_pylist(), block.column("text").combine_chunks()).plain())
        out = out.mapInArrow(lambda batches, sent=sent: _scan(batches, TestSet.of(sent.value), text_col, result), schema)
    return out, result


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns but ones named like the results, with per row:

    n_words, hit_words (positions of words inside occurrences of test windows),
    items (ids, as text, of items with such windows), longest_match (words of
    the longest verbatim match that holds a window; 0 if no window occurs) and
    longest_at (its first word; -1 if none).  A null text has no words.  Items
    without words, or without an id, match nothing.  Repeated rows are scanned
    one by one.  decontaminate() keeps columns named like the results.
    """
    out, result = _with_result(docs, benchmark, text_col, item_id, item_text, block_bytes)
    names = [c.lower() for c in RESULTS]
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in names), f"{result}.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all its columns as they are, without the rows that hold a test window."""
    out, result = _with_result(docs, benchmark, text_col, item_id, item_text, block_bytes)
    return out.where(F.size(f"{result}.hit_words") == 0).drop(result)
