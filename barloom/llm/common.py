"""Vectorised text primitives shared by the operators.

All of them work on one Arrow batch of texts as a flat UTF-8 byte buffer with
document offsets, so a task's memory is bounded by the piece size it asks for.
Every separator used by the word definitions is ASCII, which makes splitting
the bytes the same as splitting the characters.
"""

from __future__ import annotations

import ctypes
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: blank and the five ASCII white-space controls.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
GRAM = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def digest_of(text: bytes) -> bytes:
    """A name of a text that no other text has."""
    return hashlib.blake2b(text, digest_size=16).digest()


def byte_table(word_bytes: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(word_bytes, dtype=np.uint8)] = True
    return table


#: Words are everything but blanks.
NON_BLANK = ~byte_table(BLANKS)
#: Words are ASCII letters and digits and everything beyond ASCII, after A-Z became a-z.
ALNUM_WIDE = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Whole lines.
LINE = ~byte_table(b"\n")

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def release() -> None:
    """Give freed memory back to the system: a worker stays for the tasks that come after."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def pieces(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slice batches so that the texts of a slice stay under max_bytes, one longer text alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = batch.column(text).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(sizes.buffers()[1], dtype=np.int64, count=n + 1 + sizes.offset)[sizes.offset :]
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            end = min(n, max(end, at + 1))
            yield batch.slice(at, end - at)
            at = end
        release()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and n + 1 offsets; a null text is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Spans:
    """Maximal runs of word bytes: start, end, and per document the range of runs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        n = len(data)
        inside = table[data]
        edge = np.zeros(n + 2, dtype=np.int8)
        edge[1:-1] = inside
        before, after = edge[:-2].copy(), edge[2:].copy()
        firsts = offsets[:-1]
        before[firsts[firsts < n]] = 0
        lasts = offsets[1:] - 1
        after[lasts[lasts >= 0]] = 0
        self.data, self.offsets, self.inside = data, offsets, inside
        self.start = np.flatnonzero(inside & (before == 0))
        self.end = np.flatnonzero(inside & (after == 0)) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self._words8 = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each run, eight bytes a step; long runs are digested one by one.

        Equal runs have equal hashes.  Where unequal ones must not count as
        equal, exact() or same() compare the bytes.
        """
        out = mix((self.end - self.start).astype(np.uint64) + np.uint64((seed + 1) * int(GOLDEN) % (1 << 64)))
        for runs, chunk in self._chunks(np.arange(len(self))):
            out[runs] = mix((out[runs] ^ chunk) * GRAM + GOLDEN)
        raw = self.data.tobytes() if (self.end - self.start > LONG).any() else b""
        for i in np.flatnonzero(self.end - self.start > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(raw[self.start[i] : self.end[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
        return out

    def _chunks(self, runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For eight bytes at a time: the runs of at most LONG bytes that go on, and these bytes, 0 after the end."""
        size = (self.end - self.start)[runs]
        runs, size = runs[size <= LONG], size[size <= LONG]
        at = 0
        while len(runs):
            rest = np.minimum(size - at, 8)
            yield runs, self.words8[self.start[runs] + at] & FIRST[rest]
            at += 8
            runs, size = runs[size > at], size[size > at]

    @property
    def words8(self) -> np.ndarray:
        """The eight bytes from every position on, as one number."""
        if self._words8 is None:
            padded = np.concatenate((self.data, np.zeros(8, dtype=np.uint8)))
            self._words8 = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        return self._words8

    def same(self, mine: np.ndarray, other: Spans, theirs: np.ndarray) -> np.ndarray:
        """Whether run mine[i] has the bytes of run theirs[i] of other."""
        size = self.end[mine] - self.start[mine]
        good = size == other.end[theirs] - other.start[theirs]
        left, at = np.flatnonzero(good & (size <= LONG)), 0
        while len(left):
            x = self.words8[self.start[mine[left]] + at] ^ other.words8[other.start[theirs[left]] + at]
            equal = (x & FIRST[np.minimum(size[left] - at, 8)]) == 0
            good[left[~equal]] = False
            at += 8
            left = left[equal]
            left = left[size[left] > at]
        for i in np.flatnonzero(good & (size > LONG)).tolist():
            a, b = self.start[mine[i]], other.start[theirs[i]]
            good[i] = bool((self.data[a : a + size[i]] == other.data[b : b + size[i]]).all())
        return good

    def exact(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Codes of the runs, equal exactly if their bytes are; the first run of each code; the seed of the hashes whose order they have."""
        for seed in itertools.count():
            hashes = self.hashes(seed)
            order = np.argsort(hashes)
            ranked = hashes[order]
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = ranked[1:] != ranked[:-1]
            first = order[np.flatnonzero(fresh)]
            codes = np.empty(len(order), dtype=np.int64)
            codes[order] = np.cumsum(fresh) - 1
            again = np.flatnonzero(first[codes] != np.arange(len(order)))
            if self.same(again, self, first[codes[again]]).all():
                return codes, first, seed


#: Bytes from which a run is digested on its own.
LONG = 256
#: The first n of eight bytes.
FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def coded(codes: np.ndarray, seed: int = 0) -> np.ndarray:
    """Well-mixed values of codes."""
    return mix(codes.astype(np.uint64) + np.uint64((seed + 1) * int(GOLDEN) % (1 << 64)))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values from every position at which n are left; they may cross documents."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out, have = None, 0
    part, size = words, 1
    left = n
    while left:
        if left & 1:
            if out is None:
                out, have = part, size
            else:
                keep = len(words) - have - size + 1
                out = out[:keep] + power(have) * part[have : have + keep]
                have += size
        left >>= 1
        if left:
            keep = len(part) - size
            part = part[:keep] + power(size) * part[size : size + keep]
            size *= 2
    return mix(out[: len(words) - n + 1] + np.uint64(n * int(GOLDEN) % (1 << 64)))


def power(k: int) -> np.uint64:
    return np.uint64(pow(int(GRAM), k, 1 << 64))


def gram_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Positions from which n words are left in their own document."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    at = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(bounds[:-1] - at, counts)


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive offsets."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size positions lie in [s, s + n) for some s of starts."""
    steps = np.bincount(starts, minlength=size + 1)[: size + 1].astype(np.int64)
    steps -= np.bincount(starts + n, minlength=size + 1)[: size + 1]
    return np.cumsum(steps)[:size] > 0


def covered_by(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of size positions lie in some [start, end)."""
    steps = np.bincount(starts, minlength=size + 1)[: size + 1].astype(np.int64)
    steps -= np.bincount(ends, minlength=size + 1)[: size + 1]
    return np.cumsum(steps)[:size] > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def repeated_grams(codes: np.ndarray, starts: np.ndarray, n: int, doc: np.ndarray) -> np.ndarray:
    """Which of the n-grams of codes from starts on occur at least twice in their document; hashes find them, the codes decide."""
    for seed in itertools.count():
        keys = gram_hashes(coded(codes, seed), n)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
        keys = mix(keys ^ mix(doc[starts].astype(np.uint64) + GOLDEN))
        twice = repeated(keys)
        some = np.flatnonzero(twice)
        some = some[np.argsort(keys[some])]
        pair = np.flatnonzero(keys[some[1:]] == keys[some[:-1]])
        a, b = starts[some[pair]], starts[some[pair + 1]]
        good = doc[a] == doc[b]
        for k in range(n):
            good &= codes[a + k] == codes[b + k]
        if good.all():
            return twice


def grams_of(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of the grams codes[s : s + size], equal exactly if the grams are."""
    number = np.where(sizes > 0, codes[np.minimum(starts, len(codes) - 1)] + 1, 0) if len(starts) else np.zeros(0, dtype=np.int64)
    width = int(codes.max(initial=0)) + 2
    for k in range(1, int(sizes.max(initial=0))):
        inside = sizes > k
        step = np.where(inside, codes[np.minimum(starts + k, len(codes) - 1)] + 1, 0)
        number = np.unique(number, return_inverse=True)[1] * width + step
    return np.unique(number, return_inverse=True)[1]
