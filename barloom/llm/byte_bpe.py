"""Byte-level BPE with a global shuffle of distinct words.

1.  Texts are cut into pre-tokens once, in blocks of bounded size.  Within a
    block each distinct word gets a number, frequent ones small numbers, and a
    text is the sequence of its numbers: its pre-tokens by position.  Both are
    stored in the shared folder, so later steps read the same rows whatever
    happens to executors.
2.  The words are exploded with their places, block and number, and shuffled by
    word.  A task meets all rows of a word in a row, encodes it once, and gives
    each row its ids: the join of the ids back to the words.  The ids leave a
    task packed by block.
3.  The ids are shuffled by block.  The stored texts are in buckets by block, so
    they stay where they are; a group puts the ids of its block in the places
    of their numbers.

A hot word is one row a block, not one row an occurrence.

Decoding joins the token-byte table.  It has one row an id of the vocabulary,
and its size is checked, so it is broadcast and joined inside the tasks, where
the tokens are: no shuffle of tokens by id.
"""

from __future__ import annotations

import base64
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release
from .shared import keep_by

#: Text bytes of a block; words in one stored row; text bytes from which pre-tokens are not listed at once.
BLOCK, LISTED, LONG_TEXT = 16 << 20, 1 << 14, 4 << 20
#: Texts that are packed together, those that a step holds at once, and words whose ids a task collects before it packs them.
PACKED, SLICE, COLLECTED = 512, 64, 1 << 19
#: A place is the name of a block and, in its low bits, a number there; a block's name is a partition and a number there.
NUMBER_BITS, BLOCK_BITS = 31, 10
#: Bytes that a vocabulary may have to be broadcast.
VOCABULARY = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a .tiktoken file."""
    if os.path.getsize(path) > VOCABULARY:
        raise ValueError(f"{path} is larger than {VOCABULARY} bytes")
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, for very long pre-tokens."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, len(parts[i]) + len(parts[i + 1])) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, size = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or len(parts[i]) + len(parts[j]) != size or ranks.get(parts[i] + parts[j]) != r:
            continue
        parts[i] += parts[j]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k, len(parts[k]) + len(parts[after[k]])))
    return [ranks[parts[i]] for i in range(n) if alive[i]]


#: The members of three character classes up to U+00FF.
LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}
#: The white space of Unicode, as tokenizers read it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitter(pattern: str):
    """Texts to pre-tokens.  Texts up to U+00FF use the pattern with its classes written out, which is much faster."""
    import regex

    def written(classes: dict[str, str]) -> str:
        def one(m: re.Match) -> str:
            item = m[0]
            if item[0] == "[":
                return re.sub(r"\\p\{[LN]\}|\\s", lambda x: classes.get(x[0], x[0]), item)
            return f"[^{classes[chr(92) + 's']}]" if item == r"\S" else f"[{classes[item]}]" if item in classes else item

        return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", one, pattern)

    general = regex.compile(written({r"\s": SPACE}))
    latin = written(LATIN)
    narrow = None if re.search(r"\\[pPwWdDbB]", latin) else re.compile(latin)

    def split(text: str) -> Iterable[str]:
        try:
            text.encode("latin-1")
            chosen = narrow or general
        except UnicodeEncodeError:
            chosen = general
        return chosen.findall(text) if len(text) < LONG_TEXT else (m[0] for m in chosen.finditer(text))

    return split


def planes(codes: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first; they are packed better so."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


class Block:
    """Pre-tokens of some texts: their distinct words, and the texts as sequences of the words' numbers."""

    def __init__(self):
        self.seen: dict[str, int] = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.ids, self.codes, self.bytes = [], [], 0

    def add(self, doc_id: int | None, words: Iterable[str], size: int) -> None:
        self.ids.append(doc_id)
        self.codes.append(np.fromiter(map(self.seen.__getitem__, words), dtype=np.uint32))
        self.bytes += size

    def rows(self, name: int, pack) -> Iterator[pa.RecordBatch]:
        words = [w.encode() for w in self.seen]
        every = np.concatenate([np.zeros(0, dtype=np.uint32), *self.codes])
        # frequent words first, equally frequent ones by their bytes: both pack better so
        place = np.empty(len(words), dtype=np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((place, -np.bincount(every, minlength=len(words))))
        number = np.empty(len(words), dtype=np.uint32)
        number[order] = np.arange(len(words), dtype=np.uint32)
        words = [words[i] for i in order.tolist()]
        lists = [words[i : i + LISTED] for i in range(0, len(words), LISTED)]
        n = len(lists)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([name] * n, type=pa.int64()), "first": pa.array(range(0, n * LISTED, LISTED), type=pa.int64()), "words": pa.array(lists, type=pa.list_(pa.binary())),
            "doc_ids": pa.nulls(n, pa.list_(pa.int64())), "codes": pa.nulls(n, pa.binary()), "is_text": pa.array([False] * n, type=pa.bool_()),
        })
        # texts are packed together: one by one they are too short for it
        parts = range(0, len(self.ids), PACKED)
        m = len(parts)
        packed = [pack(planes(np.array([len(c) for c in self.codes[i : i + PACKED]])) + planes(number[np.concatenate(self.codes[i : i + PACKED])])) for i in parts]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([name] * m, type=pa.int64()), "first": pa.array(parts, type=pa.int64()), "words": pa.nulls(m, pa.list_(pa.binary())),
            "doc_ids": pa.array([self.ids[i : i + PACKED] for i in parts], type=pa.list_(pa.int64())), "codes": pa.array(packed, type=pa.binary()), "is_text": pa.array([True] * m, type=pa.bool_()),
        })


BLOCK_SQL = "block long, first long, words array<binary>, doc_ids array<long>, codes binary, is_text boolean"


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    """Rows of words and rows of texts, block by block; a block is named by its partition and its number there."""
    import zstandard

    split, pack = splitter(pattern), zstandard.ZstdCompressor(level=3).compress
    block, name = Block(), TaskContext.get().partitionId() << BLOCK_BITS
    last = name + (1 << BLOCK_BITS) - 1  # takes what is left of a partition of more than 16 GB
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                block.add(doc_id, split(text) if text else (), len(text or ""))
                if block.bytes >= BLOCK and name < last:
                    yield from block.rows(name, pack)
                    block, name = Block(), name + 1
                    release()
    if block.ids:
        yield from block.rows(name, pack)
    block = None
    release()


def pack_ids(number: np.ndarray, size: np.ndarray, ids: bytes, pack) -> bytes:
    """Numbers of words, how many ids each has, and the ids."""
    order = np.argsort(number)
    first = np.cumsum(size) - size
    size = size[order]
    at = np.arange(int(size.sum())) + np.repeat(first[order] - (np.cumsum(size) - size), size)
    arrays = [np.diff(number[order], prepend=0), size, np.frombuffer(ids, dtype="<u4")[at]]
    return pack(len(number).to_bytes(4, "little") + b"".join(planes(x) for x in arrays))


def unpack_ids(packed: bytes, unpack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = unpack(packed)
    n = 4 * int.from_bytes(raw[:4], "little")
    return np.cumsum(from_planes(raw[4 : 4 + n]).astype(np.int64)), from_planes(raw[4 + n : 4 + 2 * n]).astype(np.int64), from_planes(raw[4 + 2 * n :])


def _encode(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The ids of all words, packed by block; rows come sorted by word, so each word is encoded once."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    last, last_ids = None, b""
    held, rows = [], 0

    def packed() -> pa.RecordBatch:
        block, number, size = (np.concatenate([h[i] for h in held]) for i in range(3))
        ids = b"".join(h[3] for h in held)
        ends = np.cumsum(size)
        order = np.argsort(block, kind="stable")
        names, first = np.unique(block[order], return_index=True)
        out, raw = [], np.frombuffer(ids, dtype="<u4")
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
            some = order[a:b]
            many = size[some]
            at = np.arange(int(many.sum())) + np.repeat(ends[some] - many - (np.cumsum(many) - many), many)
            out.append(pack_ids(number[some], many, raw[at].tobytes(), pack))
        held.clear()
        return pa.RecordBatch.from_pydict({"block": pa.array(names), "ids": pa.array(out, type=pa.binary())})

    for batch in batches:
        coded = pa.compute.dictionary_encode(batch.column("word"))
        words = coded.dictionary.to_pylist()
        ids = [last_ids if w == last else np.array(merge(w, ranks), dtype="<u4").tobytes() for w in words]
        if words:
            last, last_ids = words[-1], ids[-1]
        each = pa.array(ids, type=pa.large_binary()).take(coded.indices)
        place = np.array(batch.column("place"))
        held.append((place >> NUMBER_BITS, place & ((1 << NUMBER_BITS) - 1), pa.compute.binary_length(each).to_numpy() // 4, b"".join(each.to_pylist())))
        rows += batch.num_rows
        if rows >= COLLECTED:
            yield packed()
            rows = 0
            release()
    if held:
        yield packed()
    release()


def _assemble(texts: pa.Table, coded: pa.Table) -> pa.Table:
    """Put the ids of a block's words in the places of their numbers."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    parts = [unpack_ids(x, unpack) for x in coded.column("ids").to_pylist()]
    number, many, ids = (np.concatenate([np.zeros(0, dtype=np.int64), *(p[i] for p in parts)]) for i in range(3))
    size, first = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
    size[number], first[number] = many, np.cumsum(many) - many
    ids = ids.astype("<u4")
    out, doc_ids = [], []
    for owners, packed in zip(texts.column("doc_ids").to_pylist(), texts.column("codes").to_pylist(), strict=True):
        raw, n = unpack(packed), 4 * len(owners)
        lengths, codes = from_planes(raw[:n]), from_planes(raw[n:])
        count = size[codes]
        at = np.arange(int(count.sum())) + np.repeat(first[codes] - (np.cumsum(count) - count), count)
        every = ids[at]
        ends = np.append(0, np.cumsum(count))[np.cumsum(lengths)].tolist()
        out += [every[a:b].tobytes() for a, b in zip([0, *ends], ends)]
        doc_ids += owners
    release()
    return pa.table({"doc_id": pa.array(doc_ids, type=pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in out], type=pa.int64()), "ids": pa.array(out, type=pa.binary())})


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens and ids (little-endian unsigned 32-bit numbers end to end).

    vocabulary is the path of a .tiktoken file.  Each match of pattern is
    encoded on its own, without special tokens.  Null and empty texts have no
    tokens.  Rows are encoded one by one: ids may be null or repeated; other
    columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = keep_by(texts.mapInArrow(lambda batches: _blocks(batches, pattern), BLOCK_SQL), "block", "blocks")
    words = blocks.where(~F.col("is_text")).select("block", "first", F.posexplode("words").alias("n", "word"))
    words = words.select("word", (F.shiftleft("block", NUMBER_BITS) + F.col("first") + F.col("n")).alias("place"))
    coded = words.repartition("word").sortWithinPartitions("word").mapInArrow(lambda batches: _encode(batches, sent.value), "block long, ids binary")
    sequences = blocks.where("is_text").select("block", "doc_ids", "codes")
    return sequences.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assemble, "doc_id long, n_tokens long, ids binary")


def token_bytes(spark: SparkSession, vocabulary: str) -> DataFrame:
    """The token-byte table (id, bytes) of a vocabulary."""
    ranks = read_ranks(vocabulary)
    return spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), type=pa.int64()), "bytes": pa.array(ranks.keys(), type=pa.binary())}))


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """tokens, all columns but one named decoded, with decoded: the bytes of the ids in the column ids, null ids being none.

    The token-byte table is broadcast (a vocabulary is of bounded size, which
    read_ranks checks) and joined by id inside the tasks; the bytes are put
    together by position.  An id outside the table fails the task.
    """
    rows = token_bytes(tokens.sparkSession, vocabulary).toArrow()
    table = dict(zip(rows.column("id").to_pylist(), rows.column("bytes").to_pylist(), strict=True))
    sent = tokens.sparkSession.sparkContext.broadcast(table)
    tokens = tokens.drop("decoded")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = sent.value.__getitem__
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                out = [b"".join(map(look, np.frombuffer(x, dtype="<u4").tolist())) for x in part.column("ids").fill_null(b"").to_pylist()]
                yield part.append_column("decoded", pa.array(out, type=pa.binary()))
            release()

    return tokens.mapInArrow(join, tokens.withColumn("decoded", F.lit(b"")).schema)
