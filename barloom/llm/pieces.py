"""SentencePiece encoding and decoding of merge-type (BPE) models, without merging.

A blank is written as the mark ▁ and a text begins with one.  A text is cut
before a mark behind another character, as no piece of such a model has one
there (checked), and between two characters whose bytes meet in no piece:
merges never cross such a cut.  A task encodes each distinct segment of a batch
once, and remembers short ones.

A segment is encoded by backtracking.  An Aho-Corasick automaton gives the
pieces that begin at each character.  From the left the longest piece is taken
that is compatible with the one before: merging the characters of both again
must give just these two.  Where none is, the place is marked as failed in a
bitfield, the last piece is taken back, and a shorter one is tried.  A sequence
whose neighbours are all compatible is what merging gives, so the result is
exact, and no place fails twice.  Compatible pairs are remembered too.

A character that no piece has stands alone and becomes its bytes.  The mark of
a long run of blanks is shared by pieces of one score; the leftmost merge then
comes first, as for any pair.

Decoding joins the pieces' bytes inside the tasks: the table has one row an id.
No shuffle either way; a task holds one Arrow batch.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, flat, pieces

MARK = "▁"
PIECE = 4 << 20
#: Segments of at most so many characters are remembered, and so many of them, and so many pairs of pieces.
SHORT, REMEMBERED, PAIRS = 32, 1 << 18, 1 << 20
#: Fixed values of the model file's format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, OWN, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model files over this size are refused: the model goes to all executors.
LARGEST = 64 << 20


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, raw[at : at + size]
        at += size


class Model:
    """Pieces of a model file.  What encoding builds and remembers stays in the process."""

    def __init__(self, raw: bytes):
        if len(raw) > LARGEST:
            raise ValueError(f"a model of {len(raw)} bytes is too large to send to all executors")
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece.get(2, bytes(4)), dtype="<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif number in (2, 3):
                (trainer if number == 2 else normalizer).update(fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("only merge-type models with byte fallback and marks before words")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that leave texts as they are, but for marks")
        if any(k in (OWN, UNUSED) for k in self.kinds) or any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k == NORMAL):
            raise ValueError("pieces of its own or unused ones, or marks inside pieces")
        self.end = trainer.get(42, 2)
        self.meeting = np.zeros((256, 256), dtype=bool)
        for p, k in zip(self.pieces, self.kinds, strict=True):
            if k == NORMAL:
                each = np.frombuffer(p.encode(), dtype=np.uint8)
                self.meeting[each[:-1], each[1:]] = True
        self.unknown = self.kinds.index(UNKNOWN)
        self.surface = trainer.get(44, " ⁇ ".encode())
        # the last piece of a name counts, as of equal ones only one can be found
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.whole = [i for p, i in self.ids.items() if self.merged(p) == [p]]
        self._fresh()

    def _fresh(self) -> None:
        self.automaton, self.segments, self.pairs = None, {}, {}

    def plain(self) -> dict:
        """What is sent to the tasks: lists, arrays and numbers only, so that they need not know this class."""
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "segments", "pairs")}

    @classmethod
    def restored(cls, plain: dict) -> Model:
        """The model of plain(), which stays with it in a process, and so does what it remembers."""
        if "model" not in plain:
            model = cls.__new__(cls)
            model.__dict__.update(plain)
            model._fresh()
            plain["model"] = model
        return plain["model"]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the pair with the best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, place = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, place = self.scores[found], i
            if best is None:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces gives them again."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            known = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return known

    def segment(self, text: str) -> list[int]:
        """The ids of a segment."""
        known = self.segments.get(text)
        if known is None:
            known = self._backtracked(text)
            if len(text) <= SHORT:
                if len(self.segments) >= REMEMBERED:
                    self.segments.clear()
                self.segments[text] = known
        return known

    def _backtracked(self, text: str) -> list[int]:
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for i in self.whole:
                self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i])))
            self.automaton.make_automaton()
        n = len(text)
        begins: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, found in self.automaton.iter(text):
            begins[last + 1 - found[1]].append(found)  # shorter ones first
        failed = bytearray((n >> 3) + 1)
        taken: list[tuple[int, int, int]] = []  # where, which of the pieces there, id; -1 for a character without a piece
        pairs, at, before, choice = self.pairs, 0, -1, -1
        while at < n:
            options = begins[at]
            if choice == -1:
                choice = len(options) - 1
                if choice < 0:
                    taken.append((at, 0, -1))
                    at, before = at + 1, -1
                    continue
            while choice >= 0:
                found, size = options[choice]
                end = at + size
                if not failed[end >> 3] >> (end & 7) & 1 and (before < 0 or pairs.get((before, found)) or self.compatible(before, found)):
                    break
                choice -= 1
            if choice >= 0:
                taken.append((at, choice, found))
                at, before, choice = end, found, -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at, choice, _ = taken.pop()
                before = taken[-1][2] if taken else -1
                choice = choice - 1 if choice else -2
        out = []
        for where, _, i in taken:
            out.extend([i] if i >= 0 else [self.bytes[b] for b in text[where].encode()])
        return out

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each one's begin and end."""
        each = []
        for piece, kind in zip(self.pieces, self.kinds, strict=True):
            each.append({CONTROL: b"", UNKNOWN: self.surface, BYTE: bytes([int(piece[3:5], 16)]) if kind == BYTE else b""}.get(kind, piece.replace(MARK, " ").encode()))
        return np.frombuffer(b"".join(each), dtype=np.uint8), np.cumsum([0, *map(len, each)])


class Segments(Spans):
    """Texts cut before a mark behind another character, and between characters of which `meeting` has no bytes next to each other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, meeting: np.ndarray):
        mark = np.zeros(len(data) + 3, dtype=bool)
        a, b, c = np.frombuffer(MARK.encode(), dtype=np.uint8)
        if len(data) > 2:
            mark[3:-2] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
        cut = mark[3:] & ~mark[:-3]
        cut[1:] |= ((data[1:] & 0xC0) != 0x80) & ~meeting[data[:-1], data[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(cut)
        self.bounds = np.searchsorted(self.start, offsets)
        self.end = np.append(self.start[1:], len(data))[: len(self.start)]
        self._words8 = None


def _encoded(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = Model.restored(model.value)
    for batch in pieces(batches, "text", PIECE):
        marked = pc.replace_substring(batch.column("text").cast(pa.large_string()).fill_null(""), " ", MARK)
        marked = pc.if_else(pc.equal(pc.binary_length(marked), 0), marked, pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), marked, pa.scalar("", pa.large_string())))
        data, offsets = flat(marked)
        segments = Segments(data, offsets, model.meeting)
        codes, first, _ = segments.exact()
        raw = data.tobytes()
        ids = [model.segment(raw[a:b].decode()) for a, b in zip(segments.start[first].tolist(), segments.end[first].tolist(), strict=True)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat_ids = np.fromiter((i for each in ids for i in each), dtype=np.int32, count=int(sizes.sum()))
        begins, many = np.cumsum(sizes) - sizes, sizes[codes]
        upto = np.concatenate(([0], np.cumsum(many)))
        taken = flat_ids[np.arange(upto[-1]) + np.repeat(begins[codes] - upto[:-1], many)]
        ends = upto[segments.bounds[1:]] + np.arange(1, batch.num_rows + 1)
        out = np.full(len(taken) + batch.num_rows, model.end, dtype=np.int32)
        inside = np.ones(len(out), dtype=bool)
        inside[ends - 1] = False
        out[inside] = taken
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(out))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ids, those of the whole text as the library gives them, then the end id.

    A null or empty text has the end id alone.  Rows are taken one by one, so
    repeated rows and null ids come back as they are; other columns are not
    read.  A model that the method does not fit (other than merge-type, with
    normalising rules, without byte fallback) is refused.
    """
    with open(model, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(Model(file.read()).plain())
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(lambda batches: _encoded(batches, shared), "doc_id long, ids array<int>")


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


def _decoded(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    import codecs

    codecs.register_error("byte by byte", _one_by_one)
    data, bounds, silent, leads = table.value
    sizes = np.diff(bounds)
    for batch in batches:
        column = batch.column("ids")
        n = batch.num_rows
        ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes)):
            raise ValueError("an id that the model does not have")
        lists = np.concatenate(([0], np.cumsum(counts)))
        many = sizes[ids]
        upto = np.concatenate(([0], np.cumsum(many)))
        taken = data[np.arange(upto[-1]) + np.repeat(bounds[ids] - upto[:-1], many)].tobytes()
        heard = np.append(np.flatnonzero(~silent[ids]), len(ids))
        first = heard[np.searchsorted(heard, lists[:-1])]
        breaks = upto[np.flatnonzero(silent[ids])]
        texts = []
        for k in range(n):
            a, b = upto[lists[k]], upto[lists[k + 1]]
            if first[k] < lists[k + 1] and leads[ids[first[k]]]:  # the mark that each text begins with
                a += 1
            # bytes on both sides of a silent id are no character
            at = [a, *breaks[np.searchsorted(breaks, a, "right") : np.searchsorted(breaks, b)].tolist(), b]
            texts.append("".join(taken[x:y].decode("utf-8", "byte by byte") for x, y in itertools.pairwise(at)))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """tokens (doc_id, ids) with decoded, the text that the ids stand for.

    Begin and end ids give nothing, and the blank before the first piece goes.
    A byte that is part of no character becomes U+FFFD.  Null ids give an empty
    text; an id that the model does not have, a null one included, is an error.
    """
    with open(model, "rb") as file:
        read = Model(file.read())
    silent = np.array([k == CONTROL for k in read.kinds])
    leads = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(read.pieces, read.kinds, strict=True)])
    table = tokens.sparkSession.sparkContext.broadcast((*read.token_bytes(), silent, leads))
    return tokens.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, table), "doc_id long, ids array<int>, decoded string")
