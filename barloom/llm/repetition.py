"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, all positions of an Arrow batch at
once in numpy, give for every document the characters inside n-grams that it
holds twice or more, and inside lines that repeat an earlier line.  Hashes only
find what may be equal: words and lines are compared by their bytes, n-grams by
their words.  One pass, no shuffle; a task holds one piece of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LINE, NON_BLANK, Spans, byte_table, covered, flat, gram_starts, per_doc, pieces, repeated_grams

#: N-gram length and the largest share of word characters inside repeated n-grams.
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines, and of their characters, in lines equal to an earlier one.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20
SYMBOLS = b"#*$%&|<>"
PIECE = 4 << 20


def _measures(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    symbol = byte_table(SYMBOLS)
    for batch in pieces(batches, "text", PIECE):
        data, offsets = flat(batch.column("text"))
        words = Spans(data, offsets, NON_BLANK)
        head = (data & 0xC0) != 0x80
        chars_to = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(head & words.inside, out=chars_to[1:])
        word_chars = chars_to[words.end] - chars_to[words.start]
        out = {
            "doc_id": batch.column("doc_id"),
            "n_words": words.counts,
            "word_chars": chars_to[offsets[1:]] - chars_to[offsets[:-1]],
            "n_symbols": per_doc(symbol[data], offsets),
        }
        lines = Spans(data, offsets, LINE)
        has_word = chars_to[lines.end] > chars_to[lines.start]
        line_chars = chars_to[lines.end] - chars_to[lines.start]
        key = lines.exact()[0] * max(len(offsets), 1) + lines.doc
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), dtype=bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        again &= has_word
        out["n_lines"] = per_doc(has_word, lines.bounds)
        out["n_dup_lines"] = per_doc(again, lines.bounds)
        out["dup_line_chars"] = per_doc(np.where(again, line_chars, 0), lines.bounds)

        codes, doc = words.exact()[0], words.doc
        for n in lengths:
            starts = gram_starts(words.bounds, n)
            inside = covered(starts[repeated_grams(codes, starts, n, doc)], n, len(words))
            if n == 5:
                out["n_repeat_words"] = per_doc(inside, words.bounds)
            out[f"dup{n}_chars"] = per_doc(np.where(inside, word_chars, 0), words.bounds)
        yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v.astype(np.int64)) for k, v in out.items()})


def repetition_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = tuple(GRAM_LIMITS)) -> DataFrame:
    """One row per input row: word, symbol, line and repetition counts of the whole text.

    A null or empty text has all counts 0.  Rows are measured one by one, so
    repeated rows and null ids come back as they are; other columns are not read.
    """
    lengths = tuple(sorted({5, *lengths}))
    order = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars"]
    order += [x for n in lengths for x in (["n_repeat_words"] if n == 5 else []) + [f"dup{n}_chars"]]
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(lambda batches: _measures(batches, lengths), "doc_id long, " + ", ".join(f"{c} long" for c in order))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] | None = None) -> DataFrame:
    """Repetition measures with base_failed, and kept: no base rule and no coverage limit is broken.

    Base rules: fewer than 10 words, or over a fifth of the words inside
    repeated 5-word windows.  An empty or null text fails.
    """
    limits = limits or GRAM_LIMITS
    m = repetition_measures(docs, id_col, text_col, tuple(limits))
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    bad = (F.col("n_dup_lines") > F.col("n_lines") * LINE_LIMIT) | (F.col("dup_line_chars") > F.col("word_chars") * LINE_CHAR_LIMIT)
    for n, most in limits.items():
        bad |= F.col(f"dup{n}_chars") > F.col("word_chars") * most
    return m.withColumn("base_failed", base).withColumn("kept", ~(base | bad))
