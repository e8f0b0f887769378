"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions at hits, checksum validation.

A text is searched once for all keywords, without regard to letter case.  Only
where one ends are expressions tried, anchored at its start.  Hexadecimal
values have no keyword; their anchor is a run of 16 such digits.  Kinds with
a check inside (CRC in the token, a JSON header) count only if it holds.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .pii import PIECE, SPAN_SQL, span_array

BASE_KINDS = ("assign", "access", "hex")
#: Added kinds: prefixed tokens with a CRC-32 in their last six base-62 digits, signed JSON tokens, private key blocks.
KINDS = (*BASE_KINDS, "crc_token", "json_token", "private_key")

#: Keywords, in lower case, and the kind that each leads to.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "crc_token", "gho_": "crc_token", "ghu_": "crc_token", "ghs_": "crc_token", "ghr_": "crc_token", "npm_": "crc_token",
    "eyj": "json_token",
    "-----begin": "private_key",
}

ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}+")
CRC = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+")
PART = re.compile(r"[A-Za-z0-9_-]+")
KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_holds(body: str) -> bool:
    """Whether the last six characters are the CRC-32 of the others in base 62."""
    value = 0
    for c in body[-6:]:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body[:-6].encode())


def header_holds(part: str) -> bool:
    """Whether the part is a JSON object with an "alg", however long; too deep or malformed ones do not count."""
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError, TypeError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def find(text: str, keywords) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by start, then kind; code points, end exclusive."""
    spans = []
    ends = dict.fromkeys(KINDS, 0)
    # bytes.lower() changes A-Z alone, so positions in the folded text are those of the text
    for last, (kind, length) in keywords.iter(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
        p = last - length + 1
        if p < ends[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, p)
            good = m and len(m[1]) >= 12
        elif kind == "access":
            m = ACCESS.match(text, p)
            good = m and m.end() - p >= 18
        elif kind == "crc_token":
            m = CRC.match(text, p)
            good = m and crc_holds(m[1])
        elif kind == "json_token":
            m = JWT.match(text, p)
            good = m and header_holds(m[1])
            if not m:  # what follows this run fails the later starts in it too
                ends[kind] = PART.match(text, p).end()
        else:
            good = m = KEY.match(text, p)
        if m:
            ends[kind] = m.end()
        if good:
            spans.append((kind, p, m.end()))
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if len(spans) > 1:
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return spans


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans of every row, by start and kind.  A null text has none.

    Rows are scanned one by one: ids may be null or repeated, other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in pieces(batches, "text", PIECE):
            found = [find(t, keywords) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), span_array(found)], ["doc_id", "spans"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(scan, f"doc_id long, spans {SPAN_SQL}")
