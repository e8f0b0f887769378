"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
digits, address schemes and account cues.  Small deterministic parsers expand
each anchor to the left and right and validate what they find.  No parser
backtracks beyond its own run, so a text costs time linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

PIECE = 4 << 20
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds to the base: addresses with a scheme, and account numbers after a cue.
KINDS = (*BASE_KINDS, "address", "account")

SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9]++")
QUAD = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ADDRESS = re.compile(r"[^\s<>\"'()\[\]{}|]++")
ACCOUNT = re.compile(r"(?:[ \t]*(?:number|no|nr|num|n°|#|:|=|\.)){0,3}[ \t]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}|[0-9](?:[ -]?[0-9]){5,19})(?![A-Za-z0-9])", re.ASCII)
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for s in CUES:
        for form in {s, s.upper(), s.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def find(text: str, anchors) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by start, then kind; code points, end exclusive."""
    spans = []
    email_end = quad_from = card_end = phone_end = address_end = account_end = 0
    for last, (kind, length) in anchors.iter(text):
        p = last - length + 1
        if kind == "digit":
            if p >= quad_from:
                m = QUAD.match(text, p)
                if m:
                    quad_from = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")):
                        spans.append(("ip", p, m.end()))
                else:
                    quad_from = DIGITS.match(text, p).end()
            if p >= card_end:
                m = CARD.match(text, p)
                if m:
                    card_end = m.end()
                    if 12 <= m.end() - p <= 37:
                        digits = NOT_DIGIT.sub("", m[0])
                        if 12 <= len(digits) <= 19 and luhn(digits):
                            spans.append(("card", p, card_end))
                else:
                    card_end = p + 1
        elif kind == "at":
            s = p
            while s > email_end and text[s - 1] in LOCAL:
                s -= 1
            if s < p and (m := DOMAIN.match(text, p + 1)):
                email_end = m.end()
                spans.append(("email", s, email_end))
        elif kind == "plus":
            if p >= phone_end and (m := PHONE.match(text, p)):
                phone_end = m.end()
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    spans.append(("phone", p, phone_end))
        elif kind == "scheme":
            if p >= address_end and (m := ADDRESS.match(text, last + 1)):
                address_end = last + 1 + len(m[0].rstrip(".,;:!?"))
                if address_end > last + 1:
                    spans.append(("address", p, address_end))
        elif p >= account_end and (not p or not text[p - 1].isalnum()) and (m := ACCOUNT.match(text, last + 1)):
            value = m[1]
            if iban(value) if value[0].isalpha() else len(NOT_DIGIT.sub("", value)) >= 6:
                account_end = m.end(1)
                spans.append(("account", m.start(1), account_end))
    if len(spans) > 1:
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return spans


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones joined, replaced by the first one's kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPAN_SQL = "array<struct<kind:string,start:int,end:int>>"


def span_array(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], type=SPAN)


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans of every row, by start and kind.  A null text has none.

    Rows are scanned one by one: ids may be null or repeated, other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in pieces(batches, "text", PIECE):
            found = [find(t, anchors) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), span_array(found)], ["doc_id", "spans"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(scan, f"doc_id long, spans {SPAN_SQL}")


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, with personal data in text_col replaced by bracketed kinds; null texts stay null."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in pieces(batches, text_col, PIECE):
            i = batch.schema.get_field_index(text_col)
            texts = [redact(t, find(t, anchors)) if t else t for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, type=batch.schema.field(i).type))

    return docs.mapInArrow(clean, docs.schema)


def span_digest(spans: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *(count(k) for k in base), F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
