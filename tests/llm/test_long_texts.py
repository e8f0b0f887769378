"""Texts that repeat a keyword or a notice very often are scanned in time that grows with their length."""

from __future__ import annotations

import base64
import json
import time

import pytest

from barloom.llm import licences, secret_scan


def token(header: dict) -> str:
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return f"{part(json.dumps(header).encode())}.{part(b'payload')}.{part(b'signature')}"


def seconds(f):
    began = time.time()
    out = f()
    return time.time() - began, out


@pytest.mark.parametrize("word", [*secret_scan.KEYWORDS, "eyJ", "AKIA", "-----BEGIN ", "-----BEGIN A", "token=", "token  ", "eyJa.", "eyJ.eyJ", "password\"", "secret: '", "0123456789abcdef "])
def test_every_keyword_a_hundred_thousand_times(word):
    took, _ = seconds(lambda: secret_scan.find(word * 100_000, secret_scan.automaton()))
    assert took < 5


def test_megabytes_of_starts():
    took, found = seconds(lambda: secret_scan.find("eyJ" * 1_400_000 + " " + token({"alg": "none"}), secret_scan.automaton()))
    assert took < 20 and [k for k, *_ in found] == ["json_token"]


def test_a_header_with_a_certificate_chain():
    long, short = token({"alg": "RS256", "x5c": ["MII" + "A" * 6000]}), token({"alg": "RS256"})
    assert [(k, a) for k, a, _ in secret_scan.find(f"{long} {short}", secret_scan.automaton())] == [("json_token", 0), ("json_token", len(long) + 1)]
    assert secret_scan.find(token({"kid": "x" * 9000}), secret_scan.automaton()) == []
    deep = base64.urlsafe_b64encode(('{"alg":' + "[" * 100_000).encode()).decode().rstrip("=")
    assert secret_scan.find(f"{deep}.a.b", secret_scan.automaton()) == []


def test_notice_files(spark):
    """Thousands of notices in one text, with and without the sentence that completes a rule."""
    two = "\n\n".join(licences.SENTENCES[i] for i in ("bsd-grant", "bsd-source", "bsd-binary"))
    first = licences.SENTENCES["mit-grant"] + "\n\n" + licences.SENTENCES["mit-notice"]
    texts = [two + "\n\n", first + "\n\n", licences.SENTENCES["bsd-grant"] + "\n\n", licences.SENTENCES["reserved"] + ".\n"]
    df = spark.createDataFrame([(i, t * 2000) for i, t in enumerate(texts)], "doc_id long, text string")
    took, found = seconds(lambda: {r.doc_id: (len(r.sentence_ids), r.licences) for r in licences.scan_licences(df).collect()})
    assert took < 60
    assert found == {0: (6000, ["BSD-2-Clause"]), 1: (4000, []), 2: (2000, []), 3: (2000, ["proprietary"])}


def test_rules_want_their_order(spark):
    s = licences.SENTENCES
    say = lambda *ids: "\n\n".join(s[i] for i in ids)
    texts = [say("bsd-source", "bsd-grant", "bsd-binary"), say("bsd-grant", "reserved", "bsd-source", "bsd-grant", "bsd-binary"), say("bsd-binary", "bsd-grant", "bsd-source"), say("bsd-grant", "bsd-binary", "bsd-source", "bsd-binary", "bsd-name")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.licences for r in licences.scan_licences(df).collect()}
    assert found == {0: [], 1: ["BSD-2-Clause", "proprietary"], 2: [], 3: ["BSD-3-Clause", "BSD-2-Clause"]}
