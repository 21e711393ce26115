"""Lanes may be cut anywhere, and the contract's columns equal a count with regexes."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from tests.llm.test_text_operators import base_spans
from tidewell.llm import secret_scan


def whole(scanner, data):
    """Match ends by one reader, byte by byte."""
    state, out = 0, []
    for i, b in enumerate(data.tolist()):
        got = int(scanner.step[state * scanner.dfa.n_classes + int(scanner.dfa.classes[b])])
        if got >> 20:
            out.append((i, got >> 20))
        state = got & ((1 << 20) - 1)
    return out


def test_lanes_agree_with_one_reader():
    scanner, rng = secret_scan.compile_rules(), random.Random(2)
    parts = [b"token", b"=", b": ", b" ", b'"', b"AKIA", b"0123456789abcdef", b"word ", b"-----BEGIN PRIVATE KEY-----\n", b"A" * 700, b"f" * 900, b" " * 600, b"a: b\n", b"\n\n", "é".encode(), b"\xff"]
    for _ in range(25):
        data = np.frombuffer(b"".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) + b"\xff", dtype=np.uint8)
        at, bits = secret_scan.ends_of(scanner, data)
        assert list(zip(at.tolist(), bits.tolist())) == whole(scanner, data)


@pytest.mark.parametrize("text", [b"plain words without a stop " * 40_000, b"password=" + b"A" * 1_000_000, b"-----BEGIN PRIVATE KEY-----\n" + b"A" * 1_000_000, b"secret" + b" " * 1_000_000])
def test_a_megabyte_without_a_stop_is_fast(text):
    scanner = secret_scan.compile_rules()
    start = time.process_time()
    secret_scan.scan_texts(scanner, [text])
    assert time.process_time() - start < 3


def test_rule_syntax():
    rng = random.Random(3)
    for pattern in (r"a(?:b|cd)+[x-z]{2,}", r"(?i:k)e\x20?[^a-y\n]+", r"\.{2}-(q|r(?:s|t))*u+", r"[\]\-a]+"):
        scanner = secret_scan.compile_rules((("r", pattern, 0, 0),))
        for _ in range(300):
            text = "".join(rng.choice("abcdexyzKkqrstu .-]\n") for _ in range(30))
            got = [(s, e) for _, s, e in secret_scan.scan_texts(scanner, [text.encode()])[0]]
            assert got == [m.span() for m in re.finditer(pattern, text)], (pattern, text)
    for bad in ("a(b", "a)b", "a^", "a{1", "[ab"):
        with pytest.raises(ValueError):
            secret_scan.parse_rule(bad)


def test_digest_of_the_documents_table_equals_regexes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = secret_scan.digest(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        base = base_spans(texts[r["doc_id"]])
        names = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")] == names
