import hashlib
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from quillspark.llm import pii
from tests.llm.util import EDGES, frame, tables

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    def ok(kind, s):
        d = [int(c) for c in s if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m[0])]


def base(text):
    return [s for s in pii.spans_of(text) if s[0] in pii.BASE]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+0149 ()é%", max_size=50))
def test_base_spans_are_the_patterns(text):
    assert base(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4242 4242 4242 4242", "4242-4242-4242-4242", "10.0.0.1", "a.b@c.de", "+1 (555) 010-7788", " ", ".", "7", "-", "x", "@", "+"]), max_size=8))
def test_base_spans_of_joined_pieces(parts):
    text = "".join(parts)
    assert base(text) == plain(text)


@pytest.mark.parametrize("piece", ["a", "a@", "1", "1.", "1 ", "+1", "+1(", "AA11 ", "account ", "account 1", "token=", "http://", "http://a:", "a@b.", ".", "12.34.56.78."])
def test_long_texts_take_time_in_proportion(piece):
    text = (piece * (5_000_000 // len(piece) + 1))[:5_000_000] + "@"
    start = time.perf_counter()
    pii.spans_of(text)
    assert time.perf_counter() - start < 40


@pytest.mark.parametrize("piece", ["a", "a@", "1", "1.", "1 ", "+1", "+1(", "a@b.", "12.34.56.78.", "9-", "a@b.c@d."])
def test_long_runs_are_the_patterns(piece):
    text = (piece * 700)[:700] + "@x.yz"
    assert base(text) == plain(text)


def plain_iban(text):
    """The longest valid IBAN from each place on, none inside another."""
    out, last = [], 0
    for m in re.finditer(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))", text):
        for n in range(len(m[1]), 14, -1):
            bare = m[1][:n].replace(" ", "")
            if m[1][n - 1] != " " and len(bare) >= 15 and m.start() >= last and not text[m.start() + n : m.start() + n + 1].isalnum() and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                out.append(("iban", m.start(), m.start() + n))
                last = m.start() + n
                break
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", " ", "A", "1", "AA11 ", "."]), max_size=7))
def test_ibans(parts):
    text = "".join(parts)
    assert [s for s in pii.spans_of(text) if s[0] == "iban"] == plain_iban(text)


def test_added_kinds():
    text = 'see https://bob:pw@host.example/x iban GB82 WEST 1234 5698 7654 32 account no. AB-123456, token = "0123456789abcdef0123"'
    kinds = {k: text[s:e] for k, s, e in pii.spans_of(text)}
    assert kinds["url"] == "bob:pw@host.example" and kinds["iban"] == "GB82 WEST 1234 5698 7654 32"
    assert kinds["account"] == "AB-123456" and kinds["secret"] == "0123456789abcdef0123"
    assert not [s for s in pii.spans_of("the account of this token is long, GB00 WEST 1234 5698 7654 32") if s[0] != "card"]


def test_redaction():
    text = "mail a@b.co now"
    assert pii.redacted(text, pii.spans_of(text)) == "mail [EMAIL] now"
    assert pii.redacted(None, []) is None


def test_query_edges(spark, tmp_path):
    rows = [*EDGES, (20, "x@y.zz 1.2.3.4"), (21, "ẞ İ x@y.zz")]
    got = pii.op7_pii(spark, tables(spark, tmp_path, documents=frame(spark, rows))).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        spans = plain(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
    assert pii.find_pii(frame(spark, []), redact=True).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co", "old")], "doc_id bigint, text string, pii string")
    assert pii.find_pii(df).first()["pii"][0]["kind"] == "email"
