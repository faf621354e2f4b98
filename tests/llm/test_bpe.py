import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from quillspark.llm import bpe
from tests.llm.util import EDGES, frame, tables

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
PLAIN = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1. \n\t'sé漢!", max_size=60), st.integers(1, 9))
def test_pieces_are_safe(text, size):
    pieces = bpe.safe_pieces(text, size)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in PLAIN.encode_ordinary(p)] == PLAIN.encode_ordinary(text)


def test_edges_round_trip(spark):
    ids = bpe.encode(frame(spark), FILE, PATTERN)
    for r in bpe.decode(ids, FILE, PATTERN).collect():
        want = PLAIN.encode_ordinary(r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_invalid_utf8_stays_bytes():
    one = np.array([RANKS[b"\xc3"]], "<u4").tobytes()
    assert bpe.decode_ids(one, FILE, PATTERN) == b"\xc3"


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "hi", "old", "x")], "doc_id bigint, text string, ids string, extra string")
    got = bpe.encode(df, FILE, PATTERN)
    assert got.columns == ["doc_id", "text", "extra", "ids", "n_tokens"] and got.first()["n_tokens"] == 1
    assert bpe.encode(frame(spark, []), FILE, PATTERN).count() == 0


def test_query(spark, tmp_path):
    got = bpe.op5_byte_bpe(spark, tables(spark, tmp_path, documents=frame(spark))).collect()
    assert len(got) == len(EDGES)
    texts = {k: t or "" for k, t in EDGES}
    for r in got:
        text = texts[r["doc_id"]]
        ids = PLAIN.encode_ordinary(text)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_tokens"] == len(ids)
