"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Null text is encoded as the empty text: no ids, no bytes. Repeated rows give repeated results; an
empty table gives an empty one. Other columns pass through; a column named like an output is replaced.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import python_stage, table

#: Texts of more code points are split at safe boundaries before encoding.
SPLIT_CHARS = 1 << 16
#: No match of the pattern spans an ASCII letter, digit or full stop followed by a space or newline:
#: only its white-space branches hold white space past their first character, and they hold nothing else.
SAFE = re.compile(r"(?<=[A-Za-z0-9.])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """text in pieces of size code points or slightly more, cut only where no match of the pattern is cut."""
    pieces, start = [], 0
    while len(text) - start > size and (cut := SAFE.search(text, start + size)):
        pieces.append(text[start : cut.start()])
        start = cut.start()
    return [*pieces, text[start:]]


def encode_text(text: str | None, rank_file: str, pattern: str) -> bytes:
    """The ids of text, packed as little-endian unsigned 32-bit integers."""
    enc = encoding(rank_file, pattern)
    return b"".join(np.array(enc.encode_ordinary(p), "<u4").tobytes() for p in safe_pieces(text or ""))


def decode_ids(packed: bytes | None, rank_file: str, pattern: str) -> bytes:
    """The bytes of packed ids, which need not be valid UTF-8."""
    return encoding(rank_file, pattern).decode_bytes(np.frombuffer(packed or b"", "<u4").tolist())


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with ids (binary: packed little-endian unsigned 32-bit) and n_tokens."""
    df = python_stage(docs, [text_col], "ids binary", lambda t: (encode_text(t, rank_file, pattern),))
    return df.withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def encode_checked(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """encode() with round_trip: whether the ids decode to the bytes of the text. One pass, so the decoded bytes never leave it."""

    def one(text: str | None) -> tuple:
        ids = encode_text(text, rank_file, pattern)
        return ids, decode_ids(ids, rank_file, pattern) == (text or "").encode("utf-8", "replace")

    return python_stage(docs, [text_col], "ids binary, round_trip boolean", one).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded (binary): the raw bytes of its ids."""
    return python_stage(df, [ids_col], "decoded binary", lambda b: (decode_ids(b, rank_file, pattern),))


def op5_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    rank_file = rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), rank_file, pattern)
    both = decode(ids.select("doc_id", "n_tokens", "ids"), rank_file, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
