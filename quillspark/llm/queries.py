"""The queries of the ten operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from quillspark.llm import bpe, chat, decontaminate, fingerprint, pii, quality, simhash, substring, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_chat_perspectives": chat.op2_chat_perspectives,
    "op3_fingerprints": fingerprint.op3_fingerprints,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_simhash": simhash.op6_simhash,
    "op7_pii": pii.op7_pii,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality": quality.op9_quality,
    "op10_warc": warc.op10_warc,
}
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": decontaminate.ORACLE, "op2_chat_perspectives": chat.ORACLE, "op10_warc": warc.ORACLE}
