import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import fingerprint
from tests.llm.util import EDGES, frame, tables


def plain_winnow(hashes, window=fingerprint.WINDOW):
    """(place, hash) of each window's least hash, the rightmost of ties, each once; fewer hashes are one window."""
    out = []
    for i in range(max(min(len(hashes), 1), len(hashes) - window + 1)):
        at = min(range(i, min(len(hashes), i + window)), key=lambda j: (hashes[j], -j))
        if not out or out[-1][0] != at:
            out.append((at, hashes[at]))
    return out


def plain_kgrams(token_hashes, k=fingerprint.K):
    """Each k-gram's hash from the one before: the first token leaves, the next one comes."""
    out, high = [], pow(fingerprint.BASE, k - 1, fingerprint.PRIME)
    for i in range(len(token_hashes) - k + 1):
        if i:
            out.append(((out[-1] - token_hashes[i - 1] * high) * fingerprint.BASE + token_hashes[i + k - 1]) % fingerprint.PRIME)
        else:
            out.append(sum(h * pow(fingerprint.BASE, k - 1 - j, fingerprint.PRIME) for j, h in enumerate(token_hashes[:k])) % fingerprint.PRIME)
    return out


def plain_fingerprint(text):
    pieces = re.findall(r"[^\W_]{1,3}", text.lower())
    small = lambda s: xxhash64_signed(s) % fingerprint.PRIME
    hashes = [small(p) for p in pieces]
    if len(hashes) >= fingerprint.K:
        grams = plain_kgrams(hashes)
    elif hashes:
        grams = [small(" ".join(map(str, hashes)))]
    else:
        grams = [small(text.strip(" "))] if text.strip(" ") else []
    return plain_winnow(grams)


def xxhash64_signed(s):
    h = xxhash.xxh64_intdigest(s.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def plain_likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_winnow_is_brute_force(spark):
    rows = [(i, [(x * 7919) % m for x in range(n)]) for i, (n, m) in enumerate([(0, 2), (1, 2), (7, 5), (8, 3), (9, 1), (64, 1), (200, 11), (300, 1 << 20)])]
    df = frame(spark, rows, "i int, h array<bigint>")
    for r in df.select("i", fingerprint.written(fingerprint.winnow(F.col("h"))).alias("w")).collect():
        assert r["w"] == ",".join(f"{h:08x}@{at}" for at, h in plain_winnow(rows[r["i"]][1]))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6, 7])
def test_kgrams_roll(spark, k):
    h = [(x * 48271 + 11) % fingerprint.PRIME for x in range(40)]
    got = frame(spark, [(h,)], "h array<bigint>").select(fingerprint._rolled(F.col("h"), k)).first()[0]
    assert got == plain_kgrams(h, k)


def test_places_count_beyond_24_bits(spark):
    places = [0, (1 << 24) - 1, 1 << 24, (1 << 31) - 2]
    entries = frame(spark, [([(5 << fingerprint.PLACE_BITS) | (fingerprint.LAST - p) for p in places],)], "e array<bigint>")
    assert entries.select(fingerprint.written(F.col("e"))).first()[0] == ",".join(f"00000005@{p}" for p in places)


def words(seed, n):
    return " ".join(hashlib.md5(f"{seed}.{i}".encode()).hexdigest()[: 3 + i % 6] for i in range(n))


def test_shared_runs_share_a_hash(spark):
    shared = words("s", 14)
    df = frame(spark, [(1, words("a", 120) + " " + shared + " " + words("b", 30)), (2, words("c", 60) + " " + shared + " " + words("d", 200)), (3, words("e", 200))])
    got = {r["doc_id"]: set(r["h"]) for r in df.select("doc_id", fingerprint.hashes_of(fingerprint.fingerprint(F.col("text"))).alias("h")).collect()}
    assert got[1] & got[2] and not got[1] & got[3]


def plain_query(rows):
    """The rows in order of doc_id, descending, each with the next one's beginning; rows are unique by doc_id or equal."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        own, other, after = (plain_fingerprint(x) for x in (t, edited, nxt))
        said = lambda p: ",".join(f"{x:08x}@{at}" for at, x in p)
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), said(own), said(other), plain_likeness(own, other), plain_likeness(own, after)))
    return sorted(out, key=str)


def test_rows_that_share_an_identifier_are_all_there(spark, tmp_path):
    rows = [(i % 3 if i % 4 else None, words(i, 5 + i % 40)) for i in range(900)]
    got = fingerprint.op3_fingerprints(spark, tables(spark, tmp_path, documents=frame(spark, rows))).collect()
    assert sorted(((r["doc_id"], r["n_chars"]) for r in got), key=str) == sorted(((k, len(t)) for k, t in rows), key=str)
    assert all(r["near_edited"] is not None and r["near_next"] is not None for r in got)


def test_query_edges(spark, tmp_path):
    got = fingerprint.op3_fingerprints(spark, tables(spark, tmp_path, documents=frame(spark))).collect()
    assert sorted(map(tuple, got), key=str) == plain_query(EDGES)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[6]["fingerprint"] == by[7]["fingerprint"] and by[1]["fingerprint"] == by[2]["fingerprint"] == ""
    assert by[7]["near_next"] == 1.0 and re.fullmatch("([0-9a-f]{8}@[0-9]+,?)+", by[5]["fingerprint"])


def test_sparse_identifiers_over_many_stretches(spark, tmp_path):
    rows = [(i**3 - 40_000_000, f"text {i} of many " * (i % 5)) for i in range(1000)]
    got = fingerprint.op3_fingerprints(spark, tables(spark, tmp_path, documents=frame(spark, rows))).collect()
    assert sorted(map(tuple, got), key=str) == plain_query(rows)


def test_small_tables_match_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, fingerprint.op3_fingerprints(spark, small).collect()), key=str) == plain_query(rows)


def test_empty_and_single_tables(spark, tmp_path):
    assert fingerprint.op3_fingerprints(spark, tables(spark, tmp_path / "a", documents=frame(spark, []))).count() == 0
    r = fingerprint.op3_fingerprints(spark, tables(spark, tmp_path / "b", documents=frame(spark, [(4, "abcd efgh")]))).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcd abcd").hexdigest()


def test_no_python_in_the_plan(spark, small):
    plan = fingerprint.op3_fingerprints(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange hashpartitioning") == 1
