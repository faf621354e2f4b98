import collections
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quillspark.llm import common, substring
from tests.llm.util import frame


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnoprstuéñ") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_gear_hash_by_definition():
    data = np.frombuffer(prose(1, 40).encode(), np.uint8)
    got = substring.gear_hashes(data)
    h = 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(substring.GEAR[b])) % (1 << 32)
        assert got[i] == h


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=800))
def test_chunks_cover_the_text(text):
    digest, start, end = substring.chunk_text(text)
    assert len(digest) == len(start) == len(end)
    assert "".join(text[s:e] for s, e in zip(start, end, strict=True)) == text


def test_insertions_move_only_near_cuts():
    text = prose(2, 2000)
    before = set(substring.chunk_text(text)[0])
    after = set(substring.chunk_text(text[:300] + "inserted words " + text[300:])[0])
    assert len(after - before) <= 6


def test_long_runs_are_cut():
    assert max(np.diff([0, *substring.cuts(np.zeros(100_000, np.uint8))])) <= substring.MAX_BYTES
    assert substring.cuts(np.zeros(0, np.uint8)) == []


def test_repeated_passages_of_51_words_are_found(spark):
    passage = [prose(100 + i, 51) for i in range(6)]
    rows = [(i, prose(i, 150) + "\n" + passage[i % 6] + " " + prose(1000 + i, 90), "x") for i in range(60)] + [(100 + i, prose(5000 + i, 200), "x") for i in range(60)]
    got = substring.repeated_spans(frame(spark, rows, "doc_id bigint, text string, start string")).collect()
    assert {r["doc_id"] for r in got} == set(range(6, 60))
    # at a passage's edge an earlier cut may hide a chunk from the first document, so a later one of the same passage may keep it
    assert all(o % 6 == r["doc_id"] % 6 and o < r["doc_id"] for r in got for o in r["first_doc_ids"])
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] in texts[r["doc_id"] % 6] for r in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, prose(7, 80)), (3, prose(7, 80)), (4, prose(7, 80)), (None, prose(7, 80)), (5, "short"), (6, prose(8, 60) + prose(8, 60))]
    df = frame(spark, rows)
    got = sorted((str(r["doc_id"]), tuple(r["first_doc_ids"])) for r in substring.repeated_spans(df).collect())
    assert got == [("3", (3,)), ("4", (3,)), ("6", (6,)), ("None", (3,))]
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in substring.remove_repeats(df).collect())
    assert [(k, t) for k, t in kept if k != "6"] == [("1", ""), ("2", ""), ("3", ""), ("3", prose(7, 80)), ("4", ""), ("5", "short"), ("None", "")]
    assert len(dict(kept)["6"]) < len(rows[-1][1])
    assert substring.repeated_spans(frame(spark, [])).count() == 0


def test_rows_that_share_an_identifier_are_cut_by_their_own_spans(spark):
    a, b, c = prose(70, 120), prose(71, 120), prose(72, 120)
    rows = [(1, a, "p"), (5, a, "q"), (5, a, "r"), (5, b, "s"), (None, c, "t"), (None, b, "u"), (9, c, "v")]
    df = frame(spark, rows, "doc_id bigint, text string, row string")
    assert {r["row"]: r["text"] for r in substring.remove_repeats(df).collect()} == {"p": a, "q": "", "r": "", "s": b, "t": "", "u": "", "v": c}
    spans = sorted((str(r["doc_id"]), r["start"], r["end"], tuple(r["first_doc_ids"])) for r in substring.repeated_spans(df).collect())
    assert spans == sorted([("5", 0, len(a), (1,)), ("5", 0, len(a), (1,)), ("None", 0, len(b), (5,)), ("None", 0, len(c), (9,))])


def plain_copies(texts):
    """Characters of each text in chunks that an earlier text, or an earlier place of it, holds."""
    seen, out = set(), {}
    for k in sorted(texts):
        out[k] = set()
        for d, s, e in zip(*substring.chunk_text(texts[k]), strict=True):
            if d in seen:
                out[k] |= set(range(s, e))
            seen.add(d)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_every_copied_chunk_counts_with_runs_of_one(spark, monkeypatch, hot):
    if hot:  # every digest of three chunks counts as hot and goes by broadcast
        monkeypatch.setattr(substring, "hot_keys", lambda counts, total: counts.filter("n > 2"))
    rng, pieces = random.Random(3), [prose(800 + i, rng_n) for i, rng_n in enumerate([6, 12, 20, 40] * 5)]
    texts = {i: " ".join(rng.sample(pieces, 4) + [prose(i, 30)]) + "the " * (50 * (i % 5 == 0)) for i in range(50)}
    got = {k: set() for k in texts}
    for r in substring.repeated_spans(frame(spark, list(texts.items())), 1).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
    want = plain_copies(texts)
    assert all(want[k] <= got[k] for k in texts) and any(want.values())
    # what lies beyond whole chunks stands in an owner's text as well
    whole = {k: {s + i for s in range(len(t)) for i in range(8) if any(t[s : s + 8] in texts[j] for j in texts if j < k) or t.find(t[s : s + 8]) < s} for k, t in texts.items()}
    assert all(got[k] - want[k] <= whole[k] for k in texts)


def test_runs_count_from_min_run(spark):
    a = prose(90, 200)
    df = frame(spark, [(1, a), (2, prose(91, 50) + a[300:450] + prose(92, 50))])
    n = [r["end"] - r["start"] for r in substring.repeated_spans(df, 1).collect()]
    assert len(n) == 1 and 150 <= n[0] <= 152
    assert substring.repeated_spans(df, n[0]).count() == 1 and substring.repeated_spans(df, n[0] + 1).count() == 0


def test_very_long_texts(spark):
    long_ = " ".join(f"w{i * 7919 % 999983}" for i in range(150_000))
    got = substring.repeated_spans(frame(spark, [(1, long_), (2, long_[500_000:900_000])])).collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in got] == [(2, 0, 400_000)]


def test_small_tables(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    holders = collections.defaultdict(set)
    for k, t in texts.items():
        w = t.split()
        for i in range(len(w) - 50):
            holders[tuple(w[i : i + 51])].add(k)
    late = {k for s in holders.values() if len(s) > 1 for k in s - {min(s)}}
    assert late <= {r["doc_id"] for r in substring.op4_substring_dedup(spark, small).collect()}


def test_passages_are_extended_beyond_their_chunks(spark):
    rows = []
    for i in range(40):
        passage = prose(900 + i, 22)
        rows += [(i, prose(i, 60) + " 1" + passage + "2 " + prose(300 + i, 60)), (100 + i, prose(400 + i, 70) + " 3" + passage + "4 " + prose(500 + i, 50))]
    texts = dict(rows)
    got = {r["doc_id"]: texts[r["doc_id"]][r["start"] : r["end"]] for r in substring.repeated_spans(frame(spark, rows)).collect()}
    whole = [i for i in range(40) if got.get(100 + i) == prose(900 + i, 22)]
    held = [i for i in range(40) if set(substring.chunk_text(texts[i])[0]) & set(substring.chunk_text(texts[100 + i])[0])]
    assert len(held) > 25 and whole == [i for i in held if len(prose(900 + i, 22)) >= substring.MIN_RUN]


def test_periodic_passages_are_found_at_any_offset(spark):
    rows = [(i, prose(i, 20 + i) + "\n" + "the " * 99 + "\n" + prose(50 + i, 30)) for i in range(8)]
    got = {r["doc_id"]: r["end"] - r["start"] for r in substring.repeated_spans(frame(spark, rows)).collect() if r["first_doc_ids"] != [r["doc_id"]]}
    assert set(range(1, 8)) <= set(got) and min(got.values()) >= 380


def test_recall_of_51_words_on_sf01(spark):
    path = Path("/root/testdata/sf0.1")
    if not path.is_dir():
        pytest.skip("no test tables here")
    first, late = {}, set()
    for k, t in sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()):
        w = t.split()
        late |= {k for i in range(len(w) - 50) if first.setdefault(hash(tuple(w[i : i + 51])), k) != k}
    assert late and late <= {r["doc_id"] for r in substring.op4_substring_dedup(spark, str(path)).collect()}


def test_texts_come_in_bounded_batches_in_a_new_session(spark):
    new = spark.newSession()  # its settings are Spark's own until an operator sets them
    rows = new.createDataFrame([(i, f"text {i}") for i in range(3)], "row bigint, text string")
    assert substring.chunks(rows).count() == 3
    assert {k: new.conf.get(k) for k in common.ARROW} == common.ARROW
