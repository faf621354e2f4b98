import random
import re

import duckdb

from quillspark.llm import decontaminate
from tests.llm.util import EDGES, frame, tables

ITEM = " ".join(f"item{i} word" for i in range(20))
ITEMS = [(1, ITEM), (2, "only three words"), (3, None), (4, ""), (5, "Case, and PUNCTUATION don't count here at all!"), (5, "Case, and PUNCTUATION don't count here at all!"), (None, ITEM), (6, "one")]


def rows():
    w = ITEM.split()
    filler = [f"f{i}" for i in range(3000)]
    return [
        *EDGES, (20, " ".join(filler[:2000] + w + filler[2000:])), (21, " ".join(filler + w[:34])), (22, " ".join(filler + w[:10])), (23, "x only three words y"), (24, "CASE and punctuation, don't: count here at ALL"), (25, " ".join([*w, *filler, *w])),
    ]


def run_sql(con, query):
    return sorted(con.sql(f"select doc_id, item_id, matched, size, containment from ({query})").fetchall())


def test_query_agrees_with_sql(spark, tmp_path):
    got = decontaminate.op1_decontaminate(spark, tables(spark, tmp_path, documents=frame(spark, rows()), benchmark=frame(spark, ITEMS, "item_id bigint, text string")))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    pairs = sorted(map(tuple, got.collect()))
    assert pairs == [p for p in run_sql(con, decontaminate.ORACLE) if p[0] is not None and p[1] is not None]
    assert {(20, 1), (21, 1), (25, 1), (23, 2), (24, 5), (4, 6)} == {p[:2] for p in pairs}


def test_sketches_miss_nothing_at_the_threshold(spark):
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n + 4))) for n in range(1, 70)]
    known = decontaminate.index(frame(spark, items, "item_id bigint, text string")).collect()
    for n, _ in items:
        mine = [r for r in known if r["item_id"] == n]
        missing, largest = (int(size * (1 - decontaminate.THRESHOLD) + 1e-6) for size in (n, (1 << n.bit_length()) - 1))
        assert len(mine) == n and sum(r["sketched"] for r in mine) == min(n, 2 * largest + 1)
        # whatever is missing, no more than the sketch may lack is
        assert {r["least"] for r in mine} == {min(n, 2 * largest + 1) - missing} and mine[0]["least"] >= 1


def test_the_sketch_lessens_candidates(spark):
    rng, items = random.Random(7), [(n, " ".join(f"i{n}w{j}" for j in range(44))) for n in range(30)]
    docs, want = [], set()
    for d in range(120):
        n = rng.randrange(30)
        kept = rng.choice([6, 10, 20, 36, 40, 44])
        docs.append((d, " ".join(["x"] * 9 + items[n][1].split()[:kept] + ["y"] * 9)))
        if max(0, kept - 4) >= 0.8 * 40:
            want.add((d, n))
    docs, items = frame(spark, docs), frame(spark, items, "item_id bigint, text string")
    met = {tuple(r) for r in decontaminate.candidates(docs, decontaminate.index(items), [5]).collect()}
    assert {tuple(r[:2]) for r in decontaminate.contained(docs, items).collect()} == want <= met and len(met) < 110


def test_whole_words_of_any_length(spark):
    item = " ".join("w" * 40 + str(i) for i in range(9))
    docs = [(1, "a " + item + " b"), (2, "a " + " ".join("w" * 16 for _ in range(30)))]
    got = decontaminate.contained(frame(spark, docs), frame(spark, [(1, item)], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["matched"], r["size"]) for r in got] == [(1, 5, 5)]


def test_rows_without_or_with_shared_identifiers_are_checked(spark):
    docs = frame(spark, [(None, "a " + ITEM, "x"), (None, "clean text", "y"), (4, ITEM, "z"), (4, "clean text too", "w")], "doc_id bigint, text string, k string")
    assert sorted(r["k"] for r in decontaminate.decontaminate(docs, frame(spark, ITEMS, "item_id bigint, text string")).collect()) == ["w", "y"]


def test_shuffled_index_gives_the_same(spark, monkeypatch):
    docs, items = frame(spark, rows()), frame(spark, ITEMS, "item_id bigint, text string")
    want = sorted(map(tuple, decontaminate.contained(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, decontaminate.contained(docs, items).collect())) == want


def test_clean_documents_stay(spark):
    docs = frame(spark, [(k, t, "x") for k, t in rows()], "doc_id bigint, text string, item_id string")
    got = decontaminate.decontaminate(docs, frame(spark, ITEMS, "item_id bigint, text string"))
    assert got.columns == docs.columns and got.count() == len(rows()) - 6


def test_empty_tables(spark):
    none, some = frame(spark, [], "item_id bigint, text string"), frame(spark, ITEMS, "item_id bigint, text string")
    assert decontaminate.contained(frame(spark), none).count() == 0 == decontaminate.contained(frame(spark, []), some).count()


def test_no_python_in_the_plan(spark, small):
    plan = decontaminate.op1_decontaminate(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
