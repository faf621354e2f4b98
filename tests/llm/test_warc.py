import base64
import hashlib
import io

import duckdb
import pytest

from quillspark.llm import warc
from tests.llm.util import frame, tables

SCHEMA = "page_id bigint, url string, html string, page string"
ROWS = [
    (5, "http://a.example/x y\r\nHost: evil", "WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n\r\n", "p"), (3, None, "same", "p"), (9, "https://b.example/", "same", "p"), (2, "u", None, "p"), (4, "u", "", "p"),
    (7, "u", "é漢😀" * 3000, "p"), (8, "u", "twice", "p"), (8, "u", "twice", "p"), (None, "u", "same", "p"), (None, "u", "alone", "p"),
]


def want(rows, min_bytes=0):
    data = [(r[0], (r[2] or "").encode()) for r in rows]
    out = []
    for page, payload in data:
        first = min((p for p, x in data if x == payload and p is not None), default=None)
        several = sum(x == payload for _, x in data) > 1 and len(payload) >= min_bytes
        again = several and first is not None and (page is None or page > first)
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    got = warc.op10_warc(spark, tables(spark, tmp_path, pages=frame(spark, ROWS, SCHEMA)))
    assert sorted(map(tuple, got.collect()), key=str) == want(ROWS)


@pytest.mark.parametrize("min_bytes", [1, 5])
def test_small_payloads_are_never_revisits(spark, tmp_path, min_bytes):
    path = f"{tmp_path}/w"
    warc.write_archives(frame(spark, ROWS, SCHEMA), path, min_bytes)
    got = warc.assemble(warc.read_archives(spark, path)).selectExpr("metadata.page_id", "response.payload_length", "response.payload_digest", "response.record_type", "CAST(regexp_extract(response.refers_to, 'capture:([0-9]+):', 1) AS bigint)")
    assert sorted(map(tuple, got.collect()), key=str) == want(ROWS, min_bytes)


def test_transactions_hold_all_records(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.write_archives(frame(spark, ROWS, SCHEMA), path)
    records = warc.read_archives(spark, path)
    assert records.count() == 3 * len(ROWS)
    rows = warc.assemble(records).collect()
    assert len(rows) == len(ROWS) and all(r["request"]["record_id"] and r["response"]["record_id"] == r["capture_id"] and r["metadata"]["record_id"] for r in rows)
    by = {r["metadata"]["page_id"]: r["response"] for r in rows}
    assert bytes(by[5]["payload"]).decode() == ROWS[0][2] and by[9]["payload"] is None and "\n" not in by[5]["target_uri"]


def test_rows_that_agree_in_page_and_payload_keep_their_urls(spark, tmp_path):
    rows = [(1, "http://a", "x"), (1, "http://b", "x"), (1, "http://b", "x"), (2, "http://a", "x"), (None, "http://c", "x"), (None, "http://c", "x"), (3, "http://d", "y" * 70_000), (3, None, "y" * 70_000)]
    path = f"{tmp_path}/w"
    warc.write_archives(frame(spark, [(*r, "p") for r in rows], SCHEMA), path)
    records = warc.read_archives(spark, path)
    ids = [r["record_id"] for r in records.select("record_id").collect()]
    assert len(ids) == len(set(ids)) == 3 * len(rows)
    got = warc.assemble(records).collect()
    assert sorted((str(r["metadata"]["page_id"]), r["response"]["target_uri"], r["request"]["target_uri"], r["response"]["payload_length"]) for r in got) == sorted((str(p), u or "", u or "", len(h)) for p, u, h in rows)
    known = {r["capture_id"]: r for r in got}
    revisits = [r for r in got if r["response"]["record_type"] == "revisit"]
    assert len(revisits) == 3 and all(known[r["response"]["refers_to"]]["metadata"]["page_id"] == 1 for r in revisits)


def test_very_long_pages(spark, tmp_path):
    rows = [(1, "u", "é<p>" * 3_000_000, "p"), (2, "u", "é<p>" * 3_000_000, "p"), (3, "u", "WARC/1.1\r\n" * 100_000, "p")]
    got = warc.op10_warc(spark, tables(spark, tmp_path, pages=frame(spark, rows, SCHEMA)))
    assert sorted(map(tuple, got.collect()), key=str) == want(rows)


def test_many_copies_of_one_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 7)
    got = warc.op10_warc(spark, tables(spark, tmp_path, pages=frame(spark, [(4, "u", "same", "p")] * 60 + [(5, "u", "same", "p")], SCHEMA))).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == sorted([(4, "response", None)] * 60 + [(5, "revisit", 4)], key=str)


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", ((10, 3), (100, 2), (1 << 31, 1)))
    rows = [(i, "u", "a" * (i % 3 * 60) + str(i), "p") for i in range(30)]
    path = f"{tmp_path}/w"
    warc.write_archives(frame(spark, rows, SCHEMA).coalesce(1), path)
    assert [len(list((tmp_path / "w" / f"class-{i}").glob("*.gz"))) for i in range(3)] == [4, 5, 10]
    assert warc.assemble(warc.read_archives(spark, path)).count() == 30


def test_cut_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(b"HTTP/1.1 200 OK\r\n")))


def test_empty_table(spark, tmp_path):
    assert warc.op10_warc(spark, tables(spark, tmp_path, pages=frame(spark, [], SCHEMA))).count() == 0


def test_payloads_that_nobody_reads_are_not_shuffled(spark, small):
    plan = warc.op10_warc(spark, small)._jdf.queryExecution().executedPlan().toString()
    keys = [x for x in plan.splitlines() if "Aggregate(key=" in x]
    assert keys and not any("THEN payload#" in x for x in keys)


def test_sql_agrees(spark, small):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{small}/pages.parquet'")
    sql = con.sql("select page_id, payload_bytes, payload_digest, record_type, refers_to from (" + warc.ORACLE + ")").fetchall()
    assert sorted(sql) == sorted(map(tuple, warc.op10_warc(spark, small).collect()))
