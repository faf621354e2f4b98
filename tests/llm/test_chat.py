import duckdb

from quillspark.llm import chat
from tests.llm.util import frame, tables

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string"
ROWS = [
    (1, 0, "system", "rules", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob|<x>", "yo\nthere", "x"), (1, 2, "bob|<x>", "yo\nthere", "x"), (1, 2, "ann", "tie", "x"), (1, 300, "cy", "late", "x"),
    (2, None, None, None, "x"), (2, 1, "assistant", "é😀", "x"), (3, 0, "system", "alone", "x"), (None, 0, "ann", "no id", "x"), (None, 1, "bob", "", "x"),
]


def test_query_agrees_with_sql(spark, tmp_path):
    got = chat.op2_chat_perspectives(spark, tables(spark, tmp_path, conversations=frame(spark, ROWS, SCHEMA)))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cols = ", ".join(got.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.sql(f"select {cols} from ({chat.ORACLE})").fetchall()))


def test_spans_are_the_speakers_words(spark):
    for r in chat.rotate(frame(spark, ROWS, SCHEMA)).collect():
        said = [r["rendered"][s["start"] : s["end"]] for s in r["spans"]]
        assert said == [m["content"] for m in r["messages"] if m["name"] == r["perspective"]]
        assert all(m["role"] == ("assistant" if m["mask"] else "system" if m["name"] == "system" else "user") for m in r["messages"])


def test_parts_make_the_whole(spark):
    rows = [(1, i, f"p{i % 3}", f"t{i}", "") for i in range(1000)]
    whole = {r["perspective"]: r["rendered"] for r in chat.rotate(frame(spark, rows, SCHEMA), max_turns=10_000).collect()}
    parts: dict = {}
    for r in sorted(chat.rotate(frame(spark, rows, SCHEMA)).collect(), key=lambda r: r["part"]):
        parts[r["perspective"]] = parts.get(r["perspective"], "") + r["rendered"]
    assert parts == whole and len(whole) == 3


def test_names_stay_apart(spark):
    names = ["a|b", "a<b", "a_b", "a%7Cb", "a\nb", "a\rb", "a>b"]
    rows = [(1, i, n, "hi", "") for i, n in enumerate(names)] + [(1, 9, "me", "yo", "")]
    got = [r for r in chat.rotate(frame(spark, rows, SCHEMA)).collect() if r["perspective"] == "me"]
    tags = [x for x in got[0]["rendered"].split("\n") if x.startswith("<|user")]
    assert len(set(tags)) == len(names) and all(t.startswith("<|user name=a") and t.endswith("|>") and t.count("|") == 2 for t in tags)


def test_later_parts_know_the_context(spark):
    rows = [(1, 0, "system", "rules", ""), (1, 400, "system", "later rules", "")] + [(1, i, f"p{i % 2}", f"t{i}", "") for i in range(1, 600)]
    got = chat.rotate(frame(spark, rows, SCHEMA)).collect()
    assert {r["part"] for r in got} == {0, 1, 2} and {r["context"] for r in got} == {"rules"}


def test_empty_and_null_conversations_are_two(spark):
    rows = [("", 0, "ann", "x", ""), (None, 0, "bob", "y", "")]
    got = {(r["conv_id"], r["perspective"]) for r in chat.rotate(frame(spark, rows, SCHEMA.replace("conv_id bigint", "conv_id string"))).collect()}
    assert got == {("", "ann"), (None, "bob")}


def test_large_parts_are_dealt_in_pieces(spark):
    rows = [(None, None, f"p{i % 3}", f"t{i % 50:03d}", "") for i in range(900)] + [(1, 1, "ann", "hi", "")] + [(2, 7, "bob", "same", "")] * 300
    df = frame(spark, rows, SCHEMA)
    got = chat.rotate(df, max_turns=16).collect()
    assert max(len(r["messages"]) for r in got) <= 64
    whole = {(r["conv_id"], r["perspective"]): r["rendered"] for r in chat.rotate(df, max_turns=100_000).collect()}
    parts: dict = {}
    for r in sorted(got, key=lambda r: (r["part"], r["piece"])):
        k = (r["conv_id"], r["perspective"])
        parts[k] = parts.get(k, "") + r["rendered"]
    assert parts == whole and len(whole) == 5


def test_empty_table(spark):
    assert chat.rotate(frame(spark, [], SCHEMA)).count() == 0
