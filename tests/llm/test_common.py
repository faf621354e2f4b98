import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import common
from quillspark.llm.components import lookup
from quillspark.llm.simhash import drop_near_duplicates
from tests.llm.util import frame, tables


def test_unique_identifiers_are_the_numbers(spark):
    keyed, plain = common.row_keys(frame(spark, [(7, "b"), (3, None)]))
    assert plain and sorted((r["__row"], r["__whole"]["text"]) for r in keyed.collect()) == [(3, None), (7, "b")]


def test_rows_get_numbers_in_order_of_identifiers(spark):
    rows = [(5, "a", "1"), (5, "b", "2"), (5, "b", "3"), (None, "z", "4"), (None, "z", "4"), (2, "c", "5"), (9, None, "6")]
    keyed, plain = common.row_keys(frame(spark, rows, "doc_id bigint, text string, __row string"))
    got = keyed.select("__row", "__whole.*").toDF("n", "doc_id", "text", "own").collect()
    assert not plain and len({r["n"] for r in got}) == len(rows)
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["n"])]
    assert ordered == [2, 5, 5, 5, 9, None, None]
    assert sorted((str(r["doc_id"]), str(r["text"]), r["own"]) for r in got) == sorted((str(k), str(t), x) for k, t, x in rows)
    assert sorted(r["__row"] for r in keyed.collect()) == sorted(r["n"] for r in got)  # the same each time


def test_stages_keep_columns_of_any_name(spark):
    df = frame(spark, [(1, "ab", "x", "y")], "doc_id bigint, text string, __in0 string, __in_ string")
    got = common.python_stage(df, ["text"], "n int", lambda t: (len(t),))
    assert got.columns == ["doc_id", "text", "__in0", "__in_", "n"] and tuple(got.first()) == (1, "ab", "x", "y", 2)


def test_settings_of_the_session_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "77")
        common.python_stage(frame(spark, [(1, "a")]), ["text"], "n int", lambda t: (1,)).collect()
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, before)


def shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    every = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.blockManager().diskBlockManager().getAllFiles())
    return {name for f in every if (name := f.getName()).startswith("shuffle_")}


def left_over(spark, before):
    """Shuffle files made since; they are removed in the background."""
    end = time.time() + 3
    while (found := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    return found


def test_checkpoints_and_totals_leave_no_shuffle_files(spark):
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    before, set_to = shuffle_files(spark), spark.conf.get(common.BRIEF, "false")
    kept = common.checkpoint(df)
    assert common.count(df) == 10 and tuple(common.totals(df, F.sum("n"), F.max("k"))) == (1000, 9)
    assert not left_over(spark, before)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect())) == [(k, 100) for k in range(10)]
    assert sorted(map(tuple, common.checkpoint(df).collect())) == sorted(map(tuple, df.collect()))  # df may run before and after
    assert spark.conf.get(common.BRIEF, "false") == set_to


def test_near_dedup_leaves_no_shuffle_files_of_its_steps(spark):
    texts = [" ".join(f"{i // 3}w{j}" for j in range(300 + i % 3)) for i in range(30)]
    docs, before = frame(spark, list(enumerate(texts))), shuffle_files(spark)
    kept = drop_near_duplicates(docs)
    assert not left_over(spark, before)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 30, 3))


def test_written_rows_and_stages_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    sf = tables(spark, tmp_path, documents=frame(spark, [(5, "a"), (5, "b"), (None, "a")]))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"dealt {i}", lambda spark, docs, sf_dir: docs.repartition(3, "text")) for i in range(2)])
    before = shuffle_files(spark)
    keyed, plain = common.row_keys(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = corpus_pipeline.run(spark, sf)
    assert not left_over(spark, before)
    assert not plain and keyed.count() == docs.count() == 3


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(), "x")


def test_lookup_of_hot_keys(spark):
    rows = frame(spark, [(1, i) for i in range(500)] + [(i, i) for i in range(2, 60)], "k bigint, spread bigint")
    values = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("spread").alias("most")).filter("k % 2 = 1")
    got = {r["k"]: r["most"] for r in lookup(rows, "k", values, 558, "spread").collect()}
    assert got == {1: 499, **{i: i if i % 2 else None for i in range(2, 60)}}
