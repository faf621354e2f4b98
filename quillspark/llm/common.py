"""What the operators of this folder share: table access, shared storage, Python stages and skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

#: Rows a group may hold before it counts as hot, as a share of all rows: at most 1 / HOT_SHARE keys can pass it, so a table of hot keys has a proven bound.
HOT_SHARE = 1 / 2000
#: Rows of text that one Arrow batch of a Python stage may return, by characters.
BATCH_CHARS = 2_000_000
#: Most rows and bytes of an Arrow batch that Spark hands to a Python stage of texts, where the session sets none itself.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Whether a DataFrame's shuffle files go when its action ends (Spark 4.1; it decides as the DataFrame is made).
BRIEF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """DataFrames made inside lose their shuffle files as their action ends, for results that are kept elsewhere.

    Else the files stay until the driver happens to collect its garbage; with many partitions those of a few hundred
    small shuffles, each of three files a task, outgrow the data. A DataFrame that runs again makes its files anew.
    """
    before = spark.conf.get(BRIEF, "false")
    spark.conf.set(BRIEF, "true")
    try:
        yield
    finally:
        spark.conf.set(BRIEF, before)


def totals(df: DataFrame, *columns: Column) -> Row:
    """The one row of aggregates over df."""
    with brief_shuffles(df.sparkSession):
        return df.agg(*columns).first()


def count(df: DataFrame) -> int:
    return totals(df, F.count("*"))[0]


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: it cuts lineage and outlives executors, and needs no shuffle files any more."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    with brief_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a DataFrame of its own, since df may run again


def _set_by_user(spark: SparkSession) -> set[str]:
    """Those of the ARROW settings that the session has already."""
    return ARROW.keys() & spark.conf.getAll.keys()


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that the session hands to Python, where it sets no bound itself; both sides of the pipe hold whole batches."""
    for key in ARROW.keys() - _set_by_user(spark):
        spark.conf.set(key, ARROW[key])


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """(__row, __whole) of every row of docs, a number of its own in the order of id_col and the row as a structure; and whether the numbers are the identifiers.

    Identifiers that are all there and unique are the numbers. Otherwise the rows are written once to the shared
    folder, ordered by identifier (nulls last) and a hash of the text, and numbered as they lie there, so that
    numbers stay the same in every later stage; rows that agree in both are salted over partitions.
    """
    spark = docs.sparkSession
    id_ = F.col(f"`{id_col}`")
    whole = docs.select(id_.cast("long").alias("__row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__whole"))
    with brief_shuffles(spark):
        unique = whole.groupBy("__row").count().filter("count > 1 or __row is null").isEmpty()
    if unique:
        return whole, True
    order = [F.col("__row").asc_nulls_last(), F.col("__text"), F.col("__salt")]
    marked = whole.select("__row", F.xxhash64(F.col(f"__whole.`{text_col}`")).alias("__text"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)).alias("__salt"), "__whole")
    dealt = marked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    path = shared_dir(spark, "rows")
    with brief_shuffles(spark):
        dealt.select(F.monotonically_increasing_id().alias("__row"), "__whole").write.parquet(path)
    return spark.read.parquet(path), False


def python_stage(df: DataFrame, inputs: list[str], outputs: str, fn: Callable[..., tuple]) -> DataFrame:
    """Append the columns of the DDL string outputs, computed row by row by fn(*inputs) in Arrow batches of bounded size.

    Other columns pass through unread. A column of df that has the name of an output is replaced.
    """
    bound_batches(df.sparkSession)
    out = T._parse_datatype_string(outputs)
    kept = [c for c in df.columns if c not in out.names]
    mark = "__in"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    hidden = [f"{mark}{i}" for i in range(len(inputs))]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(h) for c, h in zip(inputs, hidden, strict=True)])
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *out.fields])
    n_kept, n_out = len(kept), len(out.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in out.fields]

        def flush(batch: pa.RecordBatch, start: int, rows: list[tuple]) -> pa.RecordBatch:
            part = batch.slice(start, len(rows))
            new = [pa.array([r[i] for r in rows], type=kinds[i]) for i in range(n_out)]
            return pa.RecordBatch.from_arrays([*part.columns[:n_kept], *new], names=schema.names)

        for batch in batches:
            cols = batch.columns[n_kept:]
            start, rows, chars = 0, [], 0
            for i in range(batch.num_rows):
                args = [c[i].as_py() for c in cols]
                rows.append(fn(*args))
                chars += sum(len(a) for a in args if isinstance(a, (str, bytes)))
                if chars >= BATCH_CHARS:
                    yield flush(batch, start, rows)
                    start, rows, chars = i + 1, [], 0
            if rows:
                yield flush(batch, start, rows)

    return source.mapInArrow(run, schema)


def hot_keys(counts: DataFrame, total: int, count_col: str = "n") -> DataFrame:
    """Of a table of keys and their counts, those with more than HOT_SHARE of total rows: fewer than 1 / HOT_SHARE of them."""
    return counts.filter(F.col(count_col) > F.lit(max(64, int(total * HOT_SHARE))))
