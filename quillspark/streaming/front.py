"""A streaming front for batch stages: new files are processed once, exactly, by document and step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...], max_files: int = 1000) -> DataFrame:
    """A stream of the files that appear in folder."""
    both = ",".join(c for s in suffixes for c in (s, s.upper()))
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", f"*.{{{both}}}").option("maxFilesPerTrigger", max_files).load(folder)


def process_stream(files: DataFrame, batch: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run batch on each micro-batch and keep its rows under the batch's number: a repeated batch replaces itself."""

    def write(rows: DataFrame, number: int) -> None:
        batch(rows, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, key: str = "path") -> DataFrame:
    """Of each key the row of its last batch."""
    rows = spark.read.parquet(out)
    cols = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])
