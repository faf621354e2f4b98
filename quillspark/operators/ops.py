"""Stopping work: jobs are tagged, and a tag stops all of them on every executor."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside carry tag."""
    sc = spark.sparkContext
    sc.addJobTag(tag)
    try:
        yield
    finally:
        sc.removeJobTag(tag)


def stop(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
