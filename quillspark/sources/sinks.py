"""Sinks: result tables, Markdown files, single JSON exports and crops."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillspark.functions.text import stem


def write_results(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Outcomes as a table; the writer commits whole runs."""
    rows.write.mode(mode).parquet(path)


def write_parts(path: str, parts: Iterable[str]) -> None:
    """One text file of these parts, replaced as a whole: a reader sees the old or the new one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=target.parent, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.writelines(parts)
        os.replace(temp, target)
    except BaseException:
        os.unlink(temp)
        raise


def write_json(path: str, value: object) -> None:
    """One JSON file, replaced as a whole."""
    write_parts(path, [json.dumps(value, ensure_ascii=False, indent=2)])


def export_results(rows: DataFrame, path: str, order: str = "doc_ord", body: str = "json", shape: str = "auto") -> None:
    """rows (doc_ord, name, json) as one file, in order: an array, a map by name, or (auto) a single result bare and several as a map.

    Rows come to the driver one partition at a time and are written as they come. Names that two rows share are an
    error where they would be keys. The file is replaced as a whole.
    """
    if shape not in ("auto", "array", "map"):
        raise ValueError(f"shape must be auto, array or map, not {shape!r}")
    if shape != "array":
        twice = [r["name"] for r in rows.groupBy("name").count().filter("count > 1").orderBy("name").limit(5).collect()]
        if twice:
            raise ValueError("results would overwrite each other: " + ", ".join(map(str, twice)))
    bare = shape == "auto" and rows.limit(2).count() == 1

    def parts() -> Iterator[str]:
        dump = lambda x, deep: json.dumps(json.loads(x), ensure_ascii=False, indent=2).replace("\n", "\n  " if deep else "\n")
        first, ends = True, ("[", "]") if shape == "array" else ("{", "}")
        for r in rows.orderBy(order, "name").select("name", body).toLocalIterator():
            if bare:
                yield dump(r[body], False)
                return
            key = "" if shape == "array" else json.dumps(str(r["name"]), ensure_ascii=False) + ": "
            yield (ends[0] if first else ",") + "\n  " + key + dump(r[body], True)
            first = False
        yield "".join(ends) if first else "\n" + ends[1]

    write_parts(path, parts())


def flattened(files: DataFrame) -> DataFrame:
    """files (path, ...) with name <stem>.md for one output folder; raises if two files would share a name."""
    named = files.withColumn("name", F.concat(stem("path"), F.lit(".md")))
    clash = named.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").limit(5).collect()
    if clash:
        raise ValueError("files would overwrite each other: " + ", ".join(r["name"] for r in clash))
    return named


def write_each(rows: DataFrame, folder: str, name_col: str, content_col: str) -> DataFrame:
    """(name, path, error) after writing each row's text or bytes to a file of its own, on a folder that all executors share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                target = Path(folder) / name
                try:
                    target.parent.mkdir(parents=True, exist_ok=True)
                    temp = target.with_name(f".{target.name}.{os.getpid()}.tmp")
                    temp.write_bytes(content.encode() if isinstance(content, str) else bytes(content))
                    os.replace(temp, target)
                    out.append((name, str(target), None))
                except OSError as e:
                    out.append((name, None, str(e)))
            yield pd.DataFrame(out, columns=["name", "path", "error"])

    return rows.select(F.col(name_col).alias("name"), F.col(content_col).alias("content")).mapInPandas(run, "name string, path string, error string")


def write_crops(crops: DataFrame, folder: str, cut: Callable[[bytes, tuple[int, int, int, int]], bytes]) -> DataFrame:
    """crops (file_name, content, crop_left, crop_top, crop_right, crop_bottom), each cut by cut and written to its name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            box = pdf[["crop_left", "crop_top", "crop_right", "crop_bottom"]].itertuples(index=False)
            yield pd.DataFrame({"name": pdf["file_name"], "content": [cut(bytes(c), tuple(map(int, b))) for c, b in zip(pdf["content"], box, strict=True)]})

    return write_each(crops.mapInPandas(run, "name string, content binary"), folder, "name", "content")
