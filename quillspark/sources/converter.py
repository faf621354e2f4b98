"""Document conversion as a pluggable partition-level stage: file bytes to positioned items.

A converter is a factory, called once per worker process, of a function from (path, content) to items
(label, text, page_no, l, t, r, b). A file that fails gives one row with its error.
"""

from __future__ import annotations

import functools
import importlib
import inspect
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Item = tuple[str, str | None, int | None, float | None, float | None, float | None, float | None]
Converter = Callable[[str, bytes], list[Item]]
BOXES = "path string, item_ix int, label string, text string, page_no int, l double, t double, r double, b double, error string"


@dataclass(frozen=True)
class Options:
    """What a real converter is set up with."""

    full_page_ocr: bool = True
    table_structure: bool = True
    picture_scale: float = 1.0
    classify_pictures: bool = False


def load(spec: str, options: Options | None = None) -> Callable[[], Converter]:
    """The factory that module:name names; one that takes options is given them."""
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError(f"a converter is named module:factory, not {spec!r}")
    factory = getattr(importlib.import_module(module), name)
    if "options" in inspect.signature(factory).parameters:
        return functools.partial(factory, options=options or Options())
    return factory


#: One converter per process and factory: setting one up is the costly part.
_MADE: dict[str, Converter] = {}


def json_converter() -> Converter:
    """A stand-in that reads items from JSON content: a list of [label, text, page, l, t, r, b]."""
    return lambda path, content: [tuple(x) for x in json.loads(content)]


def tuple_converter() -> Converter:
    """A stand-in for raw readers: a list of [polygon, text, score]; boxes bound the polygon."""

    def convert(path: str, content: bytes) -> list[Item]:
        out = []
        for poly, text, _ in json.loads(content):
            xs, ys = [float(p[0]) for p in poly], [float(p[1]) for p in poly]
            out.append(("text", text, 1, min(xs), max(ys), max(xs), min(ys)))
        return out

    return convert


def read_tuples(files: DataFrame) -> DataFrame:
    """files (path, content) of a raw reader, JSON lists of [polygon, text, score], to (path, item_ix, poly, text, score, error): nothing is dropped or rounded to boxes."""
    schema = "path string, item_ix int, poly array<struct<x:double,y:double>>, text string, score double, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, i, [{"x": float(x), "y": float(y)} for x, y in poly], text, float(score), None) for i, (poly, text, score) in enumerate(json.loads(bytes(content)))]
                except (ValueError, TypeError) as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "item_ix", "poly", "text", "score", "error"])

    return files.select("path", "content").mapInPandas(run, schema)


def convert_files(files: DataFrame, factory: Callable[[], Converter]) -> DataFrame:
    """files (path, content) to boxes with error: items numbered in document order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = repr(factory)
        convert = _MADE.get(key) or _MADE.setdefault(key, factory())
        names = [c.split()[0] for c in BOXES.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(path, i, *item, None) for i, item in enumerate(convert(path, bytes(content)))]
                except Exception as e:  # noqa: BLE001  a file's failure is a value
                    rows = [(path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, BOXES)
