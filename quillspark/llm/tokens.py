"""Word tokens and array idioms in SQL functions, for the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, which a name inside a nested lambda would not be."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column, longest: int | None = None) -> Column:
    """Lower-case tokens of a text, runs of letters and digits, on request in pieces of at most so many; none for null."""
    size = "+" if longest is None else f"{{1,{longest}}}"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"([\p{{L}}\p{{N}}]{size})"), F.lit(1))


def span(n: Column) -> Column:
    """0 to n - 1; an empty array where n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
