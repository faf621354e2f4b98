"""JSON recovery from replies, strict parsing and export."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from quillspark.functions.geometry import col

# Fixed value: a stray token that some models put before the last closing brace.
STRAY = r'"\s*v"\s*(?=\n\s*\})'


def json_block(c: Column | str) -> Column:
    """From the first { to the last } of a reply, with a stray token before the end repaired; null without braces."""
    found = F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
    return F.regexp_replace(F.nullif(found, F.lit("")), STRAY, '"')


def _object(text: str | None) -> str | None:
    """The text rewritten if it is one JSON object by the standard library's rules (last of equal keys wins, NaN allowed), else null."""
    try:
        got = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(got, dict):
        return None
    out = json.dumps(got, ensure_ascii=False)
    try:
        out.encode("utf-8")
    except UnicodeEncodeError:  # half of a surrogate pair: no text can hold it, so escapes stay
        out = json.dumps(got)
    return out


@F.pandas_udf(T.StringType())
def strict_json(texts: pd.Series) -> pd.Series:
    """_object of each text. Built-in parsers accept trailing garbage or refuse repeated keys, so strict parity needs this one."""
    return texts.map(_object)


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]))
def _recovered(raws: pd.Series, blocks: pd.Series) -> pd.DataFrame:
    values = [_object(b) for b in blocks]
    why = [None if v is not None else f"no JSON object in reply: {r or ''}" if b is None else "invalid JSON object in reply" for v, r, b in zip(values, raws, blocks, strict=True)]
    return pd.DataFrame({"value": values, "error": why})


def recover(raw: Column | str) -> Column:
    """(value, error) of a reply: its JSON object, or why there is none; one is null. The reply is parsed once."""
    return _recovered(col(raw), json_block(raw))


def json_string(c: Column | str) -> Column:
    """A text as a JSON string, quoted and escaped."""
    listed = F.to_json(F.array(col(c)))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def json_object(entries: Column, value=json_string) -> Column:
    """A JSON object of an array of (key, value), in order; value makes JSON of a value, by default a string."""
    pairs = F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), value(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
