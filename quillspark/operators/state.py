"""Run state: outcomes per document and step, resume, prerequisites, errors and summaries.

step_results: doc_id, family, step, response, error, run_id. An error never destroys a success, and a
later success supersedes an error: the current outcome of a (document, step) is its first success if
there is one, otherwise its latest error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.jsonx import json_object, json_string

RESULTS = "doc_id bigint, family string, step string, response string, error string, run_id bigint"


def results_schema(kind: str = "bigint") -> str:
    """RESULTS with identifiers of another type."""
    return RESULTS.replace("doc_id bigint", f"doc_id {kind}")


def fan_out(docs: DataFrame, steps: DataFrame) -> DataFrame:
    """Every document with every step; steps is the handful of prompts of a family."""
    return docs.crossJoin(F.broadcast(steps))


def pending(wanted: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """The wanted (doc_id, step) without a success; all of them on force."""
    if force:
        return wanted
    return wanted.join(results.filter("error IS NULL").select("doc_id", "step"), ["doc_id", "step"], "left_anti")


def gated(wanted: DataFrame, results: DataFrame, prior: str) -> DataFrame:
    """wanted with the response of its document's prior step as prior_response; only where that step succeeded."""
    done = current(results).filter((F.col("step") == prior) & F.col("error").isNull())
    return wanted.join(done.select("doc_id", F.col("response").alias("prior_response")), "doc_id")


def current(results: DataFrame) -> DataFrame:
    """(doc_id, family, step, response, error): one outcome per document and step."""
    ok = F.col("error").isNull()
    first_ok = F.min_by("response", F.when(ok, F.col("run_id")))
    last_error = F.max_by("error", F.when(~ok, F.col("run_id")))
    won = F.max(ok)
    return results.groupBy("doc_id", "family", "step").agg(F.when(won, first_ok).alias("response"), F.when(~won, last_error).alias("error"))


def error_maps(results: DataFrame) -> DataFrame:
    """(doc_id, errors): step to message of the steps without a success, null where all succeeded."""
    entry = F.when(F.col("error").isNotNull(), F.struct("step", "error"))
    got = current(results).groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return got.select("doc_id", F.when(F.size("entries") > 0, F.map_from_entries("entries")).alias("errors"))


def export_objects(rows: DataFrame, name: Column | None = None) -> DataFrame:
    """(doc_id, json) of outcomes (doc_id, step, response, error): an object of the file's name, its answers by step and,
    where there are some, its errors. A response that is JSON itself is taken as it is, any other as a string."""
    steps = F.array_sort(F.collect_list(F.struct("step", "response", "error")))
    one = rows.groupBy("doc_id").agg(steps.alias("steps"))
    entries = lambda good: F.transform(F.filter("steps", lambda s: s["error"].isNull() if good else s["error"].isNotNull()), lambda s: F.struct(s["step"].alias("key"), (s["response"] if good else s["error"]).alias("value")))
    answer = lambda c: F.when(F.json_object_keys(c).isNotNull(), c).otherwise(json_string(c))
    errors = F.when(F.size(entries(False)) > 0, F.concat(F.lit(',"errores":'), json_object(entries(False)))).otherwise("")
    file = F.concat(F.col("doc_id").cast("string"), F.lit(".md")) if name is None else name
    return one.select("doc_id", F.concat(F.lit('{"archivo":'), json_string(file), F.lit(',"extracciones":'), json_object(entries(True), answer), errors, F.lit("}")).alias("json"))


def status_summary(statuses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, success, skipped, failed, total) of rows with status success, skipped or error."""
    count = lambda s: F.count_if(F.col("status") == s)
    return statuses.groupBy(*(keys or [])).agg(count("success").alias("success"), count("skipped").alias("skipped"), count("error").alias("failed"), F.count("*").alias("total"))


def overlay(saved: Column, default: Column) -> Column:
    """default with the entries of saved over it; null maps count as empty."""
    empty = F.create_map().cast("map<string,string>")
    s, d = F.coalesce(saved, empty), F.coalesce(default, empty)
    kept = F.map_filter(d, lambda k, _: ~F.map_contains_key(s, k))
    return F.map_concat(kept, s)


def input_hash(*parts: Column | str) -> Column:
    """What a step's answer depends on, so that another model, prompt or text is another key."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("\x00")) for p in parts]), 256)
