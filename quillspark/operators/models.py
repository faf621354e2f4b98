"""Model steps: messages, pluggable backends and the stages that call them.

A backend is called once per row of a partition, behind mapInPandas, so that no plan rewrite repeats a
call; its errors are values, and a failing row never fails a task. Write a stage's result before using
it twice. The offline backend answers by fixed rules and makes runs repeatable.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.jsonx import recover
from quillspark.functions.text import fill, strip

Messages = list[dict]
Backend = Callable[[Messages, bool], str]
#: Rows per batch of a stage that calls a model: a lost batch is that many calls.
BATCH_ROWS = 16


@dataclass(frozen=True)
class HttpBackend:
    """A chat server that takes and returns JSON over HTTP, with a timeout; a call that can't be made or that the server fails is tried again."""

    url: str
    model: str
    timeout: float = 300.0
    options: tuple[tuple[str, int], ...] = ()
    retries: int = 2
    wait: float = 1.0

    def __call__(self, messages: Messages, as_json: bool) -> str:
        import urllib.request

        body = {"model": self.model, "messages": messages, "stream": False} | ({"format": "json"} if as_json else {}) | ({"options": dict(self.options)} if self.options else {})
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.loads(reply.read())["message"]["content"]
            except OSError as e:  # URLError and HTTPError are such
                if attempt == self.retries or getattr(e, "code", 500) < 500:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise AssertionError("unreachable")


def echo_backend(messages: Messages, as_json: bool) -> str:
    """A deterministic stand-in: facts about the last message, as JSON or as a line."""
    last = messages[-1]["content"]
    facts = {"n_messages": len(messages), "n_chars": len(last), "first_word": (last.split() or [""])[0]}
    return json.dumps(facts, ensure_ascii=False) if as_json else f"{facts['first_word']} {facts['n_chars']}"


def messages(system: Column, user: Column, image: Column | None = None) -> Column:
    """A system and a user message; an image, if any, goes base64 with the user's, in one line."""
    shape = "array<struct<role:string,content:string,images:array<string>>>"
    images = F.when(image.isNotNull(), F.array(F.translate(F.base64(image), "\r\n", ""))) if image is not None else F.lit(None)
    none = F.lit(None).cast("array<string>")
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content"), none.alias("images")), F.struct(F.lit("user").alias("role"), user.alias("content"), images.cast("array<string>").alias("images"))).cast(shape)


def ask(df: DataFrame, backend: Backend, as_json: bool = True, messages_col: str = "messages") -> DataFrame:
    """df with raw (the reply) and call_error (why there is none)."""
    schema = df.drop("raw", "call_error").schema.add("raw", "string").add("call_error", "string")
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BATCH_ROWS):
                part = pdf.iloc[at : at + BATCH_ROWS].copy()
                raw, errors = [], []
                for said in part[messages_col]:
                    plain = [{k: (list(v) if k == "images" else v) for k, v in (m.asDict() if hasattr(m, "asDict") else m).items() if v is not None} for m in said]
                    try:
                        raw.append(backend(plain, as_json))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001  any failure of a call is a value
                        raw.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                part["raw"], part["call_error"] = raw, errors
                yield part[names]

    return df.mapInPandas(run, schema)


def execute_prompt(docs: DataFrame, prompt: dict[str, str], values: dict[str, Column], backend: Backend, step: str, as_json: bool = True, images: Column | None = None) -> DataFrame:
    """docs with response (a JSON object as text) and error: route and fill the prompt, ask, recover the object.

    as_json asks the server for JSON. images (bytes, null for none) take the vision prompts of a prompt that has them.
    """
    system, user, image = routed(prompt, values, images)
    asked = ask(docs.withColumn("messages", messages(system, user, image)), backend, as_json)
    got = asked.withColumn("got", recover("raw"))
    why = F.coalesce("call_error", "got.error")
    return got.withColumns({"error": F.when(why.isNotNull(), F.concat(F.lit(f"{step}: "), why)), "response": F.when(why.isNull(), F.col("got.value"))}).drop("messages", "raw", "call_error", "got")


def routed(prompt: dict[str, str], values: dict[str, Column], images: Column | None = None) -> tuple[Column, Column, Column | None]:
    """(system, user, image) of a request: an image with both vision prompts goes without the document's text, all else by its text."""
    both = lambda kind: F.lit("\n\n".join(x for x in (prompt.get("system"), prompt.get(f"system_{kind}")) if x))
    by_text = fill(prompt["user"], values)
    if images is None or not (prompt.get("system_vlm") and prompt.get("user_vlm")):
        return both("llm"), by_text, None
    seen = images.isNotNull()
    blind = {k: F.when(seen, F.lit("")).otherwise(v) if k == "documento" else v for k, v in values.items()}
    return F.when(seen, both("vlm")).otherwise(both("llm")), F.when(seen, fill(prompt["user_vlm"], blind)).otherwise(by_text), images


def question_form(docs: DataFrame, fields: list[tuple[str, str]], backend: Backend) -> DataFrame:
    """(doc_id, answers): each question is asked with all earlier questions and answers before it.

    The output of one question is the input of the next, so a document's form is one ordered loop; documents are independent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                history: Messages = [{"role": "system", "content": text or ""}]
                answers = {}
                for key, question in fields:
                    history.append({"role": "user", "content": question})
                    try:
                        answers[key] = backend(history, False).strip()
                    except Exception as e:  # noqa: BLE001
                        answers[key] = f"error: {e}"
                        history.pop()
                        break
                    history.append({"role": "assistant", "content": answers[key]})
                out.append((doc_id, answers))
            yield pd.DataFrame(out, columns=["doc_id", "answers"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, answers map<string,string>")


def history_before(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with history: the messages that stand before each turn."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(before))


def question_prompt(document: Column, question: Column) -> Column:
    """Messages of one question about a document."""
    return messages(F.concat_ws("\n\n", F.lit("Answer from this document only."), document), strip(question))
