"""Command line: convert folders, run pipelines offline or against a chat server, one prompt, reports, and questions about a document."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from quillspark.session import local_session

#: The converter where none is named: a stand-in that reads positioned items from JSON.
STAND_IN = "quillspark.sources.converter:json_converter"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, source: str = "source") -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.add_argument(source)
        p.add_argument("--converter", default=STAND_IN, help="module:factory of the function that reads files")
        p.add_argument("--picture-scale", type=float, default=1.0)
        p.add_argument("--classify-pictures", action="store_true")
        p.add_argument("--no-ocr", action="store_true", help="read text layers only")
        return p

    def server(p: argparse.ArgumentParser) -> None:
        p.add_argument("--url", help="chat server; without it answers are deterministic stand-ins")
        p.add_argument("-m", "--model", default="offline")
        p.add_argument("--context", type=int, help="context size that the server is asked for")

    for name, text in (("convert", "source files to Markdown"), ("full", "convert, extract and classify"), ("extract", "extraction prompts over Markdown"), ("classify", "classification prompts over Markdown")):
        p = command(name, text)
        p.add_argument("-o", "--output", required=True, help="folder of result tables")
        p.add_argument("-w", "--workers", type=int, default=1)
        p.add_argument("--force", action="store_true", help="do again what is done")
        p.add_argument("--orientation", choices=("auto", "horizontal", "vertical"), default="auto")
        p.add_argument("--markdown", help="folder for a Markdown file of each text (convert)")
        p.add_argument("--export", help="one JSON file of all results, in order of their files")
        p.add_argument("--tax-condition", default="21")
        p.add_argument("-p", "--prompts", nargs="*", default=[], help="YAML prompts, named by step")
        server(p)
    p = command("prompt", "one prompt over a Markdown file, a folder of them, or an image")
    from quillspark.sources.files import MODES

    p.add_argument("-M", "--mode", choices=[m for m, _ in MODES], default="kvg")
    p.add_argument("-p", "--prompt", required=True, help="YAML prompt")
    p.add_argument("--cost-center")
    p.add_argument("--macro-category")
    p.add_argument("--tax-condition")
    p.add_argument("-o", "--output", help="JSON file; without it the result is printed")
    server(p)
    for name, text in (("text", "items in the dominant orientation, a line each"), ("raw", "all text of a file in order, unfiltered"), ("report", "orientation votes and a line per box")):
        p = command(name, text)
        p.add_argument("-o", "--output", help="file; without it the text is printed")
    ask = command("ask", "one question, a form of questions or a dialogue about a document", "file")
    ask.add_argument("-q", "--question")
    ask.add_argument("-f", "--fields", help="YAML list of keys and questions")
    server(ask)
    return top


def dialogue(history: list[dict], backend, lines, write) -> None:
    """Questions until an empty line, the end of input or a quit word; a failing server ends it with a message."""
    for line in lines:
        line = line.strip()
        if not line or line.lower() in ("quit", "exit", "salir"):
            return
        history.append({"role": "user", "content": line})
        try:
            answer = backend(history, False)
        except OSError as e:
            write(f"no answer: {e}\n")
            return
        history.append({"role": "assistant", "content": answer})
        write(answer + "\n")


def fail(why: str) -> int:
    print(why, file=sys.stderr)
    return 1


def main(args: list[str] | None = None) -> int:
    from quillspark.operators import models
    from quillspark.sources import converter

    a = parser().parse_args(args)
    source = a.file if a.command == "ask" else a.source
    missing = [p for p in (source, *(getattr(a, "prompts", None) or ()), getattr(a, "prompt", None), getattr(a, "fields", None)) if p and "://" not in p and not Path(p).exists()]
    if missing:
        return fail("no such file or folder: " + ", ".join(missing))
    if getattr(a, "workers", 1) < 1:
        return fail("workers must be at least 1")
    factory = converter.load(a.converter, converter.Options(full_page_ocr=not a.no_ocr, picture_scale=a.picture_scale, classify_pictures=a.classify_pictures))
    backend = None
    if hasattr(a, "url"):
        options = (("num_ctx", a.context),) if a.context else ()
        backend = models.HttpBackend(a.url, a.model, options=options) if a.url else models.echo_backend
    spark = local_session(str(getattr(a, "workers", 1)))
    run = {"ask": ask_document, "prompt": run_prompt, "text": show, "raw": show, "report": show}.get(a.command, run_pipeline)
    try:
        return run(spark, a, factory, backend)
    except (ValueError, FileNotFoundError) as e:
        return fail(str(e))


def read_one(spark, path: str, factory) -> str:
    """The text of one file: text files as they are, convertible ones by the converter."""
    from quillspark.sources import files

    row = files.load_text(spark.read.format("binaryFile").load(path), factory).first()
    if row is None or row["error"]:
        raise ValueError(row["error"] if row else f"nothing in {path}")
    return row["text"]


def ask_document(spark, a, factory, backend) -> int:
    from quillspark.sources import files

    history = [{"role": "system", "content": read_one(spark, a.file, factory)}]
    if a.fields:
        for key, question in files.load_fields(a.fields):
            history.append({"role": "user", "content": question})
            history.append({"role": "assistant", "content": backend(history, False).strip()})
            print(f"{key}: {history[-1]['content']}")
    else:
        dialogue(history, backend, [a.question] if a.question else sys.stdin, sys.stdout.write)
    return 0


def run_prompt(spark, a, factory, backend) -> int:
    """One result bare, several by path; the first document without an answer ends the command."""
    from pyspark.sql import functions as F

    from quillspark.plans import pipelines
    from quillspark.sources import files, sinks

    (row,) = files.load_prompts(spark, [a.prompt]).collect()
    prompt = {k: v for k, v in row.asDict().items() if v is not None}
    if Path(a.source).suffix.lower() in files.IMAGE_SUFFIXES:
        docs = spark.read.format("binaryFile").load(a.source).select("path", F.lit("").alias("text"), F.col("content").alias("image"))
    else:
        docs = files.require_markdown_files(spark, a.source)
    given = {"centro_costo": a.cost_center, "macro_categoria": a.macro_category, "condicion_impositiva": a.tax_condition}
    got = pipelines.single_prompt(docs, a.mode, prompt, backend, given).select("path", "response", "error").persist()
    bad = got.filter("error is not null").orderBy("path").first()
    if bad:
        return fail(f"{bad['path']}: {bad['error']}")
    rows = got.select(F.col("path").alias("doc_ord"), F.col("path").alias("name"), F.col("response").alias("json"))
    if a.output:
        sinks.export_results(rows, a.output)
    else:
        found = {r["name"]: json.loads(r["json"]) for r in rows.orderBy("doc_ord").toLocalIterator()}
        print(json.dumps(next(iter(found.values())) if len(found) == 1 else found, ensure_ascii=False, indent=2))
    return 0


def show(spark, a, factory, backend) -> int:
    """Flat text, raw text or a report of the boxes of each file of a folder."""
    from quillspark.operators import layout
    from quillspark.sources import converter, files, sinks

    boxes = converter.convert_files(files.find_source_files(spark, a.source), factory).persist()
    failed = boxes.filter("error is not null").first()
    if failed:
        return fail(f"{failed['path']}: {failed['error']}")
    good = boxes.withColumnRenamed("path", "doc_id")
    make = {"text": layout.flat_text, "raw": layout.raw_text, "report": layout.box_report}[a.command]
    rows = (r["text"] + "\n" for r in make(good).orderBy("doc_id").toLocalIterator())
    if a.output:
        sinks.write_parts(a.output, rows)
    else:
        sys.stdout.writelines(rows)
    return 0


def run_pipeline(spark, a, factory, backend) -> int:
    from pyspark.sql import functions as F

    from quillspark.operators import state
    from quillspark.plans import pipelines
    from quillspark.sources import files, sinks

    if a.command == "convert":
        told = pipelines.convert_folder(spark, files.find_source_files(spark, a.source), factory, a.output, a.orientation, a.force)
        state.status_summary(told).show()
        if a.markdown:
            named = sinks.flattened(pipelines.latest_texts(spark, a.output))
            bad = sinks.write_each(named, a.markdown, "name", "markdown").filter("error is not null").first()
            if bad:
                return fail(f"{bad['name']}: {bad['error']}")
        return 0
    prompts = {r["prompt_id"]: {k: v for k, v in r.asDict().items() if v is not None} for r in files.load_prompts(spark, a.prompts).collect()} if a.prompts else {}
    plain = {"system": "Answer with one JSON object.", "user": "{{documento}}{{descripcion}}"}
    steps = {s: prompts.get(s, plain) for s in (*pipelines.EXTRACTION, *pipelines.CLASSIFICATION)}
    if a.command == "full":
        done = pipelines.full_pipeline(spark, files.find_source_files(spark, a.source), factory, steps, backend, a.output, a.tax_condition, a.orientation, force=a.force)
    else:
        docs = files.require_markdown_files(spark, a.source).select(F.col("path").alias("doc_id"), "text")
        if a.command == "extract":
            done = pipelines.extract_documents(spark, docs, steps, backend, a.output, force=a.force)
        else:
            done = pipelines.classify_documents(spark, docs, steps, backend, a.output, a.tax_condition, force=a.force)
    done.show(truncate=False)
    if a.export:
        rows = state.export_objects(done, F.col("doc_id")).select(F.split("doc_id", "/").alias("doc_ord"), F.col("doc_id").alias("name"), "json")
        sinks.export_results(rows, a.export, shape="array")
    return 0


if __name__ == "__main__":
    sys.exit(main())
