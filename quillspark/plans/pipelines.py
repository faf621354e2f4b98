"""Composite pipelines: conversion, extraction and chained classification as resumable stages.

Each step's outcomes are appended to a results table before the next step reads them, so a plan never
issues a call twice and a rerun asks only for what has no success yet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillspark.functions import geometry
from quillspark.functions.text import stem
from quillspark.operators import layout, models, state
from quillspark.sources.converter import Converter, convert_files
from quillspark.sources.files import MODES, image_size
from quillspark.sources.sinks import write_crops

Prompts = dict[str, dict[str, str]]
# The steps by the names of their prompts.
EXTRACTION = ("10_extraccion_generica", "11_extraccion_factura")
CLASSIFICATION = ("01_centro_costo", "02_macro_categoria", "03_concepto_codigo_final")
# Fixed value: what classification is told of facts that a document's text alone doesn't give.
UNKNOWN = "no informado"
# The prompts that classify, and what each needs to be told of the steps before.
CLASSIFYING = ("01", "02", "03")
NEEDED = {"02": (("a cost centre", "centro_costo"),), "03": (("a macro category", "macro_categoria"),)}
#: The list and code that the next classification step reads from an answer.
PRIMARY = {"01_centro_costo": ("$.centros_costos[0].codigo_centro_costo", "centro_costo"), "02_macro_categoria": ("$.macro_categorias[0].macro_categoria", "macro_categoria")}


def _results(docs: DataFrame, path: str) -> DataFrame:
    """The results table of documents with identifiers of this type; empty before the first run."""
    spark, schema = docs.sparkSession, state.results_schema(dict(docs.dtypes)["doc_id"])
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the first run has no table yet
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def _run(spark: SparkSession, docs: DataFrame, values: dict[str, Column], prompt: dict[str, str], backend: models.Backend, family: str, step: str, path: str, run_id: int, force: bool) -> None:
    """Append the outcomes of one step for the documents of docs (doc_id, text, ...) that lack a success."""
    wanted = state.pending(docs.withColumn("step", F.lit(step)), _results(docs, path), force)
    out = models.execute_prompt(wanted, prompt, values, backend, step)
    out.select("doc_id", F.lit(family).alias("family"), "step", "response", "error", F.lit(run_id).cast("long").alias("run_id")).write.mode("append").parquet(path)


def extract_documents(spark: SparkSession, docs: DataFrame, prompts: Prompts, backend: models.Backend, path: str, run_id: int = 1, force: bool = False) -> DataFrame:
    """docs (doc_id, text): every extraction prompt for every document, each step on its own."""
    for step in EXTRACTION:
        _run(spark, docs, {"documento": F.col("text")}, prompts[step], backend, "extraction", step, path, run_id, force)
    return state.current(_results(docs, path)).filter("family = 'extraction'")


def classify_documents(spark: SparkSession, docs: DataFrame, prompts: Prompts, backend: models.Backend, path: str, tax_condition: str = "21", run_id: int = 1, force: bool = False) -> DataFrame:
    """docs (doc_id, text): centre, macro category and final code, each fed the primary code of the step before.

    An answer without options is an error of the next step; the step before stays a success.
    """
    facts = {"proveedor": F.lit(UNKNOWN), "monto": F.lit(UNKNOWN), "descripcion": F.col("text"), "condicion_impositiva": F.lit(tax_condition)}
    rows = docs
    for i, step in enumerate(CLASSIFICATION):
        if i:
            prior = CLASSIFICATION[i - 1]
            json_path, name = PRIMARY[prior]
            # a first-run prerequisite gates the call: documents without the prior success issue none
            gated = state.gated(rows, _results(docs, path), prior)
            gated = gated.withColumn(name, F.get_json_object("prior_response", json_path)).drop("prior_response")
            missing = state.pending(gated.filter(F.col(name).isNull()).withColumn("step", F.lit(step)), _results(docs, path), force)
            missing.select("doc_id", F.lit("classification").alias("family"), "step", F.lit(None).cast("string").alias("response"), F.lit(f"{step}: no primary option of {prior}").alias("error"), F.lit(run_id).cast("long").alias("run_id")).write.mode("append").parquet(path)
            rows = gated.filter(F.col(name).isNotNull())
            facts = {**facts, name: F.col(name)}
        _run(spark, rows, facts, prompts[step], backend, "classification", step, path, run_id, force)
    return state.current(_results(docs, path)).filter("family = 'classification'")


def convert_documents(files: DataFrame, factory: Callable[[], Converter], choice: str = "auto") -> DataFrame:
    """files (path, content) to (path, orientation, markdown, status, error): reading-order Markdown, one row per file."""
    boxes = convert_files(files, factory)
    good = boxes.filter("error IS NULL").withColumnRenamed("path", "doc_id")
    text = layout.reading_order(good, choice).select(F.col("doc_id").alias("path"), "orientation", F.col("text").alias("markdown"))
    failed = boxes.filter("error IS NOT NULL").select("path", "error")
    joined = files.select("path").join(text, "path", "left").join(failed, "path", "left")
    # a file without items has no boxes: its text is the fallback line
    shown = F.lit(layout.HORIZONTAL if choice == "auto" else choice)
    blank = F.col("error").isNull() & F.col("markdown").isNull()
    return joined.select(
        "path",
        F.when(blank, shown).otherwise(F.col("orientation")).alias("orientation"),
        F.when(blank, F.concat(layout.fallback(shown), F.lit("\n"))).otherwise(F.col("markdown")).alias("markdown"),
        F.when(F.col("error").isNull(), "success").otherwise("error").alias("status"),
        "error",
    )


def single_prompt(docs: DataFrame, mode: str, prompt: dict[str, str], backend: models.Backend, given: dict[str, str] | None = None) -> DataFrame:
    """docs (path, text, and image: bytes or null) with response and error of one prompt, by its mode.

    Modes that classify need the codes of the steps before, and don't ask the server for JSON; the others ask for it, and
    images go by the vision prompts where there are some.
    """
    known, given = dict(MODES), given or {}
    if mode not in known:
        raise ValueError(f"mode must be one of {', '.join(known)}, not {mode!r}")
    for needs, name in NEEDED.get(known[mode], ()):
        if not given.get(name):
            raise ValueError(f"mode {mode} needs {needs}")
    if known[mode] in CLASSIFYING:
        values = {"proveedor": F.lit(UNKNOWN), "monto": F.lit(UNKNOWN), "descripcion": F.col("text"), "centro_costo": F.lit(given.get("centro_costo") or UNKNOWN), "macro_categoria": F.lit(given.get("macro_categoria") or "no informada"), "condicion_impositiva": F.lit(given.get("condicion_impositiva") or "no informada")}
        return models.execute_prompt(docs, prompt, values, backend, mode, as_json=False)
    return models.execute_prompt(docs, prompt, {"documento": F.col("text")}, backend, mode, images=F.col("image") if "image" in docs.columns else None)


def process_folder(files: DataFrame, done: DataFrame | None, factory: Callable[[], Converter], choice: str = "auto") -> DataFrame:
    """convert_documents of the files that done (path) lacks; the others have status skipped."""
    if done is None:
        return convert_documents(files, factory, choice)
    new = files.join(done.select("path"), "path", "left_anti")
    none = F.lit(None).cast("string")
    skipped = files.select("path").join(done.select("path").distinct(), "path", "left_semi").select("path", none.alias("orientation"), none.alias("markdown"), F.lit("skipped").alias("status"), none.alias("error"))
    return convert_documents(new, factory, choice).union(skipped)


def detected_images(files: DataFrame, factory: Callable[[], Converter], folder: str, cut: Callable[[bytes, tuple[int, int, int, int]], bytes]) -> DataFrame:
    """(name, path, error) of the pictures found in image files (path, content), cut out by cut and written to folder.

    Pictures are numbered per file in item order before those without a place or a pixel go; files without a readable size give none.
    """
    boxes = convert_files(files, factory).filter("label = 'picture' and error is null")
    numbered = boxes.withColumn("pic_ix", F.row_number().over(Window.partitionBy("path").orderBy("item_ix")) - 1).filter("l is not null")
    sized = files.select("path", "content", image_size("content").alias("size")).filter("size.width is not null")
    crops = numbered.join(sized, "path").withColumns({"img_w": F.col("size.width"), "img_h": F.col("size.height")})
    crops = crops.withColumns(geometry.crop_rectangle("img_w", "img_h")).filter("crop_right > crop_left AND crop_bottom > crop_top")
    return write_crops(crops.withColumn("file_name", F.concat(stem("path"), F.lit("_detected_"), F.col("pic_ix").cast("string"), F.lit(".png"))), folder, cut)


def done_before(spark: SparkSession, path: str) -> DataFrame | None:
    """(path) of the documents that a table of conversions holds, None if there is no table yet."""
    try:
        return spark.read.parquet(path).filter("status = 'success'").select("path").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def convert_folder(spark: SparkSession, files: DataFrame, factory: Callable[[], Converter], path: str, choice: str = "auto", force: bool = False) -> DataFrame:
    """(path, status, error) of files, new texts appended to the table at path; those it holds are skipped unless forced."""
    run = uuid.uuid4().hex
    rows = process_folder(files, None if force else done_before(spark, path), factory, choice).filter("status <> 'skipped'")
    rows.withColumns({"run": F.lit(run), "converted_at": F.current_timestamp()}).write.mode("append").parquet(path)
    new = spark.read.parquet(path).filter(F.col("run") == run).select("path", "status", "error")
    return files.select("path").join(new, "path", "left").select("path", F.coalesce("status", F.lit("skipped")).alias("status"), "error")


def latest_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown) of a table of conversions: the last text of each file."""
    table = spark.read.parquet(path).filter("status = 'success'")
    return table.groupBy("path").agg(F.max_by("markdown", "converted_at").alias("markdown"))


def full_pipeline(spark: SparkSession, files: DataFrame, factory: Callable[[], Converter], prompts: Prompts, backend: models.Backend, folder: str, tax_condition: str = "21", choice: str = "auto", run_id: int = 1, force: bool = False) -> DataFrame:
    """Convert, extract and classify files (path, content); (doc_id, path, family, step, response, error) of all steps.

    Documents are known by their path; folder holds documents and results. Existing text is used again unless forced.
    """
    docs_path, results_path = f"{folder}/documents", f"{folder}/results"
    known = F.col("path")
    done = None if force else done_before(spark, docs_path)
    new = process_folder(files, done, factory, choice).filter("status <> 'skipped'")
    new.withColumns({"doc_id": known, "run_id": F.lit(run_id).cast("long")}).write.mode("append").parquet(docs_path)
    table = spark.read.parquet(docs_path)
    latest = table.groupBy("doc_id", "path").agg(F.max_by("markdown", "run_id").alias("text"), F.max_by("status", "run_id").alias("status")).filter("status = 'success'").drop("status")
    wanted = latest.join(files.select("path"), "path", "left_semi").select("doc_id", "text")
    extract_documents(spark, wanted, prompts, backend, results_path, run_id, force)
    classify_documents(spark, wanted, prompts, backend, results_path, tax_condition, run_id, force)
    return state.current(_results(wanted, results_path)).join(latest.select("doc_id", "path"), "doc_id")
