"""File sources: images, Markdown, prompts and field lists as tables."""

from __future__ import annotations

import struct
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quillspark.functions.text import suffix

# Suffixes of sources, in lower or in upper case, never mixed.
SOURCE_SUFFIXES = ("jpg", "jpeg", "png", "pdf", "tiff", "tif", "bmp")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
CONVERTIBLE = (".pdf", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".docx", ".pptx", ".xlsx")


# Modes of the single-prompt command and the number of the prompt each means.
MODES = (("kvi", "11"), ("11.1", "11.1"), ("kvg", "10"), ("ccc", "01"), ("mcc", "02"), ("cfc", "03"), ("01", "01"), ("02", "02"), ("03", "03"))


def is_image(path: Column | str) -> Column:
    return F.lower(suffix(path)).isin(*IMAGE_SUFFIXES)


def _kind(spark: SparkSession, source: str) -> str | None:
    """file or folder, in whatever store the path names, or None if there is neither."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    return "folder" if store.getFileStatus(path).isDirectory() else "file"


def find_source_files(spark: SparkSession, source: str, suffixes: tuple[str, ...] = SOURCE_SUFFIXES) -> DataFrame:
    """(path, modificationTime, length, content) of a file of any kind, or of the sources below a folder; each file once."""
    reader = spark.read.format("binaryFile")
    if _kind(spark, source) == "file":
        return reader.load(source)
    both = ",".join(c for s in suffixes for c in (s, s.upper()))
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{both}}}").load(source)


def in_path_order(files: DataFrame) -> DataFrame:
    """files (path, ...) but their contents, with position, from 1, by path components.

    The listing is sorted in ranges; a range begins where the sizes of those before it end.
    """
    order = F.split("path", "/")
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.drop("content").repartitionByRange(n, order).sortWithinPartitions(order).withColumn("range", F.spark_partition_id()).persist()
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))  # n rows, one for each range
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return dealt.join(F.broadcast(before), "range").withColumn("position", (F.col("before") + own).cast("long")).drop("range", "before")


def find_markdown_files(spark: SparkSession, source: str) -> DataFrame:
    """(path, text) of a file of any kind, or of *.md below a folder."""
    options = {} if _kind(spark, source) == "file" else {"recursiveFileLookup": True, "pathGlobFilter": "*.md"}
    got = spark.read.text(source, wholetext=True, **options)
    return got.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def require_markdown_files(spark: SparkSession, source: str) -> DataFrame:
    if _kind(spark, source) is None:
        raise FileNotFoundError(f"no such file or folder: {source}")
    got = find_markdown_files(spark, source)
    if got.isEmpty():
        raise FileNotFoundError(f"no Markdown files in {source}")
    return got


def _size_of(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) by the header of a PNG, GIF, BMP or JPEG."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    """(width, height) of image bytes, nulls where no header of a known kind is there."""
    return pd.DataFrame([_size_of(c) or (None, None) for c in content], columns=["width", "height"]).astype("Int32")


def load_prompts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(prompt_id, system, system_llm, system_vlm, user, user_vlm) of YAML prompt files; keys that are missing are null."""
    import yaml

    keys = ("system", "system_llm", "system_vlm", "user", "user_vlm")
    rows = []
    for p in paths:
        got = yaml.safe_load(Path(p).read_text(encoding="utf-8")) or {}
        rows.append((Path(p).stem, *[got.get(k) for k in keys]))
    return spark.createDataFrame(rows, "prompt_id string, " + ", ".join(f"{k} string" for k in keys))


def load_fields(path: str) -> list[tuple[str, str]]:
    """(key, question) in file order."""
    import yaml

    return [(f["key"], f["question"]) for f in yaml.safe_load(Path(path).read_text(encoding="utf-8"))["fields"]]


def load_text(files: DataFrame, convert=None) -> DataFrame:
    """files (path, content) with text and error: text files as they are, convertible ones by convert, others an error."""
    kind = F.lower(suffix("path"))
    plain = files.filter(kind.isin(".md", ".txt")).select("path", F.col("content").cast("string").alias("text"), F.lit(None).cast("string").alias("error"))
    other = files.filter(~kind.isin(".md", ".txt", *CONVERTIBLE)).select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("unsupported file type: "), kind).alias("error"))
    out = plain.union(other)
    if convert is not None:
        from quillspark.operators.layout import reading_order
        from quillspark.sources.converter import convert_files

        boxes = convert_files(files.filter(kind.isin(*CONVERTIBLE)), convert)
        text = reading_order(boxes.filter("error IS NULL").withColumnRenamed("path", "doc_id")).select(F.col("doc_id").alias("path"), "text", F.lit(None).cast("string").alias("error"))
        out = out.union(text).union(boxes.filter("error IS NOT NULL").select("path", F.lit(None).cast("string"), "error"))
    return out
