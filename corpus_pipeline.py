"""Documents to training tokens: quality filter, near-duplicate removal, decontamination, redaction, encoding.

Each stage is written as Parquet in the shared folder and read again as the next one's documents, so a
lost executor costs a stage at most; it goes when the next one is written. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import bpe, decontaminate, pii, quality, simhash
from quillspark.llm.common import brief_shuffles, remove, shared_dir, table


def _carried(docs: DataFrame) -> DataFrame:
    """The text and the whole row beside it, so that no column of documents clashes with one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(_carried(docs), model).filter(F.col("score") >= quality.ACCEPT).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    found = pii.find_pii(_carried(docs), redact=True)
    new = {"text": F.col("redacted"), "n_chars": F.when(F.size("pii") > 0, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (packed, little-endian unsigned 32-bit), the number of them, and whether they decode to the text."""
    import public_tokenizers

    rank_file, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_checked(docs, rank_file, pattern)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("pii", redact),
    ("byte-level bpe", encode),
]
#: Trained scores, XXH64 fingerprints and byte-level BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, "stage-" + name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        with brief_shuffles(spark):
            out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # the stage's own table is whole, so the one it was made of is read no more
            remove(spark, before)
        before = path
    return docs
