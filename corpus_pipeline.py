"""A training-text pipeline over documents: each stage's decisions hold for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from strataflow.llm import bpe, decontaminate, importance, secrets, simhash
from strataflow.session import materialise, read_table, ship_package

#: The columns that every stage but the last hands on.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return importance.resample(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id; of repeated rows one.

    Links are pairs of a Jaccard similarity of 0.8 at least on sets of five-word shingles, confirmed on the shingles.
    Fingerprints of 256 bits select what is compared: at most 72 bits differ, and 24 of the first 64.
    """
    found = simhash.similar(docs, 0.8, words=5, lanes=4, radius=72, lead=24)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang", "n_chars"))
    return kept.withColumn("_first", first).where("_first = 1").drop("_first")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, re-parameterised or not, go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in it gives way to a mark, and n_chars follows."""
    redacted = secrets.redact(docs.select(*COLUMNS))
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that stays."""
    return bpe.digests(bpe.decode(bpe.encode(docs)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontaminated),
    ("secret scan", without_secrets),
    ("bpe", encoded),
]

#: SQL can't express the stages (hash models, Gumbel sampling, fingerprints, byte-pair encoding).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
