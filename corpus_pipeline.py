"""A training corpus from raw documents: quality, near duplicates, secrets, mixture, tokens.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a frame, which is
written as Parquet and read back as the next one's docs. All but the last return the columns of documents.
Every stage works on all rows of its docs, nulls, empty and very long texts and repeated rows included, keeps
further columns under whatever names, and gives an empty table for an empty one. Rows with a null doc_id are linked
with nothing and stay, unless the quality rules reject them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.llm import bpe, common, mixing, near_dedup, quality_rules, secret_scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Of rows that repeat this id every different text stays once (the row whose other columns come first as JSON).
    """
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    kept = common.written(kept.withColumnRenamed("doc_id", "_kept"), "kept")
    ids = F.broadcast(kept) if kept.count() <= near_dedup.FEW else kept  # rows stay where they are; beyond that both sides are shuffled
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    named = docs.select(F.col("doc_id").cast("long").alias("_id"), row).join(ids, F.col("_id") == F.col("_kept")).select("_id", "_row")
    if not kept.where("_rows > 1").isEmpty():
        others = F.to_json(F.struct(*[F.col(f"_row.`{c}`") for c in docs.columns if c != "text"]))
        first = Window.partitionBy("_id", F.sha2("_row.text", 256)).orderBy(others)
        named = named.withColumn("_place", F.row_number().over(first)).where("_place = 1")
    return named.select("_row.*").unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked in text."""
    return secret_scan.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the mixture takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and digests of token ids and decoded text for every row."""
    return bpe.digests(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]
#: Near duplicates and byte-level BPE are beyond SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
