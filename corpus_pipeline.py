"""A training-corpus pipeline: each stage is one operator, applied to all that the stage before it kept.

Rows with a null id or text, and rows that repeat an id, pass through the
stages as the operators say; a row is told by its id and the hash of its text.
Empty tables give empty tables; other columns of documents stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontaminate, linededup, minhash, packing, perplexity
from quantloom.llm.queries import tokenizer_path
from quantloom.llm.storage import fresh_path, staged

#: SQL cannot express the language model and the packing; tests hold the stages against brute-force versions on small tables.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bad = perplexity.judged(perplexity.measured(docs)).where("not kept").select(F.col("doc_id").alias("_ql_id"), F.col("key").alias("_ql_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_ql_id")) & F.xxhash64("text").eqNullSafe(F.col("_ql_key"))
    return docs.join(staged(bad, "rejected").hint("merge"), same, "left_anti")  # one plan at every size


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of two or more lines that stood before; n_chars follows the text."""
    return linededup.dedup_lines(docs, whole=True).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id (and text hash); rows equal in id and text are one document and stay together."""
    rows = minhash.near_duplicates(docs, percent=80, keyed=True)
    drop = rows.where("doc_id <> component_id or key <> component_key").select(F.col("doc_id").alias("_ql_id"), F.col("key").alias("_ql_key")).distinct()
    same = (F.col("doc_id") == F.col("_ql_id")) & (F.xxhash64("text") == F.col("_ql_key"))
    return docs.join(staged(drop, "duplicates").hint("merge"), same, "left_anti")  # one plan at every size


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences."""
    return packing.pack(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
