"""A training-data pipeline of five operators over ``documents``.

Every stage works on all documents that the one before kept.  All but the last
return the columns of ``documents``; the last replaces the text by its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocaframe.llm import bpe, decontamination, line_dedup, ngram_join, quality
from vocaframe.llm.io import read_documents, read_table, table
from vocaframe.llm.queries import ids_sha256, rank_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3 (labels of the given tables)."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"), threshold=0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that match an earlier line; a document left without any
    text goes, ``n_chars`` counts what is left."""
    kept = line_dedup.dedup_lines(docs, k=5, percent=75)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.where(~emptied | F.col("text").isNull()).withColumn("n_chars", changed).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest doc_id."""
    return ngram_join.unique_documents(docs, k=5, percent=75)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, and whether they decode to the text's bytes."""
    path = rank_file()
    encoded = bpe.encode(docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), path, drop_text=True)
    # written in between, so that a task runs one Python worker at a time
    decoded = bpe.decode(table(encoded.drop("offsets"), "tokens"), path)
    same = F.sha2("decoded", 256) == F.col("text_sha256")
    return decoded.select("doc_id", "lang", "source", "n_chars", "tokens", F.size("tokens").cast("long").alias("n_tokens"), ids_sha256(F.col("tokens")).alias("ids_sha256"), same.alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Not expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
