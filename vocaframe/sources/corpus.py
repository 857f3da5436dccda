"""JSONL corpus and training table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CORPUS_SCHEMA = "text STRING, code ARRAY<INT>"


def write_corpus(df: DataFrame, path: str) -> dict:
    """One JSON object per line with keys ``text`` and ``code`` (non-ASCII
    kept as is; a NULL code is omitted).  ``path`` is a folder of part
    files, overwritten.

    Returns the counts of the written rows (``samples``, ``empty_codes``,
    ``codes``), gathered by ``observe`` during the write itself: no second
    pass over the data."""
    obs = Observation("corpus_write")
    observed = df.select("text", "code").observe(
        obs,
        F.count(F.lit(1)).alias("samples"),
        F.sum(F.when(F.array_size("code") == 0, 1).otherwise(0)).alias("empty_codes"),
        F.sum(F.coalesce(F.array_size("code"), F.lit(0))).alias("codes"),
    )
    observed.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    return {k: (v or 0) for k, v in obs.get.items()}


def read_corpus(spark: SparkSession, path: str, row_key: bool = False) -> DataFrame:
    """Read a JSONL corpus with a fixed schema; ``row_key`` adds ``row_key``,
    which tells equal rows apart (file, block start, row of the scan).

    Malformed lines and non-integer codes fail the job (FAILFAST); a missing
    ``text`` fails it too, as the original reader requires the key.  Extra
    keys are ignored, ``code`` is optional.  Blank lines are skipped."""
    df = spark.read.schema(CORPUS_SCHEMA).option("mode", "FAILFAST").json(path)
    text = F.coalesce(F.col("text"), F.raise_error(F.lit("corpus line without 'text'")))
    if not row_key:
        return df.select(text.alias("text"), "code")
    key = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                   F.monotonically_increasing_id().alias("row"))
    return df.select(key.alias("row_key"), text.alias("text"), "code")


def write_training_table(df: DataFrame, path: str, text_col: str = "text") -> None:
    """The one-column training table, as Parquet."""
    df.select(F.col(text_col).alias("text")).write.mode("overwrite").parquet(path)
