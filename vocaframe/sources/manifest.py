"""Manifest text files: one ``id<sep>text`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import last_text_per_id, parse_manifest


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_key, line`` with a key that orders lines as in the files.

    Text rows carry no line number, so the key is ``(file path, split start,
    monotonically_increasing_id())``: within one split the id grows with the
    line, and splits of a file are ordered by their start.  The key is
    deterministic for a given input, so a re-run task after an executor loss
    recomputes the same keys.  UTF-8 BOMs are dropped by the reader.
    ``utf8_ok`` flags lines with invalid UTF-8 (the original reader raises
    on them; here they are kept and flagged)."""
    df = spark.read.text(path)
    key = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select(key.alias("line_key"), F.col("value").alias("line"),
                     F.is_valid_utf8("value").alias("utf8_ok"))


def read_manifest(spark: SparkSession, path: str, sep: str = ":", file_index: int = 0,
                  text_index: int = 1, last_wins: bool = True) -> DataFrame:
    """Valid lines of the manifest(s) at ``path``; with ``last_wins`` one row
    per id, holding the last text (``file_id, text, first_key, n_lines``)."""
    parsed = parse_manifest(read_lines(spark, path), sep, file_index, text_index)
    return last_text_per_id(parsed) if last_wins else parsed
