"""Transcript manifest: parse ``id<sep>text`` lines, keep the last text per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, split_literal


def _field(parts: Column, index: int) -> Column:
    """Python list indexing: a missing non-negative index gives NULL (the
    reader checks ``len > index``); a negative one counts from the end and
    raises when out of range, as Python does."""
    if index >= 0:
        return F.get(parts, index)
    return F.element_at(parts, index)


def parse_manifest(lines: DataFrame, sep: str = ":", file_index: int = 0, text_index: int = 1,
                   line_col: str = "line", key_col: str = "line_key", keep_invalid: bool = False) -> DataFrame:
    """``key, line`` -> ``line_key, file_id, text`` for every valid line.

    Per line: strip (Python whitespace), split on the literal separator, pick
    two fields.  The line is valid when both fields exist and are non-empty
    *before* they are stripped, so ``"a: :z"`` yields id ``a`` with an empty
    text.  Text after a second separator is lost.  Map-only: no shuffle.
    ``keep_invalid=True`` keeps every line and adds a ``valid`` flag."""
    parts = split_literal(py_strip(F.col(line_col)), sep)
    fid = _field(parts, file_index)
    txt = _field(parts, text_index)
    parsed = lines.select(F.col(key_col).alias("line_key"), fid.alias("_fid"), txt.alias("_txt"))
    valid = F.coalesce((F.col("_fid") != "") & (F.col("_txt") != ""), F.lit(False))
    if keep_invalid:
        return parsed.select("line_key", py_strip("_fid").alias("file_id"), py_strip("_txt").alias("text"),
                             valid.alias("valid"))
    return parsed.where(valid).select(
        "line_key",
        py_strip("_fid").alias("file_id"),
        py_strip("_txt").alias("text"),
    )


def last_text_per_id(parsed: DataFrame) -> DataFrame:
    """A repeated id keeps the text of its last line and the position of its
    first line (insertion-ordered dict semantics).

    One aggregation with ``max_by``/``min``: both are partial aggregates, so a
    hot id is combined map-side before the shuffle and no group is ever
    materialized."""
    return parsed.groupBy("file_id").agg(
        F.max_by("text", "line_key").alias("text"),
        F.min("line_key").alias("first_key"),
        F.count(F.lit(1)).alias("n_lines"),
    )
