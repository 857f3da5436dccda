"""Global row numbers without a global window.

A window over all rows runs in one task.  Here the rows are range-partitioned
by their order once, written, and numbered in two levels: the rows of each
range are counted (one small row a range), the counts are summed up, and each
row adds its number inside its range.  The prefix sum has as many rows as the
sort has partitions, whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import ColumnOrName, broadcast_up_to, col_of, materialize

#: ``monotonically_increasing_id`` is the partition's number above this many
#: bits, which hold the row's number inside the partition.
ROW_BITS = 33


def starts(groups: DataFrame, size: str, *order: str) -> DataFrame:
    """``groups`` with ``start``: the sum of ``size`` over the groups before.

    One window over the whole of ``groups``, which must be small: a row for a
    partition, a file or a file split."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint"))


def with_place(df: DataFrame, *order: ColumnOrName | Column, name: str = "place") -> DataFrame:
    """``df`` with ``name``: the row's place (bigint, from 0) in the order of
    the given columns, numbered over the whole table.

    The sorted rows are written once to the shared folder, which also fixes
    the order of rows that compare equal (it is arbitrary, but each gets a
    place of its own).  Nulls come first, as in any ascending sort; an empty
    table gives no rows.  A column called ``name`` is replaced."""
    order = [col_of(c) for c in order]
    marked = df.drop(name).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    marked = materialize(marked, "places")
    part = F.shiftright("_row", ROW_BITS).alias("_part")
    ranges = starts(marked.groupBy(part).agg(F.count(F.lit(1)).alias("n")), "n", "_part").select("_part", "start")
    # one row a partition of the sort: bounded by the cluster's settings, not by the table
    numbered = marked.withColumn("_part", part).join(F.broadcast(ranges), "_part")
    inside = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return numbered.withColumn(name, F.col("start") + inside).select(*[c for c in df.columns if c != name], name)


def number_rows(df: DataFrame, key: str, name: str = "line_number") -> DataFrame:
    """``df`` with ``name``: the row's number (bigint, from 0) over all files
    of a scan whose rows carry ``key``: a struct of ``file``, ``start`` (of the
    file's split) and ``row`` (ascending inside a split, without gaps).

    Nothing is sorted and no row moves: the splits' row counts are summed up
    in the order of (file, start), and a row adds its distance from its
    split's first row."""
    splits = df.groupBy(F.col(key)["file"].alias("_file"), F.col(key)["start"].alias("_start")).agg(F.min(F.col(key)["row"]).alias("_first"), F.count(F.lit(1)).alias("n"))
    begun = starts(materialize(splits, "splits"), "n", "_file", "_start").select("_file", "_start", "_first", "start")
    met = df.join(broadcast_up_to(begun, row_bytes=256), (F.col(key)["file"] == F.col("_file")) & (F.col(key)["start"] == F.col("_start")))
    number = F.col("start") + F.col(key)["row"] - F.col("_first")
    return met.withColumn("_number", number).select(*[df[c] for c in df.columns if c != name], F.col("_number").alias(name))
