"""Last text per id over a stream of manifest lines.

``last_text_per_id`` is a partial aggregate, so it runs on a stream as it is:
the state store holds one row an id (last text, first key, number of lines),
each micro-batch is combined on the map side first and sends one row an id and
task, however hot an id is.  Keys decide, not arrival: a file that comes late
changes an id only where its lines are later by key.  The key comes with the
line (an offset of a log, a line number): a text stream numbers no rows.
In update mode each
batch gives the ids it changed; they are written to a folder of that batch,
which a batch that runs again after a loss writes anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.manifest import last_text_per_id, parse_manifest


def stream_last_texts(lines: DataFrame, out_dir: str, sep: str = ":", available_now: bool = True) -> StreamingQuery:
    """Start the query on a stream of ``line_key, line``; changes go to
    ``out_dir/changes``, the checkpoint to ``out_dir/checkpoint``."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out_dir}/changes/batch={batch}")

    writer = last_text_per_id(parse_manifest(lines, sep)).writeStream.outputMode("update").foreachBatch(write)
    writer = writer.option("checkpointLocation", f"{out_dir}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_texts(spark: SparkSession, out_dir: str, columns: str) -> DataFrame:
    """One row an id: what the last batch that changed it gave.  ``columns``
    is the schema of the changes; of a stream without a batch there are none."""
    changes = spark.createDataFrame([], columns + ", batch long")
    if _exists(spark, f"{out_dir}/changes"):
        changes = spark.read.schema(columns + ", batch long").parquet(f"{out_dir}/changes")
    rest = [c for c in changes.columns if c not in ("file_id", "batch")]
    return changes.groupBy("file_id").agg(F.max_by(F.struct(*rest), "batch").alias("last")).select("file_id", "last.*")


def _exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder exists, asked through Spark's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
