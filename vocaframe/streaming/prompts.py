"""Training prompts from a stream of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import training_prompt
from ..plans import standins as S
from ..session import fresh_dir


def prompt_stream(sentences: DataFrame, text_col: str = "text", codes_col: str = "codes") -> DataFrame:
    """Add ``prompt`` to a (streaming or batch) DataFrame of sentences."""
    return sentences.withColumn("prompt", training_prompt(text_col, codes_col))


def stream_training_prompts(spark: SparkSession, sf_dir: str, out_dir: str | None = None) -> DataFrame:
    """Run the prompt step as a Structured Streaming query over the
    conversations table, with an available-now trigger and a checkpoint in
    the shared folder; returns the sink read back as a batch DataFrame."""
    src = f"{sf_dir.rstrip('/')}/conversations.parquet"
    schema = spark.read.parquet(src).schema  # footer only
    # the table is one file or a folder of files; a stream reads a plain path
    # as a folder only, a pattern (here of one letter) as either
    stream = spark.readStream.schema(schema).parquet(f"{src[:-1]}[{src[-1]}]")
    rows = stream.select("conv_id", "turn", "role", "text", F.expr(S.SENT_CODES).alias("codes"))
    out = prompt_stream(rows).select("conv_id", "turn", "prompt")
    base = out_dir or fresh_dir(spark, "stream-prompts")
    q = (
        out.writeStream.format("parquet")
        .option("checkpointLocation", base + "/_checkpoint")
        .option("path", base + "/data")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(base + "/data")
