"""Token and duration metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def utterance_metrics(df: DataFrame, codes_col: str = "codes",
                      samples_col: str | None = None, rate_col: str | None = None) -> DataFrame:
    """Per row: ``n_tokens``, ``n_samples``, ``seconds``, ``tokens_per_second``.

    Without a decoded waveform the sample count is the codec's: 320 samples
    (20 ms at 16 kHz) per code."""
    n_tok = F.coalesce(F.array_size(codes_col), F.lit(0)).cast("bigint")
    n_samp = F.col(samples_col).cast("bigint") if samples_col else n_tok * K.CODEC_FRAME_SAMPLES
    rate = F.col(rate_col) if rate_col else F.lit(K.SAMPLE_RATE)
    out = df.withColumn("n_tokens", n_tok).withColumn("n_samples", n_samp)
    out = out.withColumn("seconds", F.try_divide(F.col("n_samples").cast("double"), rate.cast("double")))
    return out.withColumn("tokens_per_second", F.try_divide(F.col("n_tokens").cast("double"), F.col("seconds")))


def metrics_by(df: DataFrame, *keys: str) -> DataFrame:
    """Totals per group: partial aggregation, so a hot key is combined before
    the shuffle."""
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_utts"),
        F.sum("n_tokens").alias("total_tokens"),
        F.max("n_tokens").alias("max_tokens"),
        F.sum("n_samples").alias("total_samples"),
        F.sum(F.when(F.col("n_tokens") == 0, 1).otherwise(0)).cast("bigint").alias("n_empty"),
    )
    secs = F.col("total_samples").cast("double") / F.lit(float(K.SAMPLE_RATE))
    return agg.withColumn("total_seconds", secs).withColumn(
        "tokens_per_second", F.try_divide(F.col("total_tokens").cast("double"), F.col("total_seconds")))
