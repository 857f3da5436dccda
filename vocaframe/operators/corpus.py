"""Corpus build: transcripts joined with the audio that exists and its codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def audio_file_ids(inventory: DataFrame, audio_dir: str, ext: str = ".wav") -> DataFrame:
    """``path`` listing -> ``file_id, path`` for files named ``<audio_dir>/<id><ext>``.

    The id is the path between the folder and the extension, so an id with a
    slash addresses a subfolder, as ``audio_dir / (id + ext)`` does.  Paths
    may carry a ``file:`` scheme (``binaryFile`` listings do)."""
    prefix = _without_scheme(audio_dir.rstrip("/") + "/")
    bare = F.regexp_replace(F.col("path"), "^file:(//)?", "")
    rel = F.substring(bare, len(prefix) + 1, 1 << 30)
    fid = F.expr(f"substring(_rel, 1, length(_rel) - {len(ext)})")
    return (
        inventory.withColumn("_rel", rel)
        .where(bare.startswith(prefix) & bare.endswith(ext))
        .select(fid.alias("file_id"), *inventory.columns)
    )


def _without_scheme(p: str) -> str:
    if p.startswith("file://"):
        return p[len("file://"):]
    if p.startswith("file:"):
        return p[len("file:"):]
    return p


def one_code_per_id(codes: DataFrame) -> DataFrame:
    """``file_id, code`` with one row for each id that has codes: of several
    lists for one id the smallest (they are ordered element by element), so
    that the result does not depend on the order of the rows."""
    return codes.where(F.col("code").isNotNull()).groupBy("file_id").agg(F.min("code").alias("code"))


def build_corpus(texts: DataFrame, audio_ids: DataFrame | None, codes: DataFrame | None = None) -> DataFrame:
    """``file_id, text`` (and other columns) x audio -> the same with ``code``.
    One row for each text, however often an id occurs on the other sides;
    ``audio_ids`` None: the texts are known to have audio.

    Texts whose audio file is missing are skipped (driven by the
    transcripts: files without a transcript are ignored).  The encoder's
    output is attached by an inner join; rows with NULL codes are skipped,
    an empty list is kept.

    When the audio table already carries a ``code`` column (codes stored
    with the inventory), presence and codes come from one inner join.
    Otherwise ``codes`` (``file_id, code``) is joined after a left-semi join
    with the audio ids.  No broadcast hint: both sides grow with the corpus;
    AQE turns a join into a broadcast at run time only when a side is
    measured small, and splits skewed partitions."""
    if codes is None and "code" in audio_ids.columns:
        return texts.join(one_code_per_id(audio_ids), "file_id", "inner").select(*texts.columns, "code")
    present = texts if audio_ids is None else texts.join(audio_ids.select("file_id"), "file_id", "left_semi")
    if codes is None:
        return present.select("*", F.lit(None).cast("array<int>").alias("code"))
    return present.join(one_code_per_id(codes), "file_id", "inner").select(*texts.columns, "code")


def store_by_id(df: DataFrame, table: str, path: str, buckets: int | None = None) -> None:
    """Save ``df`` as the table ``table`` (files at ``path``), bucketed and
    sorted by ``file_id``: joins of tables with as many buckets read them
    bucket by bucket and move no row.

    One shuffle here, one file a bucket.  ``buckets`` defaults to
    ``spark.sql.shuffle.partitions``; size it so that a bucket fits a task
    (100 TB: about 400,000 of 256 MB).  Rows should be one an id
    (``last_text_per_id``, ``one_code_per_id``), so that no bucket is hot."""
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, "file_id").write.bucketBy(buckets, "file_id").sortBy("file_id").option("path", path).saveAsTable(table)


def build_stored_corpus(spark: SparkSession, texts: str, codes: str) -> DataFrame:
    """``build_corpus`` on two tables of ``store_by_id``, one row an id in each.

    A merge join by hint: both sides lie in the same buckets, so nothing is
    exchanged and nothing is broadcast, whatever their sizes.  Texts without
    codes, null codes and null ids have no row; empty tables give none."""
    known = spark.table(codes).where(F.col("code").isNotNull()).select("file_id", "code")
    return spark.table(texts).join(known.hint("merge"), "file_id")


def corpus_rows(corpus: DataFrame) -> DataFrame:
    """The written record: raw text and codes, id dropped."""
    return corpus.select("text", "code")


def corpus_report(lines: DataFrame, audio_ids: DataFrame) -> DataFrame:
    """Counts of each stage as ``metric, value`` rows: lines, valid lines,
    texts (distinct ids), texts without audio, samples.

    ``lines``: every manifest line with a ``valid`` flag
    (``parse_manifest(..., keep_invalid=True)``); ``audio_ids``: ``file_id``
    (+ optional ``code``) of the existing files.  One read of the lines: a
    hash aggregation per id (invalid lines under a NULL key, which no join
    matches), a left join with the audio, one global aggregation, unpivoted
    with ``stack`` (no cross join of one-row tables)."""
    per_id = lines.groupBy(F.when(F.col("valid"), F.col("file_id")).alias("file_id")).agg(
        F.count(F.lit(1)).alias("_n"))
    has_code = F.col("code").isNotNull() if "code" in audio_ids.columns else F.lit(True)
    a = audio_ids.groupBy("file_id").agg(F.max(has_code).alias("_has_code")).withColumn("_has_audio", F.lit(True))
    j = per_id.join(a, "file_id", "left")
    is_text = F.col("file_id").isNotNull()
    stats = j.agg(
        F.sum("_n").alias("lines"),
        F.sum(F.when(is_text, F.col("_n")).otherwise(0)).alias("valid_lines"),
        F.count_if(is_text).alias("texts"),
        F.count_if(is_text & F.col("_has_audio").isNull()).alias("texts_without_audio"),
        F.count_if(is_text & F.coalesce(F.col("_has_code"), F.lit(False))).alias("samples"),
    )
    return stats.select(F.expr(
        "stack(5, 'lines', lines, 'valid_lines', valid_lines, 'texts', texts, "
        "'texts_without_audio', texts_without_audio, 'samples', samples) AS (metric, value)"
    )).select("metric", F.coalesce(F.col("value"), F.lit(0)).cast("bigint").alias("value"))
