"""The two data jobs of the original tool, as Spark jobs.

* :func:`build_corpus_job`: manifest + audio folder (+ the codec's codes per
  file, as a table) -> JSONL corpus, with the stage counts.
* :func:`training_table_job`: JSONL corpus -> shuffled one-column table of
  training prompts (Parquet).

The neural codec is not part of this library: its output enters as a table
``file_id, code`` (Parquet or JSON).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.prompts import training_prompt
from .operators import corpus as C
from .operators.manifest import last_text_per_id, parse_manifest
from .operators.places import number_rows
from .operators.shuffle import shuffle_samples
from .sources.audio import with_existence
from .sources.corpus import read_corpus, write_corpus, write_training_table
from .sources.manifest import read_lines
from .util import materialize


def _read_table(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".json") or path.endswith(".jsonl"):
        return spark.read.schema("file_id STRING, code ARRAY<INT>").json(path)
    return spark.read.parquet(path)


def build_corpus_job(spark: SparkSession, audio_dir: str, text_file: str, output: str, codes: str | DataFrame,
                     split_word: str = ":", file_index: int = 0, text_index: int = 1, ext: str = ".wav") -> dict:
    """Manifest lines -> last text per id -> texts whose ``<audio_dir>/<id><ext>``
    exists -> joined with their codes -> JSONL at ``output``, in the order in
    which the ids first appear.

    Returns the counts: lines, valid lines, texts, texts without audio,
    samples written.  They are taken while the rows are written."""
    seen, kept = Observation("manifest"), Observation("texts")
    lines = parse_manifest(read_lines(spark, text_file), split_word, file_index, text_index, keep_invalid=True)
    lines = lines.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if("valid").alias("valid_lines"))
    texts = last_text_per_id(lines.where("valid")).select("file_id", "text", "first_key")
    checked = with_existence(texts, audio_dir, ext).observe(
        kept, F.count(F.lit(1)).alias("texts"), F.count_if(~F.col("has_audio")).alias("texts_without_audio"))
    code_df = _read_table(spark, codes) if isinstance(codes, str) else codes
    built = C.build_corpus(checked.where("has_audio").drop("has_audio"), None, code_df.select("file_id", "code"))
    built = materialize(built, "corpus")  # the sort reads its input twice
    written = write_corpus(C.corpus_rows(built.orderBy("first_key")), output)
    return {**seen.get, **kept.get, "samples": written["samples"]}


def training_table_job(spark: SparkSession, corpus_path: str, output: str, seed: int = 0,
                       shards: int | None = None) -> int:
    """JSONL corpus -> training prompts in a random order of ``seed`` and each
    row's number in the corpus (equal samples are spread, too), written as
    Parquet with one ``text`` column; with ``shards`` as files of
    ``ceil(rows / shards)`` rows (the last ones hold the rest).  Returns the
    row count."""
    df = number_rows(read_corpus(spark, corpus_path, row_key=True), "row_key", name="number")
    prompts = df.select(training_prompt("text", "code").alias("text"), "number")
    out = shuffle_samples(prompts, seed, "number", shards=shards).select("text")
    write_training_table(out, output)
    return spark.read.parquet(output).count()
