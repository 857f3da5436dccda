"""Registered queries of this package: ``name -> (spark, sf_dir) -> DataFrame``.

Each applies one operator to its whole table and derives its digest columns
from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, collocations, decontamination, fingerprints, html_text, id_files, licenses, line_dedup, ngram_join, quality, secrets, suffix_dedup
from ..session import fresh_dir
from .io import read_documents, read_table


def rank_file() -> str:
    """The rank file that the token queries use (a fixed public vocabulary)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha256_utf8(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def ids_sha256(tokens: Column) -> Column:
    return F.sha2(F.array_join(tokens.cast("array<string>"), " ").cast("binary"), 256)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(read_documents(spark, sf_dir), k=5, percent=75)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(read_documents(spark, sf_dir).select("doc_id", "text"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_documents(spark, sf_dir).select("doc_id", "text"))
    labels = F.array_union("base", F.transform("matches", lambda m: m["label"]))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"), F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rank_file()
    encoded = bpe.encode(read_documents(spark, sf_dir).select("doc_id", "text"), path, drop_text=True)
    decoded = bpe.decode(encoded.select("doc_id", "tokens"), path)
    return decoded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), ids_sha256(F.col("tokens")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return decontamination.contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_neighbours(read_documents(spark, sf_dir))
    return found.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), sha256_utf8(F.col("edited")).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_documents(spark, sf_dir).select("doc_id", "text"), k=5, percent=75)
    return kept.select("doc_id", "n_lines", "n_removed", sha256_utf8(F.col("text")).alias("kept_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_documents(spark, sf_dir))
    return found.where("score >= 0.5").select("doc_id", "place", "candidate", F.round("score", 9).alias("score"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.align(read_documents(spark, sf_dir).select("doc_id", "text"), *paths).documents
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_dir(spark, "ids")
    id_files.save_texts(read_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    found = id_files.little_endian(id_files.read_ids(spark, folder))
    return found.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), F.crc32("bytes").alias("ids_crc32"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.top_phrases(read_documents(spark, sf_dir), limit=2000, min_count=100, max_words=5, percent=100)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_bpe": op5_bpe,
    "op6_html_text": op6_html_text,
    "op7_decontamination": op7_decontamination,
    "op8_fingerprints": op8_fingerprints,
    "op9_line_dedup": op9_line_dedup,
    "op10_secrets": op10_secrets,
    "op11_alignment": op11_alignment,
    "op12_id_files": op12_id_files,
    "op13_collocations": op13_collocations,
}
