"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads whole driver tables through ``standins`` and runs one
library operator (or a chain of them) on all of their rows.  Array results
are also rendered as Python list text (``[1, 2]``) so that they compare
as plain strings against the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import (
    choose_reference_codes,
    completion_part,
    decode_generated_ids,
    extract_speech_ids,
    format_code_list,
    inference_prompt,
    normalize_text,
    parse_code_list,
    prompt_part,
    render_speech_tokens,
    text_preview,
    training_prompt,
    with_reference_text,
)
from ..jobs import build_corpus_job, training_table_job
from ..operators import audio, corpus, manifest, metrics, requests, segments, similarity
from ..operators.places import number_rows
from ..operators.shuffle import shuffle_places, shuffle_samples
from ..session import fresh_dir
from ..sources.audio import read_contents, read_headers, with_existence, write_wav_files
from ..sources.audio_frames import read_audio_frames
from ..sources.corpus import read_corpus, write_corpus
from ..sources.manifest import read_lines, read_manifest
from ..streaming.manifest import latest_texts, stream_last_texts
from ..streaming.scripts import stream_stitched
from . import standins as S

SHUFFLE_SEED = 42


def _r(c, digits: int = 6):
    return F.round(c, digits)


# --- 1 text -----------------------------------------------------------------

def q_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    """One and two passes; the second pass reads the projected first one
    (normalize twice == normalize the normalized text)."""
    t = S.texts(spark, sf).select("doc_id", normalize_text("text").alias("norm_text"))
    return t.select("doc_id", "norm_text", normalize_text("norm_text").alias("norm_text_2"))


def q_normalize_text_kana(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose letters are written as half-width kana, to real kana."""
    half = S.texts(spark, sf).select("doc_id", F.translate("text", *S.KANA_LETTERS).alias("text"))
    return half.select("doc_id", normalize_text("text", kana="correct").alias("norm_text"))


def q_text_preview(spark: SparkSession, sf: str) -> DataFrame:
    t = S.texts(spark, sf)
    return t.select("doc_id", text_preview("text").alias("preview"),
                    text_preview(normalize_text("text")).alias("norm_preview"))


# --- 2 tokens ---------------------------------------------------------------

def q_speech_token_render(spark: SparkSession, sf: str) -> DataFrame:
    u = S.utterances(spark, sf)
    return u.select("utt_id", render_speech_tokens("codes").alias("tokens"),
                    F.array_size("codes").cast("bigint").alias("n_codes"))


def q_speech_id_extract(spark: SparkSession, sf: str) -> DataFrame:
    u = S.utterances(spark, sf)
    noisy = F.concat(F.lit("x"), render_speech_tokens("codes"), F.lit("<|s_|>"), F.col("event_type"))
    # project the extracted ids once; the next select reads the column
    x = u.select("utt_id", "codes", extract_speech_ids(noisy).alias("ids"))
    return x.select(
        "utt_id",
        format_code_list("ids").alias("ids"),
        F.array_size("ids").cast("bigint").alias("n_ids"),
        (F.col("ids") == F.col("codes").cast("array<bigint>")).alias("roundtrip_ok"),
    )


def q_generated_id_decode(spark: SparkSession, sf: str) -> DataFrame:
    g = S.generated(spark, sf)
    d = g.select("utt_id", "prompt_len", decode_generated_ids("ids", "prompt_len").alias("codes"))
    return d.select("utt_id", "prompt_len", format_code_list("codes").alias("codes"),
                    F.array_size("codes").cast("bigint").alias("n_codes"))


def q_code_list_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    u = S.utterances(spark, sf)
    t = u.select("utt_id", "codes", format_code_list("codes").alias("code_list"))
    p = t.withColumn("parsed", parse_code_list("code_list", strict=False))
    return p.select(
        "utt_id",
        "code_list",
        F.col("parsed").isNotNull().alias("parse_ok"),
        F.coalesce(F.col("parsed") == F.col("codes"), F.lit(False)).alias("roundtrip_ok"),
    )


# --- 3 prompts --------------------------------------------------------------

def _training(spark: SparkSession, sf: str) -> DataFrame:
    s = S.sentences(spark, sf)
    return s.select(F.col("script_id").alias("conv_id"), F.col("pos").alias("turn"),
                    training_prompt("text", "codes").alias("prompt"))


def q_training_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _training(spark, sf)


def q_inference_prompt(spark: SparkSession, sf: str) -> DataFrame:
    s = S.sentences(spark, sf)
    return s.select(F.col("script_id").alias("conv_id"), F.col("pos").alias("turn"),
                    inference_prompt("text").alias("prompt"))


def q_reference_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences after the first, with the conversation's first turn as the
    reference (its text and codes; its audio's codes when it has none).

    The first turn reaches every later sentence through a join salted by
    block (``segments.attach_per_script``), so a conversation holding a
    large share of all rows is spread over many tasks."""
    s = S.sentences(spark, sf)
    first = s.where(F.col("pos") == 0).select(
        "script_id",
        F.col("text").alias("ref_text"),
        F.col("codes").alias("ref_codes"),
        F.expr(S.REF_AUDIO_CODES.replace("conv_id", "script_id")).alias("ref_audio_codes"),
    )
    j = segments.attach_per_script(s.where(F.col("pos") > 0), first)
    text = F.when(F.length("ref_text") > 0, with_reference_text("text", "ref_text")).otherwise(F.col("text"))
    codes = choose_reference_codes("ref_codes", "ref_audio_codes")
    return j.select(F.col("script_id").alias("conv_id"), F.col("pos").alias("turn"),
                    inference_prompt(text, codes).alias("prompt"))


def q_completion_split(spark: SparkSession, sf: str) -> DataFrame:
    t = _training(spark, sf)
    return t.select("conv_id", "turn", prompt_part("prompt").alias("prompt_text"),
                    completion_part("prompt").alias("completion"))


def q_training_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return shuffle_samples(_training(spark, sf), SHUFFLE_SEED, "conv_id", "turn")


# --- 4 manifest -------------------------------------------------------------

def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.parse_manifest(S.manifest_lines(spark, sf))


def q_manifest_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf)


def q_manifest_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.last_text_per_id(_parsed(spark, sf))


# --- 5 corpus ---------------------------------------------------------------

def _corpus_parts(spark: SparkSession, sf: str):
    lines = S.manifest_lines(spark, sf)
    parsed = manifest.parse_manifest(lines)
    texts = manifest.last_text_per_id(parsed).select("file_id", "text")
    inv = S.audio_codes(S.audio_inventory(spark, sf))  # listing + the codec's output per file
    ids = corpus.audio_file_ids(inv, S.AUDIO_DIR, ".wav")
    built = corpus.build_corpus(texts, ids)
    return lines, parsed, texts, ids, built


def q_corpus_build(spark: SparkSession, sf: str) -> DataFrame:
    built = _corpus_parts(spark, sf)[-1]
    return built.select("file_id", "text", format_code_list("code").alias("code_list"),
                        F.array_size("code").cast("bigint").alias("n_codes"))


def q_corpus_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and codes stored once, bucketed by id, then joined in place."""
    _, _, texts, ids, _ = _corpus_parts(spark, sf)
    names = []
    for name, df in (("texts", texts), ("codes", corpus.one_code_per_id(ids))):
        path = fresh_dir(spark, name)
        names.append(path.rsplit("/", 1)[1].replace("-", "_"))
        corpus.store_by_id(df, names[-1], path)
    return corpus.build_stored_corpus(spark, *names).select("file_id", "text", format_code_list("code").alias("code_list"))


def q_corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    lines = manifest.parse_manifest(S.manifest_lines(spark, sf), keep_invalid=True)
    inv = S.audio_codes(S.audio_inventory(spark, sf))
    ids = corpus.audio_file_ids(inv, S.AUDIO_DIR, ".wav")
    return corpus.corpus_report(lines, ids)


def q_corpus_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Write the corpus as JSONL to the shared folder, read it back."""
    built = _corpus_parts(spark, sf)[-1]
    path = fresh_dir(spark, "corpus-jsonl")
    write_corpus(corpus.corpus_rows(built), path)
    back = read_corpus(spark, path)
    return back.select("text", format_code_list("code").alias("code_list"),
                       F.array_size("code").cast("bigint").alias("n_codes"))


# --- 6 scripts --------------------------------------------------------------

def q_segment_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = S.table(spark, sf, "documents")
    return segments.split_script(docs, "doc_id", "text").select(
        F.col("script_id").alias("doc_id"), "pos", F.col("text").alias("line"))


def q_segment_context(spark: SparkSession, sf: str) -> DataFrame:
    s = S.sentences(spark, sf)
    out = segments.chain_context(s, S.script_references(spark, sf))
    return out.select(F.col("script_id").alias("conv_id"), F.col("pos").alias("turn"), "prompt")


def _offsets(spark: SparkSession, sf: str) -> DataFrame:
    return segments.stitch_offsets(S.sentences(spark, sf))


def q_segment_stitch(spark: SparkSession, sf: str) -> DataFrame:
    o = _offsets(spark, sf)
    return o.select(F.col("script_id").alias("conv_id"), F.col("pos").alias("turn"), "is_last", "n_kept",
                    "start_seq", "total", "decodable", format_code_list("kept").alias("kept"))


def q_segment_stream(spark: SparkSession, sf: str) -> DataFrame:
    st = segments.stitched_stream(_offsets(spark, sf))
    return st.select(F.col("script_id").alias("conv_id"), "seq", F.col("code").cast("int").alias("code"))


# --- 7 similarity -----------------------------------------------------------

def _scored(spark: SparkSession, sf: str) -> DataFrame:
    refs = S.references(spark, sf)
    target = refs.where(F.col("vec_id") == S.TARGET_VEC_ID)
    others = refs.where(F.col("vec_id") != S.TARGET_VEC_ID)
    return similarity.score_references(others, target)


def q_similarity_all(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("vec_id", "path", _r(F.col("similarity")).alias("similarity"))


def q_similarity_top10(spark: SparkSession, sf: str) -> DataFrame:
    top = similarity.ranked(_scored(spark, sf), 10)
    return top.select(F.col("rank").cast("bigint").alias("rank"), "vec_id",
                      _r(F.col("similarity")).alias("similarity"))


def q_similarity_top10_per_target(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth embedding against all others."""
    refs = S.references(spark, sf)
    top = similarity.top_k_per_target(refs, refs.where("vec_id % 20 = 0"), 10)
    return top.select("target", "rank", "vec_id", _r(F.col("similarity")).alias("similarity"))


def q_similarity_csv(spark: SparkSession, sf: str) -> DataFrame:
    named = similarity.by_base_name(_scored(spark, sf))
    return similarity.csv_lines(named).select("name", "first_pos", _r(F.col("similarity")).alias("similarity"),
                                              "line")


# --- 8 requests -------------------------------------------------------------

def _validated(spark: SparkSession, sf: str) -> DataFrame:
    return requests.validate_requests(S.requests(spark, sf))


def q_request_validate(spark: SparkSession, sf: str) -> DataFrame:
    v = _validated(spark, sf)
    return v.select("conv_id", "turn", "model", "voice", "response_format", "speed", "temperature", "top_p",
                    "repeat_penalty", "max_tokens", F.array_join("violations", ",").alias("violations"),
                    "is_valid")


def q_request_payload(spark: SparkSession, sf: str) -> DataFrame:
    p = requests.route_payloads(_validated(spark, sf))
    shape = ("prompt string, temperature double, top_p double, max_tokens int, min_tokens int, "
             "repetition_penalty double, repeat_penalty double, stop_token_ids array<bigint>, stream boolean")
    j = p.select("conv_id", "turn", F.from_json("payload", shape).alias("j"))
    return j.select("conv_id", "turn", "j.prompt", "j.temperature", "j.top_p", "j.max_tokens", "j.min_tokens",
                    "j.repetition_penalty", "j.repeat_penalty", F.get("j.stop_token_ids", F.lit(0)).alias("stop_id"),
                    "j.stream")


def q_response_parse(spark: SparkSession, sf: str) -> DataFrame:
    r = requests.parse_responses(S.responses(spark, sf))
    return r.select("utt_id", "status", "error", format_code_list("speech_ids").alias("ids"),
                    F.array_size("speech_ids").cast("bigint").alias("n_ids"))


def q_token_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.metrics_by(metrics.utterance_metrics(S.utterances(spark, sf)), "speaker")
    return m.select("speaker", "n_utts", "total_tokens", F.col("max_tokens").cast("bigint").alias("max_tokens"),
                    "total_samples", "n_empty", _r(F.col("total_seconds")).alias("total_seconds"),
                    _r(F.col("tokens_per_second")).alias("tokens_per_second"))


# --- 9 audio ----------------------------------------------------------------

def q_audio_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    w = S.waveforms(spark, sf, varied=False)
    wav = audio.encode_wav(w, "utt_id")
    pre = audio.preprocess_audio(wav, "utt_id")
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return pre.select(
        "utt_id",
        "sample_rate",
        "n_samples",
        _r(total, 9).alias("sum_samples"),
        F.array_min("samples").cast("double").alias("min_sample"),
        F.array_max("samples").cast("double").alias("max_sample"),
    )


def q_corpus_lint(spark: SparkSession, sf: str) -> DataFrame:
    w = S.waveforms(spark, sf, varied=True)
    heads = audio.inspect_headers(audio.encode_wav(w, "utt_id"), "utt_id")
    flagged = audio.lint(heads)
    return flagged.select("utt_id", "sample_rate", "n_channels", "bits", "n_frames",
                          _r(F.col("seconds")).alias("seconds"), F.array_join("flags", ",").alias("flags"))


def q_audio_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Clips -> mono 16 kHz float waveform -> WAV bytes of the route (16-bit
    mono) -> headers, with the route's response metadata."""
    w = S.waveforms(spark, sf, varied=False)
    pre = audio.preprocess_audio(audio.encode_wav(w, "utt_id"), "utt_id")
    heads = audio.inspect_headers(audio.waveform_to_wav(pre, "utt_id"), "utt_id")
    meta = requests.response_headers(
        heads.withColumn("response_format", F.expr(S.REQ_FORMAT.replace("(conv_id + turn)", "utt_id")))
        .withColumn("n_tokens", F.expr("CAST(n_frames DIV 320 AS BIGINT)")),
        samples_col="n_frames")
    return meta.select("utt_id", "sample_rate", "n_channels", "bits", "n_frames", "content_type",
                       "content_disposition", "generated_tokens", _r(F.col("audio_duration")).alias("audio_duration"))


def q_audio_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Level clips of 400 frames at four rates -> 16 kHz mono: length, and the
    level in the middle."""
    w = S.level_clips(spark, sf)
    pre = audio.preprocess_audio(audio.encode_wav(w, "utt_id"), "utt_id")
    middle = F.get("samples", F.floor(F.col("n_samples") / 2).cast("int")).cast("double")
    return pre.select("utt_id", "n_samples", (F.abs(middle - F.expr(S.LEVEL.replace("event_id", "utt_id")) / 32768) < 0.005).alias("level_kept"))


BLOCK_FRAMES = 128


def q_audio_resample_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Clips of 400 different frames in blocks of 128 -> 16 kHz, block by
    block: how many samples equal those of the clip in one piece.

    The rows are dealt by id while they are ids only, blocks and clips meet
    before they go through Python: no sample is shuffled."""
    w = S.varied_clips(spark, sf)
    size = F.lit(BLOCK_FRAMES)
    scaled = F.transform(F.get("channels", F.lit(0)), lambda x: (x.cast("double") / 32768).cast("float"))
    clips = w.select("utt_id", "sample_rate", scaled.alias("x"))
    cut = clips.select("utt_id", "sample_rate", F.array_size("x").cast("bigint").alias("total"), "x",
                       F.explode(F.sequence(F.lit(0), F.floor((F.array_size("x") - 1) / size).cast("int"))).alias("block"))
    blocks = cut.select("utt_id", "sample_rate", "total", F.col("block").cast("bigint").alias("block"), (F.col("block") * size).cast("bigint").alias("start"),
                        F.slice("x", F.col("block") * size + 1, size).alias("samples"))
    pairs = audio.resample_blocks(blocks, "utt_id", beside=w.select("utt_id", "channels", F.col("sample_rate").alias("clip_rate"), "bits"))
    wav = audio.encode_wav(pairs.withColumnRenamed("samples", "part"), "utt_id", rate_col="clip_rate", keep=["start", "total", "part"])
    made = audio.preprocess_audio(wav, "utt_id", keep=["start", "total", "part"]).withColumnRenamed("samples", "whole")
    same = F.zip_with("part", F.slice("whole", (F.col("start") + 1).cast("int"), F.array_size("part")), lambda a, b: F.when(a == b, 1).otherwise(0))
    equal = F.aggregate(same, F.lit(0), lambda acc, x: acc + x)
    return made.groupBy("utt_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.max("total").alias("total"), F.sum(F.array_size("part")).alias("n_samples"),
        F.max("n_samples").alias("n_whole"), F.sum(equal).alias("n_equal"))


# --- sources: written from the tables to the shared folder, then read back ---

def q_manifest_file(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest text files (several, in line order) through the real reader."""
    path = fresh_dir(spark, "manifest")
    _write_lines(S.manifest_lines(spark, sf), path)
    return read_manifest(spark, path).select("file_id", "text", "n_lines")


def _write_lines(lines: DataFrame, path: str) -> None:
    lines.repartitionByRange("line_key").sortWithinPartitions("line_key").select("line").write.text(path)


def q_manifest_line_number(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of several manifest files with its number over all of them."""
    path = fresh_dir(spark, "manifest")
    _write_lines(S.manifest_lines(spark, sf), path)
    return number_rows(read_lines(spark, path), "line_key").select("line_number", "line")


def q_training_table(spark: SparkSession, sf: str) -> DataFrame:
    """JSONL corpus -> the training-table job -> its Parquet table."""
    src, out = fresh_dir(spark, "corpus-jsonl"), fresh_dir(spark, "training")
    write_corpus(S.sentences(spark, sf).select("text", F.col("codes").alias("code")), src)
    training_table_job(spark, src, out, seed=SHUFFLE_SEED)
    return spark.read.parquet(out)


def q_training_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place that each training sample gets in the permutation."""
    return shuffle_places(_training(spark, sf), SHUFFLE_SEED, "conv_id", "turn").select("conv_id", "turn", "place")


SHARDS = 7


def q_training_shards(spark: SparkSession, sf: str) -> DataFrame:
    """JSONL corpus -> the training-table job with shards -> its files: the
    shard, the place in it and the text of every row."""
    src, out = fresh_dir(spark, "corpus-jsonl"), fresh_dir(spark, "training")
    write_corpus(S.sentences(spark, sf).orderBy("script_id", "pos").select("text", F.col("codes").alias("code")), src)
    training_table_job(spark, src, out, seed=SHUFFLE_SEED, shards=SHARDS)
    shard = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint")
    return spark.read.parquet(out).select(shard.alias("shard"), F.col("_metadata.row_index").alias("place"), "text")


def q_similarity_file(spark: SparkSession, sf: str) -> DataFrame:
    """The CSV sink, read back as text."""
    path = fresh_dir(spark, "similarity")
    similarity.write_csv(similarity.by_base_name(_scored(spark, sf)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _supplier_wavs(spark: SparkSession, suppliers: DataFrame) -> str:
    """A folder with a WAV file for two thirds of the suppliers."""
    folder = fresh_dir(spark, "wavs")
    write_wav_files(audio.encode_wav(S.supplier_clips(suppliers.where("s_suppkey % 3 != 0")), "file_id"), folder, "file_id")
    return folder


def q_corpus_files(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus job over files: every supplier has two manifest lines (the
    last wins); some codes are missing, null or repeated."""
    sup = S.table(spark, sf, "supplier").select("s_suppkey", "s_name", F.expr(S.SUPPLIER_FILE).alias("file_id"))
    manifest_path, out = fresh_dir(spark, "manifest"), fresh_dir(spark, "corpus-jsonl")
    line = F.concat("file_id", F.lit(":v"), F.col("version").cast("string"), F.lit(" "), F.col("s_name"))
    lines = sup.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    lines.repartitionByRange("version", "s_suppkey").sortWithinPartitions("version", "s_suppkey").select(line.alias("value")).write.text(manifest_path)
    codes = sup.where("s_suppkey % 7 != 1").select("file_id", F.expr("CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE array(CAST(s_suppkey AS INT), 5) END").alias("code"), "s_suppkey")
    codes = codes.unionByName(codes.where("s_suppkey % 5 = 0"))
    build_corpus_job(spark, _supplier_wavs(spark, sup.select("s_suppkey")), manifest_path, out, codes.select("file_id", "code"))
    return read_corpus(spark, out).select("text", format_code_list("code").alias("code_list"))


def q_audio_files(spark: SparkSession, sf: str) -> DataFrame:
    """WAV files of two thirds of the suppliers; existence by id, header and
    waveform through the file sources."""
    sup = S.table(spark, sf, "supplier").select("s_suppkey")
    folder = _supplier_wavs(spark, sup)
    ids = with_existence(sup.withColumn("file_id", F.expr(S.SUPPLIER_FILE)), folder)
    paths = ids.where("has_audio").withColumn("path", F.concat(F.lit(folder + "/"), "file_id", F.lit(".wav")))
    heads = read_headers(paths).select("s_suppkey", "n_frames", "n_channels")
    pre = audio.preprocess_audio(read_contents(paths.select("s_suppkey", "path")), "s_suppkey")
    total = F.round(F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x.cast("double")), 9)
    sums = pre.select("s_suppkey", "n_samples", total.alias("sum_samples"))
    return ids.select("s_suppkey", "has_audio").join(heads, "s_suppkey", "left").join(sums, "s_suppkey", "left")


def q_audio_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The WAV files of two thirds of the suppliers, read by byte ranges of
    100 bytes in blocks of 16 frames."""
    folder = _supplier_wavs(spark, S.table(spark, sf, "supplier").select("s_suppkey"))
    frames = read_audio_frames(spark, folder, block_frames=16, split_bytes=100)
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return frames.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.max("total").alias("n_frames"), F.max("n_channels").alias("n_channels"),
        F.sum(F.array_size("samples")).alias("n_samples"), F.round(F.sum(total), 9).alias("sum_samples"))


# --- streaming --------------------------------------------------------------

def q_stream_training_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """``training_prompt`` run as a Structured Streaming job over the
    conversations file (available-now trigger), read back from its sink."""
    from ..streaming import stream_training_prompts

    out = stream_training_prompts(spark, sf)
    return out.select("conv_id", "turn", "prompt")


def q_stream_manifest_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Several manifest files, one a micro-batch, into the last text per id."""
    path, out = fresh_dir(spark, "manifest"), fresh_dir(spark, "stream-manifest")
    S.manifest_lines(spark, sf).repartition(4, "line_key").write.parquet(path)
    lines = spark.readStream.schema("line_key long, line string").option("maxFilesPerTrigger", 1).parquet(path)
    stream_last_texts(lines, out).awaitTermination()
    return latest_texts(spark, out, "file_id string, text string, first_key long, n_lines long")


def q_stream_segment_stitch(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences that arrive over several runs of a stream, then the ends of
    their scripts, into the stitched sequence."""
    path, out = fresh_dir(spark, "sentences"), fresh_dir(spark, "stream-stitch")
    rows = S.sentences(spark, sf).select("script_id", F.col("pos").cast("long").alias("pos"), "text", "codes", F.lit(False).alias("ended"))
    nothing = F.lit(None)
    ends = rows.select("script_id").distinct().select(
        "script_id", nothing.cast("long").alias("pos"), nothing.cast("string").alias("text"),
        nothing.cast("array<int>").alias("codes"), F.lit(True).alias("ended"))
    for part in (rows.where("pos < 2"), rows.where("pos between 2 and 3"), rows.where("pos > 3"), ends):
        part.write.mode("append").parquet(path)
        stream_stitched(spark.readStream.schema(rows.schema).parquet(path), out).awaitTermination()
    o = spark.read.parquet(out + "/data").where("not late")
    return o.select(F.col("script_id").alias("conv_id"), F.col("pos").cast(S.sentences(spark, sf).schema["pos"].dataType).alias("turn"),
                    "is_last", "n_kept", "start_seq", "total", "decodable", format_code_list("kept").alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalize_text": q_normalize_text,
    "normalize_text_kana": q_normalize_text_kana,
    "text_preview": q_text_preview,
    "speech_token_render": q_speech_token_render,
    "speech_id_extract": q_speech_id_extract,
    "generated_id_decode": q_generated_id_decode,
    "code_list_roundtrip": q_code_list_roundtrip,
    "training_prompt": q_training_prompt,
    "inference_prompt": q_inference_prompt,
    "reference_prompt": q_reference_prompt,
    "completion_split": q_completion_split,
    "training_shuffle": q_training_shuffle,
    "manifest_parse": q_manifest_parse,
    "manifest_last_wins": q_manifest_last_wins,
    "corpus_build": q_corpus_build,
    "corpus_bucketed": q_corpus_bucketed,
    "corpus_report": q_corpus_report,
    "corpus_roundtrip": q_corpus_roundtrip,
    "segment_split": q_segment_split,
    "segment_context": q_segment_context,
    "segment_stitch": q_segment_stitch,
    "segment_stream": q_segment_stream,
    "similarity_all": q_similarity_all,
    "similarity_top10": q_similarity_top10,
    "similarity_top10_per_target": q_similarity_top10_per_target,
    "similarity_csv": q_similarity_csv,
    "request_validate": q_request_validate,
    "request_payload": q_request_payload,
    "response_parse": q_response_parse,
    "token_metrics": q_token_metrics,
    "audio_preprocess": q_audio_preprocess,
    "corpus_lint": q_corpus_lint,
    "audio_roundtrip": q_audio_roundtrip,
    "audio_resample": q_audio_resample,
    "audio_resample_blocks": q_audio_resample_blocks,
    "manifest_file": q_manifest_file,
    "manifest_line_number": q_manifest_line_number,
    "training_table": q_training_table,
    "training_shards": q_training_shards,
    "training_order": q_training_order,
    "similarity_file": q_similarity_file,
    "audio_files": q_audio_files,
    "audio_frames": q_audio_frames,
    "corpus_files": q_corpus_files,
    "stream_manifest_last_wins": q_stream_manifest_last_wins,
    "stream_segment_stitch": q_stream_segment_stitch,
    "stream_training_prompt": q_stream_training_prompt,
}
