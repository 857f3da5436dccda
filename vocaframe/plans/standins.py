"""Inputs of the registered queries, derived from the driver's tables.

The test tables hold no transcripts, audio or codes, so every query derives
its input from them row by row (no collects, no fixed data alone), and the
oracle side (``plans/oracle.py``) derives the same values in DuckDB SQL.
Each derivation is a pure function of one row, so its cost grows with the
table and it adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  The test files are single row groups, one task each:
    the session setting ``vocaframe.input.partitions`` deals their rows over
    so many partitions; it is unset by default, at every size."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    partitions = spark.conf.get("vocaframe.input.partitions", None)
    return df.repartition(int(partitions)) if partitions else df


# --- utterances: one per event ---------------------------------------------
# n_codes = (event_id * 37) % 41, code[i] = (event_id * 7919 + i * 104729) % 65536
UTT_N_CODES = "CAST((event_id * 37) % 41 AS INT)"
UTT_CODES = (
    f"transform(array_repeat(0, {UTT_N_CODES}), "
    "(x, i) -> CAST((event_id * 7919 + i * 104729) % 65536 AS INT))"
)
# generated ids: prompt ids 128000.. (event_id % 4 of them), then per code i:
# end marker when (event_id + i) % 97 = 0, 193800 + i % 3 when % 13 = 0,
# 128263 when % 29 = 0, else code + 128264
GEN_IDS = (
    "concat("
    "transform(array_repeat(0, CAST(event_id % 4 AS INT)), (x, j) -> CAST(128000 + j AS BIGINT)), "
    f"transform(array_repeat(0, {UTT_N_CODES}), (x, i) -> CASE "
    "WHEN (event_id + i) % 97 = 0 THEN CAST(128261 AS BIGINT) "
    "WHEN (event_id + i) % 13 = 0 THEN CAST(193800 + i % 3 AS BIGINT) "
    "WHEN (event_id + i) % 29 = 0 THEN CAST(128263 AS BIGINT) "
    "ELSE CAST((event_id * 7919 + i * 104729) % 65536 + 128264 AS BIGINT) END))"
)


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``utt_id, speaker, event_type, codes array<int>`` from ``events``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("utt_id"),
        F.col("user_id").alias("speaker"),
        "event_type",
        F.expr(UTT_CODES).alias("codes"),
    )


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``utt_id, prompt_len, ids array<bigint>``: model output stand-in."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("utt_id"),
        F.expr("CAST(event_id % 4 AS INT)").alias("prompt_len"),
        F.expr(GEN_IDS).alias("ids"),
    )


# --- sentences: one per conversation turn ----------------------------------
# codes NULL for system turns; n = 0 when turn % 4 = 3 else (conv_id + 5 turn) % 30;
# code[i] = (conv_id * 31 + turn * 7 + i + 1) % 65536
SENT_CODES = (
    "CASE WHEN role = 'system' THEN CAST(NULL AS ARRAY<INT>) ELSE "
    "transform(array_repeat(0, CAST(CASE WHEN turn % 4 = 3 THEN 0 ELSE (conv_id + turn * 5) % 30 END AS INT)), "
    "(x, i) -> CAST((conv_id * 31 + turn * 7 + i + 1) % 65536 AS INT)) END"
)
# codes encoded from a script's reference audio: 8 codes, none when conv_id % 3 = 0
REF_AUDIO_CODES = (
    "CASE WHEN conv_id % 3 = 0 THEN CAST(NULL AS ARRAY<INT>) ELSE "
    "transform(array_repeat(0, 8), (x, i) -> CAST((conv_id * 13 + i) % 65536 AS INT)) END"
)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``script_id, pos, role, text, codes`` from ``conversations``."""
    cv = table(spark, sf_dir, "conversations")
    return cv.select(
        F.col("conv_id").alias("script_id"),
        F.col("turn").alias("pos"),
        "role",
        "text",
        F.expr(SENT_CODES).alias("codes"),
    )


def script_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caller's reference per script: ``script_id, ref_text, ref_codes``."""
    cv = table(spark, sf_dir, "conversations")
    return (
        cv.where(F.col("turn") == 0)
        .select(
            F.col("conv_id").alias("script_id"),
            F.lit(None).cast("string").alias("ref_text"),
            F.expr(REF_AUDIO_CODES).alias("ref_codes"),
        )
    )


# --- manifest lines: one per document, plus edge lines ---------------------
MANIFEST_LINE = "concat(lang, '_', CAST(n_chars AS STRING), ': ', source, '-', CAST(doc_id AS STRING), ' :', lang)"
# (line_key, line): parsing edge cases, unioned with the document lines
MANIFEST_EDGE_LINES = (
    (-9, "\tid9\t:\ttext9 : extra"),
    (-8, "a:second"),
    (-7, "nocolon"),
    (-6, "\u3000id6\u3000:\u3000text6\u3000"),
    (-5, "a: :z"),
    (-4, ""),
    (-3, ":y"),
    (-2, "x:"),
    (-1, " a : b "),
)


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_key bigint, line string``."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("line_key"), F.expr(MANIFEST_LINE).alias("line"))
    edge = spark.createDataFrame(list(MANIFEST_EDGE_LINES), "line_key bigint, line string")
    return lines.unionByName(edge)


# --- audio inventory: one file per labelled document -----------------------
AUDIO_DIR = "/corpus/wavs"
INVENTORY_PATH = (
    f"concat('{AUDIO_DIR}/', d.lang, '_', CAST(d.n_chars AS STRING), "
    "CASE WHEN l.toxic = 1 THEN '.flac' ELSE '.wav' END)"
)
# codes of an audio file: n = n_chars % 23, code[i] = (n_chars * 7 + i * 31) % 65536
AUDIO_CODES = (
    "transform(array_repeat(0, CAST(n_chars % 23 AS INT)), "
    "(x, i) -> CAST((n_chars * 7 + i * 31) % 65536 AS INT))"
)


def audio_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, length, n_chars``: what a ``binaryFile`` listing returns
    (without content), one row per distinct file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").alias("d")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").alias("l")
    inv = docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id"))
    return inv.select(
        F.expr(INVENTORY_PATH).alias("path"),
        (F.col("d.n_chars") * 32 + 44).alias("length"),
        F.col("d.n_chars").alias("n_chars"),
    ).distinct()


def audio_codes(inventory: DataFrame) -> DataFrame:
    """Adds the codec output per audio file (stand-in for the encoder): ``code``."""
    return inventory.withColumn("code", F.expr(AUDIO_CODES))


# --- reference embeddings ---------------------------------------------------
TARGET_VEC_ID = 0
REF_PATH = "concat('/refs/', CAST(label AS STRING), '/v', CAST(vec_id DIV 2 AS STRING), '.wav')"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, path, embedding``: every embedding is a reference file."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", F.expr(REF_PATH).alias("path"), "embedding")


# --- synthesis requests: one per conversation turn -------------------------
REQ_FORMAT = (
    "CASE (conv_id + turn) % 8 WHEN 0 THEN 'mp3' WHEN 1 THEN 'opus' WHEN 2 THEN 'aac' "
    "WHEN 3 THEN 'flac' WHEN 4 THEN 'wav' WHEN 5 THEN 'pcm' WHEN 6 THEN 'ogg' ELSE NULL END"
)
REQ_SPEED = "CASE WHEN turn = 5 THEN NULL ELSE CAST((conv_id + turn) % 18 AS DOUBLE) / 4 END"
REQ_TEMPERATURE = "CAST(conv_id % 23 AS DOUBLE) / 10"
REQ_TOP_P = "CAST((conv_id * 3 + turn) % 12 AS DOUBLE) / 10"
REQ_REPEAT_PENALTY = "CAST(turn % 6 AS DOUBLE) / 2"
REQ_MAX_TOKENS = "CAST((conv_id * 97 + turn * 13) % 2100 AS INT)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = table(spark, sf_dir, "conversations")
    return cv.select(
        "conv_id",
        "turn",
        F.lit(None).cast("string").alias("model"),
        F.col("text").alias("input"),
        F.lit(None).cast("string").alias("voice"),
        F.expr(REQ_FORMAT).alias("response_format"),
        F.expr(REQ_SPEED).alias("speed"),
        F.expr(REQ_TEMPERATURE).alias("temperature"),
        F.expr(REQ_TOP_P).alias("top_p"),
        F.expr(REQ_REPEAT_PENALTY).alias("repeat_penalty"),
        F.expr(REQ_MAX_TOKENS).alias("max_tokens"),
        F.lit(None).cast("string").alias("reference_text"),
        F.lit(None).cast("string").alias("reference_audio"),
    )


# --- model server responses: one per event ---------------------------------
RESP_STATUS = "CASE WHEN event_id % 17 = 0 THEN 500 ELSE 200 END"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``utt_id, status, body``: completion responses as the server sends them."""
    from ..functions.tokens import render_speech_tokens

    u = utterances(spark, sf_dir)
    text = F.when(F.array_size("codes") == 0, F.lit("")).otherwise(
        F.concat(F.col("event_type"), render_speech_tokens("codes"), F.lit(" <|s_|>"))
    )
    body = F.concat(F.lit('{"choices":[{"text":"'), text, F.lit('"}]}'))
    return u.select("utt_id", F.expr(RESP_STATUS.replace("event_id", "utt_id")).alias("status"),
                    body.alias("body"))


# --- waveforms: one short clip per event -----------------------------------
# frames = 1 + event_id % 50; left[j] = (event_id * 31 + j * 17) % 2001 - 1000,
# right[j] = (event_id * 17 + j * 31) % 4001 - 2000 (16-bit PCM values)
WAVE_FRAMES = "CAST(1 + event_id % 50 AS INT)"
WAVE_LEFT = f"transform(array_repeat(0, {WAVE_FRAMES}), (x, j) -> CAST((event_id * 31 + j * 17) % 2001 - 1000 AS INT))"
WAVE_RIGHT = f"transform(array_repeat(0, {WAVE_FRAMES}), (x, j) -> CAST((event_id * 17 + j * 31) % 4001 - 2000 AS INT))"
# header variety for the lint query
WAVE_RATE = "CASE event_id % 4 WHEN 0 THEN 8000 WHEN 1 THEN 16000 WHEN 2 THEN 22050 ELSE 44100 END"
WAVE_CHANNELS = "CAST(1 + event_id % 2 AS INT)"
WAVE_BITS = "CASE (event_id DIV 2) % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 24 ELSE 32 END"


def waveforms(spark: SparkSession, sf_dir: str, varied: bool = False) -> DataFrame:
    """``utt_id, sample_rate, bits, channels array<array<int>>`` from ``events``.

    ``varied=False``: 16 kHz, 16-bit, stereo.  ``varied=True``: the rate,
    channel count and sample width vary by row (for header checks)."""
    ev = table(spark, sf_dir, "events")
    if varied:
        chans = F.expr(f"CASE WHEN {WAVE_CHANNELS} = 1 THEN array({WAVE_LEFT}) "
                       f"ELSE array({WAVE_LEFT}, {WAVE_RIGHT}) END")
        rate, bits = F.expr(WAVE_RATE), F.expr(WAVE_BITS)
    else:
        chans = F.expr(f"array({WAVE_LEFT}, {WAVE_RIGHT})")
        rate, bits = F.lit(16000), F.lit(16)
    return ev.select(
        F.col("event_id").alias("utt_id"),
        rate.cast("int").alias("sample_rate"),
        bits.cast("int").alias("bits"),
        chans.alias("channels"),
    )


# --- level clips: 400 equal frames at one of four rates, one per event --------
LEVEL = "(event_id % 7 + 1) * 4000"
LEVEL_RATE = "CASE event_id % 4 WHEN 0 THEN 8000 WHEN 1 THEN 16000 WHEN 2 THEN 22050 ELSE 44100 END"


def level_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``utt_id, sample_rate, bits, channels`` of one channel."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("utt_id"), F.expr(LEVEL_RATE).alias("sample_rate"), F.lit(16).alias("bits"),
        F.expr(f"array(array_repeat(CAST({LEVEL} AS INT), 400))").alias("channels"))


# --- varied clips: 400 different frames at one of four rates, one per event ----
VARIED_FRAMES = 400
VARIED = f"transform(sequence(0, {VARIED_FRAMES - 1}), j -> CAST((event_id * 31 + j * j * 17) % 20011 - 10005 AS INT))"


CLIPS_A_TASK = 8192  # some 13 MB of samples


def varied_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``utt_id, sample_rate, bits, channels`` of one channel, dealt by
    ``utt_id`` before the channels are made: what follows by id moves no audio.
    The number of tasks is set by the rows, as the ids are far smaller than
    the clips and would be put together in a few tasks."""
    ids = table(spark, sf_dir, "events").select("event_id")
    tasks = max(spark.sparkContext.defaultParallelism, -(-ids.count() // CLIPS_A_TASK))
    return ids.repartition(tasks, "event_id").select(
        F.col("event_id").alias("utt_id"), F.expr(LEVEL_RATE).alias("sample_rate"), F.lit(16).alias("bits"),
        F.array(F.expr(VARIED)).alias("channels"))


# --- audio files: a clip per supplier, 2 channels at 16 kHz ------------------
SUPPLIER_FILE = "concat('s', CAST(s_suppkey % 5 AS STRING), '/_', CAST(s_suppkey AS STRING), '.x')"


def supplier_clips(suppliers: DataFrame) -> DataFrame:
    """``file_id, sample_rate, bits, channels``; ids have folders, dots and a
    leading underscore in the name."""
    left, right = (w.replace("event_id", "s_suppkey") for w in (WAVE_LEFT, WAVE_RIGHT))
    return suppliers.select(
        F.expr(SUPPLIER_FILE).alias("file_id"), F.lit(16000).alias("sample_rate"), F.lit(16).alias("bits"),
        F.expr(f"array({left}, {right})").alias("channels"))


# --- Japanese edge texts for normalization (unioned with documents) ---------
# (doc_id, text): plain sentences, one row per normalization step and the
# non-idempotent case.
TEXT_EDGE_ROWS = (
    (-1, "山の上に、白い雲が見えます。"),
    (-2, "明日は早く起きよう！"),
    (-3, "走って！電車がもう来るよ！"),
    (-4, "駅まで歩きました。"),
    (-5, "図書館は、何時に開きますか。"),
    (-6, "タブ\tと[n]改行　全角 スペース"),
    (-7, "[ n]と[\tn]"),
    (-8, "記号;▼♀♂《》≪≫\ue63e①②③④⑤⑥です"),
    (-9, "ダッシュ˗‐‑‒–—―⁃−⎯⏤─━⸺⸻"),
    (-10, "波～と〜？！●◯〇♥"),
    (-11, "ＡＢＣｘｙｚ０１２９"),
    (-12, "ｱｲｳｴｵｶﾞ｡｢｣､･ｦｰﾟ"),
    (-13, "えっ…………と……と…"),
    (-14, "……-……"),
    (-15, "絵文字\U0001f600と改行\nと空"),
    (-16, ""),
    (-17, "々ゝゞヽヾ㐀䶿一龥"),
    (-18, "♪♡○。、!?…abcXYZ"),
)


# ASCII letters as half-width kana and sound marks
KANA_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ｱｶｻﾞﾀﾊﾟﾜｦｳﾝｯｰ｡､･ﾎﾍﾞﾃﾄｼﾌﾟｺｷ")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: all documents plus the Japanese edge rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edge = spark.createDataFrame(list(TEXT_EDGE_ROWS), "doc_id bigint, text string")
    return docs.unionByName(edge)
