"""Synthesis requests: validation, model-server payloads, response decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.prompts import inference_prompt, strip_bos
from ..functions.text import normalize_text
from ..functions.tokens import extract_speech_ids

_TYPES = {
    "model": "string",
    "voice": "string",
    "response_format": "string",
    "speed": "double",
    "temperature": "double",
    "top_p": "double",
    "repeat_penalty": "double",
    "max_tokens": "int",
}


def validate_requests(df: DataFrame) -> DataFrame:
    """Fill defaults and list the violated constraints of every request.

    Adds the filled fields, ``input_norm`` (normalized once, as the route
    does before its emptiness check), ``violations`` (``array<string>``, in
    field order) and ``is_valid``.  Nothing is dropped: rejected requests
    stay visible with their reasons."""
    out = df
    for name, typ in _TYPES.items():
        default = F.lit(K.REQUEST_DEFAULTS[name]).cast(typ)
        if name not in df.columns:
            out = out.withColumn(name, default)
            continue
        # a value that is no number is a violation of its request, not an error
        src = F.col(name).try_cast(typ)
        bad = F.when(F.col(name).isNotNull() & src.isNull(), F.lit(name))
        out = out.withColumn(f"_bad_{name}", bad).withColumn(name, F.coalesce(src, default))
    out = out.withColumn("input_norm", normalize_text("input"))
    checks: list[Column] = [
        F.when(F.col("input").isNull(), F.lit("input")),
        F.when(~F.col("response_format").isin(*K.RESPONSE_FORMATS), F.lit("response_format")),
    ]
    for name, lo, hi in K.REQUEST_BOUNDS:
        typed = F.col(f"_bad_{name}") if name in df.columns else F.lit(None)
        checks.append(F.coalesce(typed, F.when(~F.col(name).between(lo, hi), F.lit(name))))
    checks.append(F.when(F.coalesce(F.length("input_norm"), F.lit(0)) == 0, F.lit("empty_after_normalization")))
    out = out.withColumn("violations", F.filter(F.array(*checks), lambda x: x.isNotNull()))
    out = out.drop(*[f"_bad_{name}" for name in _TYPES])
    return out.withColumn("is_valid", F.array_size("violations") == 0)


def completion_payload(prompt: Column, temperature: Column, top_p: Column, repeat_penalty: Column,
                       max_tokens: Column, min_tokens: Column | None = None,
                       extra: dict[str, str] | None = None) -> Column:
    """JSON body of a completion request (both penalty spellings, the end id
    as stop token, no streaming).  The leading BOS is stripped first.
    ``extra``: constant string fields some servers expect (tags), put first."""
    if min_tokens is None:
        min_tokens = F.lit(K.GENERATION_DEFAULTS["min_tokens"])
    tags = [F.lit(v).alias(k) for k, v in (extra or {}).items()]
    return F.to_json(
        F.struct(
            *tags,
            strip_bos(prompt).alias("prompt"),
            temperature.cast("double").alias("temperature"),
            top_p.cast("double").alias("top_p"),
            max_tokens.cast("int").alias("max_tokens"),
            min_tokens.cast("int").alias("min_tokens"),
            repeat_penalty.cast("double").alias("repetition_penalty"),
            repeat_penalty.cast("double").alias("repeat_penalty"),
            F.array(F.lit(K.SPEECH_END_ID)).alias("stop_token_ids"),
            F.lit(False).alias("stream"),
        )
    )


def route_payloads(validated: DataFrame) -> DataFrame:
    """Payloads the speech route sends for its valid requests.

    The route normalizes the input, and the prompt builder normalizes it a
    second time; the route then uses the generation defaults and a fixed
    token limit, whatever the request asked for."""
    d = K.GENERATION_DEFAULTS
    v = validated.where("is_valid")
    prompt = inference_prompt(F.col("input_norm"))  # second normalization inside
    return v.select(
        "*",
        completion_payload(prompt, F.lit(d["temperature"]), F.lit(d["top_p"]), F.lit(d["repeat_penalty"]),
                           F.lit(K.HTTP_ROUTE_MAX_TOKENS)).alias("payload"),
    )


def parse_responses(df: DataFrame, status_col: str = "status", body_col: str = "body") -> DataFrame:
    """Decode completion responses: ``text``, ``error`` and ``speech_ids``.

    Status other than 200, or none, is an API error; an empty or missing text
    is an error; so is an id beyond 64 bits (``bad_speech_id``); otherwise the
    ids are every ``<|s_N|>`` in the text."""
    text = F.get_json_object(F.col(body_col), "$.choices[0].text")
    out = df.withColumn("text", text).withColumn("_ids", extract_speech_ids("text"))
    err = (
        F.when(~F.col(status_col).eqNullSafe(200), F.lit("api_error"))
        .when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit("empty_response"))
        .when(F.exists("_ids", lambda x: x.isNull()), F.lit("bad_speech_id"))
    )
    out = out.withColumn("error", err)
    return out.withColumn("speech_ids", F.when(F.col("error").isNull(), F.col("_ids"))).drop("_ids")


def response_headers(df: DataFrame, format_col: str = "response_format", tokens_col: str = "n_tokens",
                     samples_col: str = "n_samples", rate_col: str = "sample_rate") -> DataFrame:
    """What the speech route sends with its audio: the media type (``mp3``
    is announced as ``audio/mpeg`` although the bytes are WAV; every other
    format as ``audio/wav``), the attachment name, the generated token count
    and the audio duration in seconds."""
    fmt = F.col(format_col)
    return df.select(
        "*",
        F.when(fmt == "mp3", F.lit("audio/mpeg")).otherwise(F.lit("audio/wav")).alias("content_type"),
        F.concat(F.lit("attachment; filename=speech."), fmt).alias("content_disposition"),
        F.col(tokens_col).cast("bigint").alias("generated_tokens"),
        F.try_divide(F.col(samples_col).cast("double"), F.col(rate_col).cast("double")).alias("audio_duration"),
    )
