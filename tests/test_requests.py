import json

import pytest
from pyspark.sql import functions as F

from vocaframe import constants as K
from vocaframe.functions import inference_prompt
from vocaframe.operators.metrics import metrics_by, utterance_metrics
from vocaframe.operators.requests import completion_payload, parse_responses, route_payloads, validate_requests

COLS = ("id long, input string, response_format string, speed double, temperature double, top_p double, "
        "repeat_penalty double, max_tokens int")


def viol(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    return {r.id: list(r.violations) for r in validate_requests(df).collect()}


def test_bounds_each_side(spark):
    rows = [
        (0, "テスト", None, None, None, None, None, None),  # all defaults
        (1, "テスト", "wav", 0.25, 0.0, 0.0, 0.0, 1),  # lower bounds
        (2, "テスト", "pcm", 4.0, 2.0, 1.0, 2.0, 2048),  # upper bounds
        (3, "テスト", "ogg", 0.2499, -0.01, -0.1, -0.1, 0),  # just below
        (4, "テスト", "mp3", 4.01, 2.01, 1.01, 2.01, 2049),  # just above
        (5, None, None, None, None, None, None, None),  # input missing
        (6, "!!!", None, None, None, None, None, None),  # "!!" survives normalization
        (7, "abc é", None, None, None, None, None, None),
        (8, "é ü", None, None, None, None, None, None),  # empty after normalization
    ]
    v = viol(spark, rows)
    assert v[0] == [] and v[1] == [] and v[2] == []
    below = ["response_format", "speed", "temperature", "top_p", "repeat_penalty", "max_tokens"]
    assert v[3] == below
    assert v[4] == below[1:]
    assert v[5] == ["input", "empty_after_normalization"]
    assert v[6] == [] and v[7] == []
    assert v[8] == ["empty_after_normalization"]


def test_defaults_filled(spark):
    df = spark.createDataFrame([(0, "あ", None, None, None, None, None, None)], COLS)
    r = validate_requests(df).first()
    for k, v in K.REQUEST_DEFAULTS.items():
        assert getattr(r, k) == v


def test_payload(spark):
    df = spark.createDataFrame([(0, "こんにちは……-……", None, None, None, None, None, None)], COLS)
    p = route_payloads(validate_requests(df)).first()
    body = json.loads(p.payload)
    assert body["prompt"].startswith(K.PROMPT_HEAD)  # BOS stripped
    assert "……<|TEXT" in body["prompt"]  # normalized twice: four ellipses became two
    assert body["max_tokens"] == K.HTTP_ROUTE_MAX_TOKENS
    assert body["repetition_penalty"] == body["repeat_penalty"] == 1.1
    assert body["stop_token_ids"] == [K.SPEECH_END_ID] and body["stream"] is False
    assert body["min_tokens"] == 0 and list(body)[0] == "prompt"


def test_payload_keeps_prompt_without_bos(spark):
    df = spark.createDataFrame([("x",)], "t string")
    j = df.select(completion_payload(F.lit("no bos"), F.lit(0.5), F.lit(0.8), F.lit(1.0), F.lit(10),
                                     extra={"tag": "x"})).first()[0]
    assert json.loads(j)["prompt"] == "no bos" and list(json.loads(j))[0] == "tag"


def test_parse_responses(spark):
    rows = [
        (0, 200, json.dumps({"choices": [{"text": "<|s_1|>x<|s_2|>"}]})),
        (1, 500, "oops"),
        (2, 200, json.dumps({"choices": [{"text": ""}]})),
        (3, 200, json.dumps({"choices": [{"text": "no tokens"}]})),
    ]
    df = spark.createDataFrame(rows, "id long, status int, body string")
    got = {r.id: (r.error, r.speech_ids) for r in parse_responses(df).collect()}
    assert got == {0: (None, [1, 2]), 1: ("api_error", None), 2: ("empty_response", None), 3: (None, [])}


def test_metrics(spark):
    df = spark.createDataFrame([("a", [1, 2, 3]), ("a", []), ("b", [5] * 50)], "spk string, codes array<int>")
    m = {r.spk: r for r in metrics_by(utterance_metrics(df), "spk").collect()}
    assert m["a"].total_tokens == 3 and m["a"].n_empty == 1 and m["a"].total_seconds == pytest.approx(0.06)
    assert m["b"].tokens_per_second == pytest.approx(50.0)
