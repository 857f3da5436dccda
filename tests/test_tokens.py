import random

from pyspark.sql import functions as F

from vocaframe import constants as K
from vocaframe.functions import (
    decode_generated_ids,
    extract_speech_ids,
    format_code_list,
    parse_code_list,
    render_speech_tokens,
    to_token_ids,
)


def ref_decode(ids, prompt_len):
    out = []
    for t in ids[prompt_len:]:
        if t == K.SPEECH_END_ID:
            break
        if K.SPEECH_ID_OFFSET <= t < K.SPEECH_ID_OFFSET + K.CODEBOOK_SIZE:
            out.append(t - K.SPEECH_ID_OFFSET)
    return out


def test_render_extract_identity(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(0, 65535) for _ in range(n)]) for i, n in enumerate([0, 1, 15, 16, 17, 300])]
    df = spark.createDataFrame(rows, "id long, codes array<int>")
    out = df.select("id", "codes", render_speech_tokens("codes").alias("s"),
                    extract_speech_ids(render_speech_tokens("codes")).alias("back")).orderBy("id").collect()
    for r in out:
        assert r.s == "".join(f"<|s_{c}|>" for c in r.codes)
        assert r.back == r.codes


def test_extract_with_noise(spark):
    df = spark.createDataFrame([("a<|s_1|> b<|s_|><|s_22|>zz<|s_x|><|s_3", ), ("",)], "s string")
    got = [r[0] for r in df.select(extract_speech_ids("s")).collect()]
    assert got == [[1, 22], []]


def test_null_and_empty_codes_render_nothing(spark):
    df = spark.createDataFrame([(None,), ([],)], "codes array<int>")
    assert [r[0] for r in df.select(render_speech_tokens("codes")).collect()] == ["", ""]


def test_decode_generated(spark):
    end = K.SPEECH_END_ID
    base = K.SPEECH_ID_OFFSET
    cases = [
        ([1, 2, base + 5, base + 6], 2),  # no end marker
        ([1, end, base + 5], 1),  # end first
        ([1, base + 5, end], 1),  # end last
        ([base + 1, end, base + 2, end], 0),  # twice
        ([base - 1, base, base + 65535, base + 65536, 128262], 0),  # range bounds
        ([1, 2], 5),  # prompt longer than ids
        ([], 0),
    ]
    df = spark.createDataFrame([(i, ids, p) for i, (ids, p) in enumerate(cases)],
                               "i int, ids array<bigint>, p int")
    got = df.select("i", decode_generated_ids("ids", "p").alias("c")).orderBy("i").collect()
    for (ids, p), r in zip(cases, got):
        assert r.c == ref_decode(ids, p)


def test_to_token_ids(spark):
    df = spark.createDataFrame([([0, 65535],)], "c array<int>")
    assert df.select(to_token_ids("c")).first()[0] == [K.SPEECH_ID_OFFSET, K.SPEECH_ID_OFFSET + 65535]


def py_parse(t):
    try:
        return [int(x.strip("[").strip("]").strip()) for x in t.split(",")]
    except ValueError:
        return None


def test_code_list_format_and_parse(spark):
    rows = [[1, 2, 3], [7], [], None]
    df = spark.createDataFrame([(r,) for r in rows], "c array<int>")
    got = df.select(format_code_list("c").alias("s")).collect()
    assert [r.s for r in got] == [str(r) if r is not None else None for r in rows]
    texts = ["[1, 2, 3]", "[]", "[ 1 ]", "1,2", " [1", "]5 [", "[5 ]", "[ ] [", "x", "[1,,2]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_code_list("t", strict=False)).collect()]
    assert got == [py_parse(t) for t in texts]


def test_parse_strict_raises(spark):
    import pytest

    df = spark.createDataFrame([("[1, x]",)], "t string")
    with pytest.raises(Exception):
        df.select(parse_code_list("t", strict=True)).collect()


def test_parse_random(spark):
    rng = random.Random(5)
    alphabet = list("[] ,5\t-") + ["12", "\u3000", "+3"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", parse_code_list("t", strict=False).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == py_parse(t), t


def test_ids_beyond_int_range(spark):
    df = spark.createDataFrame([("<|s_99999999999|><|s_007|>",)], "s string")
    assert df.select(extract_speech_ids("s")).first()[0] == [99999999999, 7]


def test_non_ansi_session_gives_same_results(spark):
    from vocaframe.operators.segments import stitch_offsets

    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = spark.createDataFrame([(0, 0, None), (0, 1, [1] * 20), (1, 0, None)],
                                   "script_id long, pos long, codes array<int>")
        got = {(r.script_id, r.pos): (r.n_kept, r.start_seq, r.total) for r in stitch_offsets(df).collect()}
        assert got == {(0, 0): (0, 0, None), (0, 1): (20, 0, 20), (1, 0): (0, 0, 0)}
        import pytest

        bad = spark.createDataFrame([("[1, x]",)], "t string")
        with pytest.raises(Exception):
            bad.select(parse_code_list("t", strict=True)).collect()
        assert bad.select(parse_code_list("t", strict=False)).first()[0] is None
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
