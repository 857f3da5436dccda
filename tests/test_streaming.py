import os

import pytest
from pyspark.sql import functions as F

from vocaframe.streaming import prompt_stream, stream_training_prompts
from vocaframe.functions import training_prompt

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmpdir_path):
    out = stream_training_prompts(spark, SF, os.path.join(tmpdir_path, "s"))
    batch = spark.read.parquet(f"{SF}/conversations.parquet")
    from vocaframe.plans import standins as S

    exp = batch.select("conv_id", "turn", training_prompt("text", F.expr(S.SENT_CODES)).alias("prompt"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, exp.collect()))


def test_prompt_stream_on_streaming_frame(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    spark.createDataFrame([("こんにちは", [1, 2])], "text string, codes array<int>").write.parquet(src)
    stream = spark.readStream.schema("text string, codes array<int>").parquet(src)
    assert stream.isStreaming
    q = prompt_stream(stream).writeStream.format("memory").queryName("vf_prompts").trigger(availableNow=True) \
        .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).start()
    q.awaitTermination()
    rows = spark.sql("SELECT prompt FROM vf_prompts").collect()
    assert rows[0].prompt.endswith("<|s_1|><|s_2|><|SPEECH_GENERATION_END|>")


def test_request_and_response_steps_on_a_stream(spark, tmpdir_path):
    import json

    from vocaframe.operators.requests import parse_responses, validate_requests

    src = os.path.join(tmpdir_path, "req")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w", encoding="utf-8") as f:
        f.write(json.dumps({"input": "こんにちは", "speed": 5.0}) + "\n")
        f.write(json.dumps({"input": "éé", "response_format": "wav"}) + "\n")
    stream = spark.readStream.schema("input string, speed double, response_format string").json(src)
    q = (validate_requests(stream).select("input", "violations").writeStream.format("memory")
         .queryName("vf_requests").trigger(availableNow=True)
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck1")).start())
    q.awaitTermination()
    got = {r.input: list(r.violations) for r in spark.sql("SELECT * FROM vf_requests").collect()}
    assert got == {"こんにちは": ["speed"], "éé": ["empty_after_normalization"]}

    rsrc = os.path.join(tmpdir_path, "resp")
    os.makedirs(rsrc)
    with open(os.path.join(rsrc, "r.json"), "w") as f:
        f.write(json.dumps({"status": 200, "body": json.dumps({"choices": [{"text": "<|s_4|><|s_5|>"}]})}) + "\n")
    rs = spark.readStream.schema("status int, body string").json(rsrc)
    q = (parse_responses(rs).select("speech_ids").writeStream.format("memory").queryName("vf_responses")
         .trigger(availableNow=True).option("checkpointLocation", os.path.join(tmpdir_path, "ck2")).start())
    q.awaitTermination()
    assert spark.sql("SELECT * FROM vf_responses").first().speech_ids == [4, 5]


def test_last_text_per_id_over_batches(spark, tmpdir_path):
    """Files arrive out of order, one a batch; an id is in several, one is hot."""
    from vocaframe.operators.manifest import last_text_per_id, parse_manifest
    from vocaframe.streaming import latest_texts, stream_last_texts

    src, out = os.path.join(tmpdir_path, "lines"), os.path.join(tmpdir_path, "out")
    columns = "file_id string, text string, first_key long, n_lines long"
    rows = [(i, f"{'hot' if i % 3 else i % 10}:text {i}") for i in range(200)] + [(200, "no separator"), (201, ""), (202, None), (203, ":x"), (204, "one:a"), (204, "one:a")]

    def run():
        lines = spark.readStream.schema("line_key long, line string").option("maxFilesPerTrigger", 1).parquet(src)
        stream_last_texts(lines, out).awaitTermination()
        return sorted(map(tuple, latest_texts(spark, out, columns).collect()))

    def want(part):
        return sorted(map(tuple, last_text_per_id(parse_manifest(spark.createDataFrame(part, "line_key long, line string"))).collect()))

    late, early = rows[80:], rows[:80]
    spark.createDataFrame(late, "line_key long, line string").repartition(3).write.parquet(src)
    assert run() == want(late)
    spark.createDataFrame(early, "line_key long, line string").repartition(2).write.mode("append").parquet(src)
    assert run() == want(rows)
    assert run() == want(rows)
    assert latest_texts(spark, os.path.join(tmpdir_path, "none"), columns).count() == 0


def test_scripts_over_batches(spark, tmpdir_path):
    """Sentences over several runs: equal to the batch operators; late rows,
    references, ends, nulls, a hot script."""
    from vocaframe.operators.segments import chain_context, stitch_offsets
    from vocaframe.streaming import stream_stitched

    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    schema = "script_id string, pos long, text string, codes array<int>, ended boolean, other int"
    codes = lambda s, p: None if p % 5 == 4 else list(range(p * 7 % 40))
    rows = [(s, p, f"{s}{p}", codes(s, p), False, 1) for s, n in (("a", 9), ("hot", 300), ("one", 1)) for p in range(n)]
    rows += [("gap", p, f"gap{p}", list(range(20)), None, 1) for p in (0, 5, 6)] + [("empty", 0, "", None, False, 1)]
    runs = [
        [("a", -1, "ref", [9] * 30, False, 0)] + [r for r in rows if r[1] < 3],
        [r for r in rows if 3 <= r[1] < 100] + [("a", 2, "late", [1], False, 0), ("a", 3, "a3", codes("a", 3), False, 0), (None, 1, "x", None, False, 0), ("a", None, "no place", None, False, 0)],
        [r for r in rows if r[1] >= 100] + [(s, None, None, None, True, 0) for s in ("a", "one", "gap", "empty", "never")],
        [("a", 50, "after the end", [1], False, 0), ("hot", None, None, None, True, 0), ("a", None, None, None, True, 0)],
    ]
    for run in runs:
        spark.createDataFrame(run, schema).repartition(3).write.mode("append").parquet(src)
        stream_stitched(spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(src), out).awaitTermination()
    got = spark.read.parquet(out + "/data")
    late = sorted((r.script_id, -1 if r.pos is None else r.pos) for r in got.where("late").collect())
    assert late == [("a", -1), ("a", 2), ("a", 3), ("a", 50)]
    script = spark.createDataFrame([r[:4] for r in rows], "script_id string, pos long, text string, codes array<int>")
    want = stitch_offsets(script, block=4)
    on_time = got.where("not late")
    columns = ["script_id", "pos", "is_last", "kept", "n_kept", "start_seq", "total", "decodable"]
    assert sorted(map(repr, on_time.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    assert on_time.where("script_id = 'a'").count() == 9
    refs = spark.createDataFrame([("a", "ref", [9] * 30)], "script_id string, ref_text string, ref_codes array<int>")
    columns = ["script_id", "pos", "context_text", "context_codes"]
    assert sorted(map(repr, on_time.select(columns).collect())) == sorted(map(repr, chain_context(script, refs, block=4).select(columns).collect()))


def test_scripts_of_an_empty_stream(spark, tmpdir_path):
    from vocaframe.streaming import STITCHED, stream_stitched

    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    schema = "script_id long, pos int, text string, codes array<int>, ended boolean"
    spark.createDataFrame([], schema).write.parquet(src)
    stream_stitched(spark.readStream.schema(schema).parquet(src), out).awaitTermination()
    assert spark.read.schema(STITCHED.format(key="long")).parquet(out + "/data").count() == 0


@pytest.mark.parametrize("files", [1, 3])
def test_prompts_of_a_table_that_is_a_folder(spark, tmpdir_path, files):
    rows = [(i // 3, i % 3, "user", f"text {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df.repartition(files).write.parquet(os.path.join(tmpdir_path, "conversations.parquet"))
    got = stream_training_prompts(spark, tmpdir_path, os.path.join(tmpdir_path, "s"))
    from vocaframe.plans import standins as S

    exp = df.select("conv_id", "turn", training_prompt("text", F.expr(S.SENT_CODES)).alias("prompt"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_prompts_of_an_empty_table(spark, tmpdir_path):
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(os.path.join(tmpdir_path, "conversations.parquet"))
    assert stream_training_prompts(spark, tmpdir_path, os.path.join(tmpdir_path, "s")).columns[-1] == "prompt"
