"""Property tests (hypothesis): each property is checked on a batch of
generated examples in one Spark job, to keep the JVM round trips few."""

from hypothesis import given, settings
from hypothesis import strategies as st

from vocaframe import constants as K
from vocaframe.functions import extract_speech_ids, normalize_text, render_speech_tokens
from vocaframe.operators.segments import stitch_offsets
from test_text import ref_norm

ALPHABET = (list(K.NORM_DELETE_CHARS) + [a for a, _ in K.NORM_CHAR_MAP] + list("[n]\t…あア漢aZ09。、!?♪♡○\n😀é")
            + [chr(c) for c in range(0xFF10, 0xFFA0, 7)])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=40), min_size=1, max_size=50))
def test_render_then_extract_is_identity(spark, batch):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(batch)], "i int, c array<int>")
    got = {r.i: r.back for r in df.select("i", extract_speech_ids(render_speech_tokens("c")).alias("back")).collect()}
    assert [got[i] for i in range(len(batch))] == batch


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(ALPHABET), max_size=30), min_size=1, max_size=50))
def test_normalized_text_matches_rules_and_whitelist(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", normalize_text("t").alias("n")).collect()}
    keep = set(K.NORM_KEEP_CHARS)
    for i, t in enumerate(batch):
        assert got[i] == ref_norm(t)
        assert all(ch in keep or any(lo <= ord(ch) <= hi for lo, hi in K.NORM_KEEP_RANGES) for ch in got[i])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=12), min_size=1, max_size=8),
       st.sampled_from([1, 2, 3, 1024]))
def test_stitched_length(spark, scripts, block):
    rows = [(s, p, [7] * n) for s, lens in enumerate(scripts) for p, n in enumerate(lens)]
    df = spark.createDataFrame(rows, "script_id long, pos long, codes array<int>")
    totals = {r.script_id: r.total for r in stitch_offsets(df, block=block).where("is_last").collect()}
    for s, lens in enumerate(scripts):
        assert totals[s] == sum(max(n - 16, 0) for n in lens[:-1]) + lens[-1]


LINE_ALPHABET = list("abx:| \t") + ["\u3000", "\x85", "\u2003"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(LINE_ALPHABET), max_size=12), min_size=1, max_size=60),
       st.sampled_from([(":", 0, 1), ("|", 1, 0), (":", -1, 0)]))
def test_manifest_parse_matches_python(spark, lines, spec):
    from vocaframe.operators.manifest import last_text_per_id, parse_manifest
    from test_manifest import py_parse

    sep, fi, ti = spec
    exp = py_parse(lines, sep, fi, ti)
    df = spark.createDataFrame(list(enumerate(lines)), "line_key long, line string")
    got = last_text_per_id(parse_manifest(df, sep, fi, ti)).orderBy("first_key").collect()
    assert [(r.file_id, r.text) for r in got] == list(exp.items())
