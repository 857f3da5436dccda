import random
import re

from pyspark.sql import functions as F

from vocaframe import constants as K
from vocaframe.functions import non_blank_lines, normalize_text, py_strip, text_preview, split_literal


def ref_norm(t):
    """Rule-by-rule restatement of one normalization pass (test oracle)."""
    t = t.replace("\t", "").replace("[n]", "")
    for ch in K.NORM_DELETE_CHARS:
        t = t.replace(ch, "")
    for a, b in K.NORM_CHAR_MAP:
        t = t.replace(a, b)
    for lo, hi, to in (K.FULLWIDTH_UPPER, K.FULLWIDTH_LOWER, K.FULLWIDTH_DIGITS, K.HALFWIDTH_KANA):
        t = t.translate({c: to + c - lo for c in range(lo, hi + 1)})
    t = re.sub("…{3,}", "……", t)
    keep = set(K.NORM_KEEP_CHARS)
    return "".join(ch for ch in t if ch in keep or any(lo <= ord(ch) <= hi for lo, hi in K.NORM_KEEP_RANGES))


def run(spark, rows, *exprs):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, t string")
    out = df.select("id", *exprs).orderBy("id").collect()
    return [tuple(r)[1:] for r in out]


def test_rules_one_by_one(spark):
    cases = {
        "a\tb": "ab",  # N1
        "x[n]y": "xy",  # N2
        "[\tn]": "",  # N1 before N2
        "[ n]": "n",  # N2 before N3: brackets go in N16
        "あ い　う": "あいう",  # N3, N4
        "あ;▼♀♂《》≪≫\ue63e①②③④⑤⑥い": "あい",  # N5 (U+E63E included)
        "あ˗‐―⁃−⎯⏤─━⸺⸻い": "あい",  # N6
        "～〜": "ーー",  # N7
        "？！": "?!",  # N8, N9
        "●◯〇♥": "○○○♡",  # N10, N11
        "ＡＺａｚ０９": "AZaz09",  # N12, N13
        "ｱ｡ﾞﾟ": "ケァマ",  # N14 is an offset; U+FF9F is dropped by N16
        "…………": "……",  # N15
        "……-……": "…………",  # one pass is not idempotent
        "😀\né": "",  # N16 drops emoji, newline, accents
        "々ゝヾ㐀一": "々ゝヾ㐀一",
        "": "",
    }
    rows = list(cases)
    got = run(spark, rows, normalize_text("t").alias("n"))
    for r, (g,) in zip(rows, got):
        assert g == cases[r], (r, g)


def test_two_passes(spark):
    got = run(spark, ["……-……"], normalize_text("t", 2).alias("n"))
    assert got[0][0] == "……"


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(normalize_text("t")).first()[0] is None


def test_random_strings_match_restatement(spark):
    alphabet = (list(K.NORM_DELETE_CHARS) + [a for a, _ in K.NORM_CHAR_MAP]
                + [chr(c) for c in range(0xFF10, 0xFFA0)] + list("[n] \t…あア漢abc019。、!?♪♡○\n😀é"))
    rng = random.Random(7)
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    got = run(spark, rows, normalize_text("t").alias("a"), normalize_text("t", 2).alias("b"))
    for r, (a, b) in zip(rows, got):
        assert a == ref_norm(r)
        assert b == ref_norm(ref_norm(r))


def test_whitelist_property(spark):
    rng = random.Random(3)
    rows = ["".join(chr(rng.randint(1, 0xFFFF)) for _ in range(50)) for _ in range(300)]
    rows = [r.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for r in rows]
    got = run(spark, rows, normalize_text("t").alias("n"))
    keep = set(K.NORM_KEEP_CHARS)
    for (g,) in got:
        assert all(ch in keep or any(lo <= ord(ch) <= hi for lo, hi in K.NORM_KEEP_RANGES) for ch in g)


def test_py_strip_matches_python(spark):
    ws = K.PY_WHITESPACE
    rows = [ws + "a b" + ws, "　x　", "\x1cq\x85", "", "  ", "a​b"]
    got = run(spark, rows, py_strip("t").alias("s"))
    assert [g for (g,) in got] == [r.strip() for r in rows]
    assert set(K.PY_WHITESPACE) == {chr(c) for c in range(0x10000) if chr(c).isspace()}


def test_split_literal_and_lines(spark):
    rows = ["a:b:c", "a:", ":", "", "a.b"]
    got = run(spark, rows, split_literal("t", ":").alias("p"))
    assert [g for (g,) in got] == [r.split(":") for r in rows]
    got = run(spark, ["a.b"], split_literal("t", ".").alias("p"))
    assert got[0][0] == ["a", "b"]
    texts = ["a\r\nb\rc\nd\x0be\x0cf\x1cg\x85h i j", " x \n\n  \n y", "", "\n", "a　\nb"]
    got = run(spark, texts, non_blank_lines("t").alias("l"))
    for t, (g,) in zip(texts, got):
        assert g == [s.strip() for s in t.splitlines() if s.strip()]


def test_preview(spark):
    rows = ["x" * 50, "y" * 51, "", "あ" * 60]
    got = run(spark, rows, text_preview("t").alias("p"))
    assert [g for (g,) in got] == [f"{r[:50]}{'...' if len(r) > 50 else ''}" for r in rows]
