import os

import pytest
from pyspark.sql import functions as F

from vocaframe.functions import normalize_text
from vocaframe.operators.corpus import build_corpus, build_stored_corpus, store_by_id

# every half-width form: alone, before the voiced mark, before the half-voiced mark
FORMS = {
    "｡": ("。", "。゛", "。゜"), "､": ("、", "、゛", "、゜"), "ｰ": ("ー", "ー゛", "ー゜"),
    "｢": ("", "゛", "゜"), "｣": ("", "゛", "゜"), "･": ("・", "・゛", "・゜"),
    "ﾞ": ("゛", "゛゛", "゛゜"), "ﾟ": ("゜", "゜゛", "゜゜"),
    "ｳ": ("ウ", "ヴ", "ウ゜"), "ﾜ": ("ワ", "ヷ", "ワ゜"), "ｦ": ("ヲ", "ヺ", "ヲ゜"),
    "ｶ": ("カ", "ガ", "カ゜"), "ｷ": ("キ", "ギ", "キ゜"), "ｸ": ("ク", "グ", "ク゜"), "ｹ": ("ケ", "ゲ", "ケ゜"), "ｺ": ("コ", "ゴ", "コ゜"),
    "ｻ": ("サ", "ザ", "サ゜"), "ｼ": ("シ", "ジ", "シ゜"), "ｽ": ("ス", "ズ", "ス゜"), "ｾ": ("セ", "ゼ", "セ゜"), "ｿ": ("ソ", "ゾ", "ソ゜"),
    "ﾀ": ("タ", "ダ", "タ゜"), "ﾁ": ("チ", "ヂ", "チ゜"), "ﾂ": ("ツ", "ヅ", "ツ゜"), "ﾃ": ("テ", "デ", "テ゜"), "ﾄ": ("ト", "ド", "ト゜"),
    "ﾊ": ("ハ", "バ", "パ"), "ﾋ": ("ヒ", "ビ", "ピ"), "ﾌ": ("フ", "ブ", "プ"), "ﾍ": ("ヘ", "ベ", "ペ"), "ﾎ": ("ホ", "ボ", "ポ"),
}
PLAIN = dict(zip("ｧｨｩｪｫｬｭｮｯｱｲｴｵﾅﾆﾇﾈﾉﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾝ", "ァィゥェォャュョッアイエオナニヌネノマミムメモヤユヨラリルレロン"))


def test_all_half_width_forms_with_both_marks(spark):
    forms = FORMS | {a: (b, b + "゛", b + "゜") for a, b in PLAIN.items()}
    assert sorted(forms) == [chr(c) for c in range(0xFF61, 0xFFA0)]
    cases = [(a + mark, want[i]) for a, want in forms.items() for i, mark in enumerate(("", "ﾞ", "ﾟ"))]
    cases += [("ｶ ﾞｷ\tﾞｸ[n]ﾞ", "ガギグ"), ("カﾞ", "カ゛"), ("", ""), (None, None), ("ｶ▼ﾞ", "カ゛"), ("ﾊﾟﾊﾞﾊ", "パバハ")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, t string")
    for passes in (1, 2):
        got = [r.n for r in df.select("i", normalize_text("t", passes, kana="correct").alias("n")).orderBy("i").collect()]
        assert got == [w for _, w in cases]


def test_kana_is_shifted_by_default(spark):
    row = spark.createDataFrame([("ｶﾞ",)], "t string").select(normalize_text("t").alias("n")).first()
    assert row.n == "".join(chr(ord(c) - 0xFF61 + 0x30A1) for c in "ｶﾞ")
    with pytest.raises(ValueError):
        normalize_text(F.lit("x"), kana="other")


def test_stored_corpus_joins_without_an_exchange(spark, tmpdir_path):
    texts = spark.createDataFrame([(f"f{i}", f"t{i}") for i in range(50)] + [(None, "x")], "file_id string, text string")
    codes = spark.createDataFrame([(f"f{i}", [i] if i % 3 else None) for i in range(0, 60, 2)], "file_id string, code array<int>")
    name = "stored_" + os.path.basename(tmpdir_path).replace("-", "_")
    for part, df in (("texts", texts), ("codes", codes)):
        store_by_id(df, f"{name}_{part}", f"{tmpdir_path}/{part}", buckets=4)
    stored = build_stored_corpus(spark, f"{name}_texts", f"{name}_codes")
    want = build_corpus(texts, None, codes)
    assert stored.columns == want.columns
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, want.collect()))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_stored_corpus_of_empty_tables(spark, tmpdir_path):
    name = "empty_" + os.path.basename(tmpdir_path).replace("-", "_")
    store_by_id(spark.createDataFrame([], "file_id string, text string"), f"{name}_t", f"{tmpdir_path}/t", buckets=2)
    store_by_id(spark.createDataFrame([], "file_id string, code array<int>"), f"{name}_c", f"{tmpdir_path}/c", buckets=2)
    assert build_stored_corpus(spark, f"{name}_t", f"{name}_c").count() == 0
