"""Normalization against results written by hand, one row for each rule; no
table of the library is used here."""

import pytest

from vocaframe.functions.text import normalize_text

ROWS = [
    ("タブ\tなし", "タブなし"),  # 1 tab
    ("改行[n]なし", "改行なし"),  # 2 literal [n]
    ("[ n]と[\tn]", "nと"),  # order: 1 makes the second [n], 2 deletes it; 3 leaves [n], 16 drops the brackets
    ("半角 空白", "半角空白"),  # 3
    ("全角　空白", "全角空白"),  # 4
    (";▼♀♂《》≪≫①②③④⑤⑥です", "です"),  # 5
    ("です", "です"),  # 5
    ("あ˗‐‑‒–—―⁃−⎯⏤─━⸺⸻い", "あい"),  # 6
    ("波～と〜", "波ーとー"),  # 7
    ("なに？", "なに?"),  # 8
    ("やあ！", "やあ!"),  # 9
    ("●◯〇", "○○○"),  # 10
    ("♥", "♡"),  # 11
    ("ＡＭＺａｍｚ", "AMZamz"),  # 12
    ("０５９", "059"),  # 13
    ("｡ｱﾞ", "ァケマ"),  # 14: U+FF61, FF71, FF9E moved by one offset
    ("えっ…………と", "えっ……と"),  # 15
    ("え…と……", "え…と……"),  # 15: two stay
    ("漢字々、カナ。!?♪♡○…abcXYZ09", "漢字々、カナ。!?♪♡○…abcXYZ09"),  # 16 keeps
    ("é@#\U0001f600()「」\n", ""),  # 16 drops
    ("㐀䶿一龥", "㐀䶿一龥"),  # 16 keeps
    ("", ""),
]


@pytest.mark.parametrize("raw,want", ROWS)
def test_rule(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(normalize_text("t")).first()[0] == want
