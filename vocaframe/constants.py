"""Fixed values of the speech-token format.

Everything in this module must equal the values the original tool uses,
otherwise prompts, token strings and normalized text would differ from the
ones a model was trained on.  They are stated here once, as plain text, and
every other module derives its tables from them.
"""

from __future__ import annotations

# --- fixed values: prompt template -----------------------------------------
BOS_TOKEN = "<|begin_of_text|>"
PROMPT_HEAD = (
    "<|start_header_id|>system<|end_header_id|>\n"
    "\n"
    "Cutting Knowledge Date: December 2023\n"
    "Today Date: 02 Oct 2025\n"
    "\n"
    "<|eot_id|><|start_header_id|>user<|end_header_id|>\n"
    "\n"
    "Convert the text to speech:<|TEXT_UNDERSTANDING_START|>"
)
PROMPT_TAIL = (
    "<|TEXT_UNDERSTANDING_END|><|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
    "\n"
    "<|SPEECH_GENERATION_START|>"
)
SPEECH_START_MARKER = "<|SPEECH_GENERATION_START|>"
SPEECH_END_TOKEN = "<|SPEECH_GENERATION_END|>"
SPEECH_TOKEN_OPEN = "<|s_"
SPEECH_TOKEN_CLOSE = "|>"

# --- fixed values: vocabulary layout ----------------------------------------
SPEECH_ID_OFFSET = 128264  # token id of code 0
SPEECH_END_ID = 128261  # end-of-speech token id
CODEBOOK_SIZE = 65536  # number of audio codes
CONTEXT_TRIM = 16  # codes dropped from every sentence but the last when chaining
SAMPLE_RATE = 16000  # rate every waveform is brought to
CODEC_FRAME_SAMPLES = 320  # 16 kHz / 50 codes per second

# --- fixed values: synthesis request limits and defaults --------------------
RESPONSE_FORMATS = ("mp3", "opus", "aac", "flac", "wav", "pcm")
# model id filled in when a request names none; it is only echoed, never used
# to pick anything, so it is a deployment setting rather than a fixed value
DEFAULT_MODEL_ID = "tts-3b"
REQUEST_DEFAULTS = {
    "model": DEFAULT_MODEL_ID,
    "voice": "alloy",
    "response_format": "mp3",
    "speed": 1.0,
    "temperature": 0.7,
    "top_p": 0.9,
    "repeat_penalty": 1.1,
    "max_tokens": 300,
}
# (field, lower bound, upper bound), both inclusive
REQUEST_BOUNDS = (
    ("speed", 0.25, 4.0),
    ("temperature", 0.0, 2.0),
    ("top_p", 0.0, 1.0),
    ("repeat_penalty", 0.0, 2.0),
    ("max_tokens", 1, 2048),
)
# generation call defaults of the local / server client
GENERATION_DEFAULTS = {
    "temperature": 0.7,
    "top_p": 0.9,
    "repeat_penalty": 1.1,
    "max_tokens": 300,
    "min_tokens": 0,
}
HTTP_ROUTE_MAX_TOKENS = 4000  # the speech route sends this, whatever was asked

# --- fixed values: text normalization ---------------------------------------
# Applied in this order.  Steps 3-14 are single-character maps whose inputs are
# pairwise disjoint and whose outputs are never an input of a later step, so
# they are applied together by one translate.
NORM_DELETE_TAB = "\t"  # step 1
NORM_DELETE_LITERAL = "[n]"  # step 2
NORM_DELETE_CHARS = (
    "\u0020"  # step 3: space
    "\u3000"  # step 4: ideographic space
    ";▼♀♂《》≪≫\ue63e①②③④⑤⑥"  # step 5 (U+E63E is a private-use character)
    # step 6, written as escapes because they look alike: dashes U+02D7, 2010-2015, 2043, 2212, 23AF, 23E4, 2500, 2501, 2E3A, 2E3B
    "\u02d7\u2010\u2011\u2012\u2013\u2014\u2015\u2043\u2212\u23af\u23e4"
    "\u2500\u2501\u2e3a\u2e3b"
)
NORM_CHAR_MAP = (
    ("～", "ー"),  # step 7: fullwidth tilde -> long vowel mark
    ("〜", "ー"),  # step 7: wave dash -> long vowel mark
    ("？", "?"),  # step 8
    ("！", "!"),  # step 9
    ("●", "○"),  # step 10: black circle -> white circle
    ("◯", "○"),  # step 10: large circle -> white circle
    ("〇", "○"),  # step 10: ideographic zero -> white circle
    ("♥", "♡"),  # step 11: black heart -> white heart
)
# step 12: fullwidth A-Z (U+FF21-FF3A) and a-z (U+FF41-FF5A) -> ASCII
FULLWIDTH_UPPER = (0xFF21, 0xFF3A, 0x41)
FULLWIDTH_LOWER = (0xFF41, 0xFF5A, 0x61)
# step 13: fullwidth digits U+FF10-FF19 -> 0-9
FULLWIDTH_DIGITS = (0xFF10, 0xFF19, 0x30)
# step 14: halfwidth forms U+FF61-FF9E -> U+30A1-30DE by plain offset
# (a code-point shift, not a kana table: U+FF71 becomes U+30B1)
HALFWIDTH_KANA = (0xFF61, 0xFF9E, 0x30A1)
# step 15: three or more ellipses -> two
ELLIPSIS = "…"
# step 16: keep only these (inclusive code point ranges, then single characters)
NORM_KEEP_RANGES = (
    (0x3040, 0x309F),  # hiragana
    (0x30A0, 0x30FF),  # katakana
    (0x4E00, 0x9FFF),  # CJK unified ideographs
    (0x3400, 0x4DBF),  # CJK extension A
    (0x3005, 0x3005),  # iteration mark
    (0x41, 0x5A),  # A-Z
    (0x61, 0x7A),  # a-z
    (0x30, 0x39),  # 0-9
)
NORM_KEEP_CHARS = "。、!?…♪♡○"

# --- fixed values: Python str semantics -------------------------------------
# Characters for which str.isspace() is true (strip() removes them).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line boundaries of str.splitlines(); "\r\n" counts as one.
PY_LINE_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
