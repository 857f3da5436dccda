"""Text functions as native Spark column expressions.

All of them compile to built-in expressions (translate, regexp_replace,
btrim, split), so they stay inside whole-stage codegen and need no Python
worker.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..util import col_of, ColumnOrName


def _range_map(lo: int, hi: int, to: int) -> tuple[str, str]:
    src = "".join(chr(c) for c in range(lo, hi + 1))
    dst = "".join(chr(to + i) for i in range(hi - lo + 1))
    return src, dst


VOICED, HALF_VOICED = "\uff9e", "\uff9f"  # the half-width sound marks
KANA = ("offset", "correct")


def half_width_kana() -> tuple[tuple[str, str], list[tuple[str, str]]]:
    """The half-width forms by their Unicode compatibility mapping: (matching,
    replace) of the single characters, a mark alone being a character of its
    own, and ``(letter and mark, one full-width character)`` pairs."""
    letters = [chr(c) for c in range(K.HALFWIDTH_KANA[0], ord(VOICED))]
    single = "".join(unicodedata.normalize("NFKC", c) for c in letters) + "\u309b\u309c"
    joined = [(c + mark, unicodedata.normalize("NFKC", c + mark)) for mark in (VOICED, HALF_VOICED) for c in letters]
    return ("".join(letters) + VOICED + HALF_VOICED, single), [(pair, full) for pair, full in joined if len(full) == 1]


def translate_tables(kana: str = "offset") -> tuple[str, str]:
    """(matching, replace) of the one translate that does steps 3-14.

    Mapped characters come first and line up with ``replace``; deleted
    characters follow and have no partner, which makes translate drop them.
    """
    src, dst = [], []
    for a, b in K.NORM_CHAR_MAP:
        src.append(a)
        dst.append(b)
    specs = [_range_map(*spec) for spec in (K.FULLWIDTH_UPPER, K.FULLWIDTH_LOWER, K.FULLWIDTH_DIGITS)]
    specs.append(_range_map(*K.HALFWIDTH_KANA) if kana == "offset" else half_width_kana()[0])
    for s, d in specs:
        src.append(s)
        dst.append(d)
    matching = "".join(src) + K.NORM_DELETE_CHARS
    replace = "".join(dst)
    assert len(set(matching)) == len(matching), "translate inputs must be disjoint"
    return matching, replace


# deleted by byte replace before the translate: by far the most frequent
FREQUENT_DELETIONS = ("\u0020", "\u3000")


def rare_translate_tables(kana: str = "offset") -> tuple[str, str]:
    """The step 3-14 translate without the frequent deletions."""
    matching, replace = translate_tables(kana)
    n = len(replace)
    mapped, deleted = matching[:n], matching[n:]
    for ch in FREQUENT_DELETIONS:
        deleted = deleted.replace(ch, "")
    return mapped + deleted, replace


def _x(c: int) -> str:
    return "\\x{%X}" % c


def keep_class() -> str:
    """Body of the step-16 character class, written with ``\\x{..}`` escapes,
    which both Java regex and RE2 accept."""
    parts = []
    for lo, hi in K.NORM_KEEP_RANGES:
        parts.append(_x(lo) if lo == hi else f"{_x(lo)}-{_x(hi)}")
    parts.extend(_x(ord(ch)) for ch in K.NORM_KEEP_CHARS)
    return "".join(parts)


def invalid_char_pattern() -> str:
    """Runs of characters outside the allowed set (deleting a run at once is
    the same as deleting each character, with far fewer matches)."""
    return "[^" + keep_class() + "]+"


def keep_run_pattern() -> str:
    """Runs of allowed characters; ASCII first, as the class is tried in order."""
    ranges = sorted(K.NORM_KEEP_RANGES, key=lambda r: (r[0] > 0x7F, r[0]))
    parts = [_x(lo) if lo == hi else f"{_x(lo)}-{_x(hi)}" for lo, hi in ranges]
    parts.extend(_x(ord(ch)) for ch in K.NORM_KEEP_CHARS)
    return "[" + "".join(parts) + "]+"


def ellipsis_run_pattern() -> str:
    return _x(ord(K.ELLIPSIS)) + "{3,}"


def line_break_pattern() -> str:
    singles = "".join(_x(ord(c)) for c in K.PY_LINE_BREAKS)
    return "\\x{D}\\x{A}|[" + singles + "]"


def literal_pattern(sep: str) -> str:
    """A regex matching ``sep`` literally (ASCII punctuation escaped)."""
    if sep == "":
        raise ValueError("empty separator")
    out = []
    for ch in sep:
        if ch.isascii() and not ch.isalnum():
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def join_sound_marks(text: Column) -> Column:
    """Half-width letters followed by a sound mark, as one full-width
    character.  Texts without a mark pass by two byte searches."""
    joined = text
    for pair, full in half_width_kana()[1]:
        joined = F.replace(joined, F.lit(pair), F.lit(full))
    return F.when(F.contains(text, F.lit(VOICED)) | F.contains(text, F.lit(HALF_VOICED)), joined).otherwise(text)


def normalize_text(text: ColumnOrName, passes: int = 1, kana: str = "offset") -> Column:
    """Normalization of transcript text for the speech-token model.

    One pass is: delete TAB, delete the literal ``[n]``, one translate for
    the single-character deletions and maps, collapse runs of three or more
    ellipses to two, then delete everything outside the allowed set.  A pass
    is not idempotent (a run of ellipses split by a deleted character only
    becomes a run after the last step), so ``passes=2`` reproduces paths that
    normalize twice.

    ``kana="offset"`` (the default) shifts half-width forms by a fixed offset,
    as the original does.  ``kana="correct"`` maps them to the kana they stand
    for; a letter and the sound mark after it (once TAB, ``[n]`` and spaces
    are gone) become one character, a mark without such a letter stays a
    character of its own.  Null stays null, the empty text stays empty.

    Costs: TAB, ``[n]`` and the two space characters are deleted by byte
    searches (steps 3-14 commute, so the spaces can go first, which also
    shortens the text the per-character translate walks); the last step
    keeps the runs of allowed characters (``regexp_extract_all`` +
    ``array_join``), the same text as deleting the rest at half the regex
    work.  Each step consumes the previous one exactly once (no CASE WHEN
    guards: a guard would reference the previous expression several times,
    and nested passes would multiply the work).
    """
    if kana not in KANA:
        raise ValueError(f"kana must be one of {KANA}")
    matching, replace = rare_translate_tables(kana)
    c = col_of(text)
    for n in range(passes):
        c = F.replace(c, F.lit(K.NORM_DELETE_TAB), F.lit(""))
        c = F.replace(c, F.lit(K.NORM_DELETE_LITERAL), F.lit(""))
        for ch in FREQUENT_DELETIONS:
            c = F.replace(c, F.lit(ch), F.lit(""))
        if kana == "correct" and n == 0:  # later passes meet no half-width form
            c = join_sound_marks(c)
        c = F.translate(c, matching, replace)
        c = F.regexp_replace(c, F.lit(ellipsis_run_pattern()), F.lit(K.ELLIPSIS * 2))
        c = F.array_join(F.regexp_extract_all(c, F.lit(keep_run_pattern()), F.lit(0)), "")
    return c


def py_strip(text: ColumnOrName) -> Column:
    """Python ``str.strip()``: removes every Unicode whitespace character at
    both ends (``trim`` alone removes U+0020 only)."""
    return F.btrim(col_of(text), F.lit(K.PY_WHITESPACE))


def split_literal(text: ColumnOrName, sep: str) -> Column:
    """Python ``str.split(sep)``: literal separator, empty fields kept."""
    return F.split(col_of(text), literal_pattern(sep), -1)


def split_lines(text: ColumnOrName) -> Column:
    """Python ``str.splitlines()`` boundaries (CRLF counts once).

    Every boundary is first rewritten to LF (a cached regex), then the split
    is on one character, which takes Java's no-regex split path."""
    unified = F.regexp_replace(col_of(text), F.lit(line_break_pattern()), F.lit("\n"))
    return F.split(unified, "\n", -1)


def non_blank_lines(text: ColumnOrName) -> Column:
    """``[s.strip() for s in text.splitlines() if s.strip()]`` as an array.

    The filter runs inside the array, so the position of a kept line is its
    array index: no window, no shuffle.  (Measured: this beats stripping
    blank lines with whole-text regexes, which copy the text per pass.)"""
    stripped = F.transform(split_lines(text), lambda s: py_strip(s))
    return F.filter(stripped, lambda s: s != F.lit(""))


def text_preview(text: ColumnOrName, n: int = 50) -> Column:
    """First ``n`` characters, with ``...`` appended when the text is longer."""
    c = col_of(text)
    return F.concat(
        F.substring(c, 1, n),
        F.when(F.length(c) > n, F.lit("...")).otherwise(F.lit("")),
    )


def base_name(path: ColumnOrName) -> Column:
    """``pathlib.Path(p).name``: the part after the last slash."""
    return F.regexp_extract(col_of(path), "([^/]*)/*$", 1)
