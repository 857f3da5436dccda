"""DuckDB SQL expressions for the oracle side of the registered queries.

They restate the column functions in DuckDB's dialect from the same fixed
values, so the oracle and the Spark plan share no code path but the
constants.
"""

from __future__ import annotations

from .. import constants as K
from ..functions.text import (
    ellipsis_run_pattern,
    invalid_char_pattern,
    line_break_pattern,
    translate_tables,
)


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# half-width forms and the kana they stand for, written out
HALF = "｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
FULL = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜"
WITH_MARK = {"ﾞ": ("ｳｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾊﾋﾌﾍﾎﾜｦ", "ヴガギグゲゴザジズゼゾダヂヅデドバビブベボヷヺ"), "ﾟ": ("ﾊﾋﾌﾍﾎ", "パピプペポ")}


def normalize_kana(expr: str) -> str:
    """One pass with real kana: half-width forms are replaced before the rest."""
    e = f"replace(translate({expr}, {q(K.NORM_DELETE_TAB)}, ''), {q(K.NORM_DELETE_LITERAL)}, '')"
    e = f"translate({e}, ' \u3000', '')"
    for mark, (half, full) in WITH_MARK.items():
        for a, b in zip(half, full):
            e = f"replace({e}, {q(a + mark)}, {q(b)})"
    return normalize(f"translate({e}, {q(HALF)}, {q(FULL)})")


def normalize(expr: str, passes: int = 1) -> str:
    matching, replace = translate_tables()
    e = expr
    for _ in range(passes):
        e = f"translate({e}, {q(K.NORM_DELETE_TAB)}, '')"
        e = f"replace({e}, {q(K.NORM_DELETE_LITERAL)}, '')"
        e = f"translate({e}, {q(matching)}, {q(replace)})"
        e = f"regexp_replace({e}, {q(ellipsis_run_pattern())}, {q(K.ELLIPSIS * 2)}, 'g')"
        e = f"regexp_replace({e}, {q(invalid_char_pattern())}, '', 'g')"
    return e


def py_strip(expr: str) -> str:
    return f"trim({expr}, {q(K.PY_WHITESPACE)})"


def speech_tokens(codes: str) -> str:
    close_open = K.SPEECH_TOKEN_CLOSE + K.SPEECH_TOKEN_OPEN
    return (
        f"(CASE WHEN len({codes}) > 0 THEN {q(K.SPEECH_TOKEN_OPEN)} || "
        f"array_to_string({codes}, {q(close_open)}) || {q(K.SPEECH_TOKEN_CLOSE)} ELSE '' END)"
    )


def prompt(text: str, codes: str | None = None, bos: bool = True, end: bool = True,
           passes: int = 1) -> str:
    parts = []
    if bos:
        parts.append(q(K.BOS_TOKEN))
    parts += [q(K.PROMPT_HEAD), normalize(text, passes), q(K.PROMPT_TAIL)]
    if codes is not None:
        parts.append(speech_tokens(codes))
    if end:
        parts.append(q(K.SPEECH_END_TOKEN))
    return "(" + " || ".join(parts) + ")"


def code_list(codes: str) -> str:
    return f"('[' || array_to_string({codes}, ', ') || ']')"


def non_blank_lines(text: str) -> str:
    parts = f"regexp_split_to_array({text}, {q(line_break_pattern())})"
    return f"list_filter(list_transform({parts}, lambda s: {py_strip('s')}), lambda s: s <> '')"


def preview(text: str, n: int = 50) -> str:
    return f"(substring({text}, 1, {n}) || CASE WHEN length({text}) > {n} THEN '...' ELSE '' END)"


def cosine(a: str, b: str, eps: float = 1e-8) -> str:
    def total(expr: str) -> str:
        return f"list_reduce({expr}, lambda x, y: x + y, 0.0::DOUBLE)"

    dot = total(f"list_transform(range(len({a})), lambda i: {a}[i + 1]::DOUBLE * {b}[i + 1]::DOUBLE)")
    na = "sqrt(" + total(f"list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)") + ")"
    nb = "sqrt(" + total(f"list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE)") + ")"
    return f"({dot} / (greatest({na}, {eps}) * greatest({nb}, {eps})))"


def values(rows, cols: str) -> str:
    """``(VALUES ...) AS t(cols)`` from Python tuples of ints and strings."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return q(v)
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({cols})"
