"""Conversions between audio codes, speech-token strings and token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..util import ColumnOrName, col_of
from .text import py_strip

SPEECH_ID_PATTERN = r"<\|s_(\d+)\|>"


def render_speech_tokens(codes: ColumnOrName) -> Column:
    """``"".join(f"<|s_{c}|>" for c in codes)``; empty or NULL codes give "".

    Written as one ``array_join`` with the closing and opening token text as
    separator, which is a codegen'd expression (no lambda per element)."""
    c = col_of(codes)
    joined = F.array_join(c.cast("array<string>"), K.SPEECH_TOKEN_CLOSE + K.SPEECH_TOKEN_OPEN)
    return F.when(
        F.array_size(c) > 0,
        F.concat(F.lit(K.SPEECH_TOKEN_OPEN), joined, F.lit(K.SPEECH_TOKEN_CLOSE)),
    ).otherwise(F.lit(""))


def extract_speech_ids(tokens: ColumnOrName) -> Column:
    """All ``<|s_N|>`` numbers of a string, in order, as ``array<bigint>``.

    Java's ``\\d`` is ASCII-only; Python's also takes other Unicode digits.
    No range check is applied (the server path has none); a number beyond 64
    bits is a null element, so that untrusted text never ends a job."""
    found = F.regexp_extract_all(col_of(tokens), F.lit(SPEECH_ID_PATTERN), 1)
    return F.transform(found, lambda x: x.try_cast("bigint"))


def decode_generated_ids(ids: ColumnOrName, prompt_len: ColumnOrName) -> Column:
    """Codes of a generated id sequence (local-model path).

    Drop the first ``prompt_len`` ids, stop before the first end marker, keep
    ids inside the speech range and subtract the offset."""
    arr = col_of(ids)
    plen = col_of(prompt_len)
    generated = F.slice(arr, plen + 1, F.array_size(arr))
    end_at = F.array_position(generated, K.SPEECH_END_ID)
    taken = F.when(end_at == 0, generated).otherwise(F.slice(generated, 1, end_at - 1))
    lo, hi = K.SPEECH_ID_OFFSET, K.SPEECH_ID_OFFSET + K.CODEBOOK_SIZE
    in_range = F.filter(taken, lambda x: (x >= lo) & (x < hi))
    return F.transform(in_range, lambda x: x - F.lit(lo))


def to_token_ids(codes: ColumnOrName) -> Column:
    """Codes to vocabulary ids (inverse of the offset subtraction)."""
    return F.transform(col_of(codes), lambda x: x.cast("bigint") + F.lit(K.SPEECH_ID_OFFSET))


def format_code_list(codes: ColumnOrName) -> Column:
    """Python ``str(list_of_ints)``: ``[1, 2, 3]``; NULL stays NULL."""
    c = col_of(codes)
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))


def _item_strip_pattern() -> str:
    """Per item of a comma-separated list: Python's
    ``item.strip("[").strip("]").strip()`` as one regex over the whole text.

    At the start of an item the removed prefix is ``[``* then ``]``* then
    whitespace*; at its end the removed suffix is whitespace* then ``]``*
    then ``[``* (each strip only sees what the previous one left)."""
    ws = "".join("\\x{%X}" % ord(c) for c in K.PY_WHITESPACE)
    return f"(?<=^|,)\\[*\\]*[{ws}]*|[{ws}]*\\]*\\[*(?=,|$)"


def parse_code_list(text: ColumnOrName, strict: bool = True) -> Column:
    """Parse ``"[1, 2, 3]"`` the way the tokenizer UI does.

    Split on ``,``; per item strip ``[`` then ``]`` then whitespace; convert
    to int.  ``strict=True`` raises on a bad item (ANSI cast), as Python's
    ``int()`` does; ``strict=False`` returns NULL for the whole list instead.
    Note that ``"[]"`` has one empty item and is therefore invalid.

    No per-element lambda: text in the canonical ``[1, 2, 3]`` form (what
    :func:`format_code_list` writes) is split after dropping the outer
    brackets; any other text goes through one regex that strips every item,
    then the split.  Both end in one array cast."""
    t = col_of(text)
    # at most 9 digits per item: the int cast cannot overflow on this path
    canonical = t.rlike(r"^\[-?[0-9]{1,9}(, -?[0-9]{1,9})*\]$")
    fast = F.split(F.regexp_replace(t, r"^\[|\]$", ""), ",", -1)  # the cast trims the blank
    general = F.split(F.regexp_replace(t, F.lit(_item_strip_pattern()), F.lit("")), ",", -1)
    parsed = general.try_cast("array<int>")
    if strict:
        # raise on a bad item whatever spark.sql.ansi.enabled says
        bad = F.raise_error(F.concat(F.lit("invalid code list: "), t)).cast("array<int>")
        checked = F.when(F.array_size(F.array_compact(parsed)) == F.array_size(parsed), parsed).otherwise(bad)
        return F.when(canonical, fast.cast("array<int>")).otherwise(checked)
    checked = F.when(F.array_size(F.array_compact(parsed)) == F.array_size(parsed), parsed)
    return F.when(canonical, fast.try_cast("array<int>")).otherwise(checked)
