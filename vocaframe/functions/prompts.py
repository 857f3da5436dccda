"""Prompt rendering for training and inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..util import ColumnOrName, col_of
from .text import normalize_text
from .tokens import render_speech_tokens


def render_prompt(
    text: ColumnOrName,
    codes: ColumnOrName | None = None,
    add_bos: bool = True,
    add_end: bool = True,
    passes: int = 1,
) -> Column:
    """Model prompt: optional BOS, template around the normalized text, the
    speech tokens when ``codes`` is non-empty (NULL and ``[]`` both mean no
    tokens), optional end marker."""
    parts = []
    if add_bos:
        parts.append(F.lit(K.BOS_TOKEN))
    parts += [F.lit(K.PROMPT_HEAD), normalize_text(text, passes), F.lit(K.PROMPT_TAIL)]
    if codes is not None:
        parts.append(render_speech_tokens(codes))
    if add_end:
        parts.append(F.lit(K.SPEECH_END_TOKEN))
    return F.concat(*parts)


def training_prompt(text: ColumnOrName, codes: ColumnOrName) -> Column:
    return render_prompt(text, codes, add_bos=True, add_end=True)


def inference_prompt(text: ColumnOrName, codes: ColumnOrName | None = None) -> Column:
    return render_prompt(text, codes, add_bos=True, add_end=False)


def with_reference_text(text: ColumnOrName, reference_text: ColumnOrName) -> Column:
    """Reference text is prepended, with no separator, before normalization."""
    return F.concat(F.coalesce(col_of(reference_text), F.lit("")), col_of(text))


def choose_reference_codes(given: ColumnOrName, encoded: ColumnOrName) -> Column:
    """Given codes win when non-empty, else the codes encoded from the
    reference audio (which may be NULL: no tokens)."""
    g = col_of(given)
    return F.when(F.array_size(g) > 0, g).otherwise(col_of(encoded))


def strip_bos(prompt: ColumnOrName) -> Column:
    """Drop a leading BOS token, only if the prompt starts with it."""
    p = col_of(prompt)
    n = len(K.BOS_TOKEN)
    return F.when(p.startswith(K.BOS_TOKEN), F.substring(p, n + 1, 1 << 30)).otherwise(p)


def prompt_part(prompt: ColumnOrName) -> Column:
    """Everything up to and including the speech-start marker (no loss)."""
    return F.concat(F.split_part(col_of(prompt), F.lit(K.SPEECH_START_MARKER), F.lit(1)),
                    F.lit(K.SPEECH_START_MARKER))


def completion_part(prompt: ColumnOrName) -> Column:
    """Everything after the speech-start marker (the trained completion)."""
    return F.split_part(col_of(prompt), F.lit(K.SPEECH_START_MARKER), F.lit(2))
