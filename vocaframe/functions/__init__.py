"""Column -> Column functions (native Spark expressions)."""

from .text import (  # noqa: F401
    base_name,
    non_blank_lines,
    normalize_text,
    py_strip,
    split_lines,
    split_literal,
    text_preview,
)
from .tokens import (  # noqa: F401
    decode_generated_ids,
    extract_speech_ids,
    format_code_list,
    parse_code_list,
    render_speech_tokens,
    to_token_ids,
)
from .prompts import (  # noqa: F401
    choose_reference_codes,
    completion_part,
    inference_prompt,
    prompt_part,
    render_prompt,
    strip_bos,
    training_prompt,
    with_reference_text,
)
from .vectors import cosine_similarity, dot, l2_norm  # noqa: F401
