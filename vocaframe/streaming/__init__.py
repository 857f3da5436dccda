"""The map-only steps on streaming DataFrames.

Normalization, token and prompt rendering, request validation and response
decoding are per-row native expressions, so the same column functions and
operators run unchanged on a stream (tested with file sources and
available-now triggers).  The last text per id
is a stateful aggregate (``manifest``); context and stitching of scripts keep
one sentence a script (``scripts``).  Steps that need a whole table (shuffling,
top-k) need bounded input and are not offered here.
"""

from .manifest import latest_texts, stream_last_texts  # noqa: F401
from .prompts import prompt_stream, stream_training_prompts  # noqa: F401
from .scripts import STITCHED, stitch_stream, stream_stitched  # noqa: F401
