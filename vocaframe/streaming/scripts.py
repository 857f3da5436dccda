"""Context and stitched place of every sentence of a script, on a stream.

The rows of a script come over many micro-batches, in ascending position from
one micro-batch to the next and in any order inside one.  A sentence can be
told only when its successor comes (it then loses its last codes) or when the
script ends (the last sentence stays whole), so the state of a script is one
sentence: the one that waits, with its context and its place in the stitched
sequence.  A task holds the rows that one micro-batch has of a script, which
the stream's own limits bound (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).

Cases: rows without a script_id are left out.  A row at position -1 is the
caller's reference, the context of the first sentence.  A row with ``ended``
closes its script after the other rows of its micro-batch; its text and codes
are ignored.  Late rows, those at a position that is not above all positions
of earlier micro-batches, that repeat a position, that have none, or whose
script is closed, come out at once with ``late`` and change nothing.  A closed
script keeps one small row of state, so that late rows are known as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as K
from ..session import ship_package

STITCHED = (
    "script_id {key}, pos long, context_text string, context_codes array<int>, is_last boolean, kept array<int>, "
    "n_kept long, start_seq long, total long, decodable boolean, late boolean"
)
_STATE = "last long, waits boolean, text string, codes array<int>, context_text string, context_codes array<int>, start_seq long, closed boolean"
_NONE, _REFERENCE = -(1 << 63), -1
_ROW = ("pos", "context_text", "context_codes", "is_last", "kept", "n_kept", "start_seq", "total", "decodable", "late")


def _codes(values) -> list[int] | None:
    return None if values is None else [int(x) for x in values]


def _stitcher(trim: int):
    def trimmed(codes: list[int] | None) -> list[int] | None:
        return None if codes is None else codes[:max(len(codes) - trim, 0)]

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        ends = False
        for chunk in chunks:
            for pos, text, codes, ended in zip(chunk["pos"].tolist(), chunk["text"], chunk["codes"], chunk["ended"].tolist()):
                ends |= ended
                if not ended:
                    rows.append((pos, text, _codes(codes)))
        rows.sort(key=lambda r: r[0])  # stable: of a repeated position the first row counts
        if state.exists:
            last, waits, text, codes, context_text, context_codes, start, closed = state.get
            codes, context_codes = _codes(codes), _codes(context_codes)
        else:
            last, waits, text, codes, context_text, context_codes, start, closed = _REFERENCE - 1, False, None, None, None, None, 0, False
        out: list[tuple] = []

        def tell(is_last: bool) -> None:
            nonlocal start, context_text, context_codes
            kept = codes if is_last else trimmed(codes)
            n = len(kept or ())
            total = (start + n, start + n > 0) if is_last else (None, None)
            out.append((last, context_text, context_codes, is_last, kept, n, start, *total, False))
            start += n
            context_text, context_codes = text, kept

        for pos, new_text, new_codes in rows:
            if closed or pos <= last:
                out.append((None if pos == _NONE else pos, None, None, None, None, None, None, None, None, True))
            elif pos == _REFERENCE:
                last, context_text, context_codes = pos, new_text, new_codes
            else:
                if waits:
                    tell(False)
                last, waits, text, codes = pos, True, new_text, new_codes
        if ends and not closed:
            if waits:
                tell(True)
            waits, closed = False, True
            text = codes = context_text = context_codes = None
        state.update((last, waits, text, codes, context_text, context_codes, start, closed))
        yield pd.DataFrame({"script_id": pd.Series([key[0]] * len(out), dtype=object)} | {c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(_ROW)})

    return run


def stitch_stream(sentences: DataFrame, trim: int = K.CONTEXT_TRIM) -> DataFrame:
    """The streaming form of ``chain_context`` and ``stitch_offsets``.

    ``sentences``: a stream of ``script_id, pos, text, codes, ended`` (other
    columns are left out).  Output: columns of ``STITCHED``, one row for each
    input row but references and end rows."""
    ship_package(sentences.sparkSession)
    rows = sentences.where("script_id is not null").select(
        "script_id", F.coalesce(F.col("pos").cast("long"), F.lit(_NONE)).alias("pos"), "text", "codes",
        F.coalesce("ended", F.lit(False)).alias("ended"))
    schema = STITCHED.format(key=rows.schema["script_id"].dataType.simpleString())
    return rows.groupBy("script_id").applyInPandasWithState(_stitcher(trim), schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_stitched(sentences: DataFrame, out_dir: str, trim: int = K.CONTEXT_TRIM, available_now: bool = True) -> StreamingQuery:
    """Start the query: Parquet in ``out_dir/data``, checkpoint in
    ``out_dir/checkpoint``.  Started again, it goes on from its checkpoint."""
    writer = stitch_stream(sentences, trim).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", f"{out_dir}/data").option("checkpointLocation", f"{out_dir}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
