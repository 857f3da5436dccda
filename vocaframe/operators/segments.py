"""Multi-sentence scripts: split, chain context, stitch codes.

A script is a set of rows ``(script_id, pos, text, codes)`` with
positions ``0..n-1`` (``split_script`` produces them; conversation turns have
them; gaps are allowed).  Sentence *i* is synthesized with the text and the trimmed codes of
sentence *i-1* as its reference; every sentence but the last loses its final
16 codes before the codes are concatenated.

Skew: one script may hold a large share of all rows, so no step partitions
by ``script_id`` alone.  Rows are grouped into blocks of ``block`` positions,
and windows run over ``(script_id, block)``: a hot script is spread over many
tasks.  What crosses a block border (the previous row of a block's first
row, the offset of a block, the last position of a script) comes from small
per-block tables joined on the same ``(script_id, block)`` key, so the row
side is shuffled once.  Offsets use a second level (superblocks of
``block`` blocks), so even the per-script window sees one row per
``block**2`` sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.prompts import inference_prompt, with_reference_text
from ..functions.text import non_blank_lines
from ..util import materialize as materialize_df

DEFAULT_BLOCK = 1024


def split_script(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per non-blank line: ``script_id, pos, text`` (line stripped).

    The blank-line filter runs inside the array, so ``pos`` is the dense
    index among kept lines without a window (map-only, no shuffle)."""
    return df.select(
        F.col(id_col).alias("script_id"),
        F.posexplode(non_blank_lines(text_col)).alias("pos", "text"),
    ).select("script_id", F.col("pos").cast("bigint").alias("pos"), "text")


def trim_context(codes: Column, trim: int = K.CONTEXT_TRIM) -> Column:
    """``codes[:-trim]``: shorter lists become empty; NULL stays NULL."""
    return F.slice(codes, 1, F.greatest(F.array_size(codes) - trim, F.lit(0)))


def _blocked(df: DataFrame, block: int) -> DataFrame:
    return df.withColumn("_blk", F.expr(f"CAST(pos DIV {int(block)} AS BIGINT)"))


def with_previous(df: DataFrame, cols: list[str], block: int = DEFAULT_BLOCK,
                  prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` = value of ``c`` at the greatest smaller ``pos`` of the
    same script (positions may have gaps; the result does not depend on
    ``block``).

    ``lag`` over ``(script_id, block)`` ordered by ``pos``.  The last row of
    every block is also handed to the script's next block that exists: a
    partial aggregation keeps one row a block, a window over those rows (one
    for each ``block`` sentences at most) finds the next block, and the row
    joins that block as a carrier that sorts before its rows.  Carriers are
    dropped afterwards."""
    b = _blocked(df, block)
    last = b.groupBy("script_id", "_blk").agg(F.max_by(F.struct("pos", *cols), "pos").alias("_last"))
    following = F.lead("_blk").over(Window.partitionBy("script_id").orderBy("_blk"))
    carriers = last.withColumn("_blk", following).where(F.col("_blk").isNotNull()).select(
        "script_id", "_blk", "_last.*", F.lit(True).alias("_carried"))
    x = b.withColumn("_carried", F.lit(False)).unionByName(carriers, allowMissingColumns=True)
    w = Window.partitionBy("script_id", "_blk").orderBy("pos")
    for c in cols:
        x = x.withColumn(prefix + c, F.lag(c).over(w))
    return x.where(~F.col("_carried")).drop("_blk", "_carried")


def attach_per_script(rows: DataFrame, per_script: DataFrame, block: int = DEFAULT_BLOCK,
                      how: str = "inner") -> DataFrame:
    """Join a one-row-per-script table to every row of its script, salted by
    block so that a hot script never lands in one task.

    The per-script row is replicated once per block the script actually has
    (``(script_id, block)`` pairs come from a partial aggregation of the
    rows), and the rows join on ``(script_id, block)``.  Only scripts with
    many blocks get many replicas; cold scripts get one."""
    b = _blocked(rows, block)
    blocks = b.select("script_id", "_blk").distinct()
    replicated = blocks.join(per_script, "script_id", how)
    return b.join(replicated, ["script_id", "_blk"], how).drop("_blk")


def chain_context(script: DataFrame, refs: DataFrame | None = None, block: int = DEFAULT_BLOCK,
                  trim: int = K.CONTEXT_TRIM) -> DataFrame:
    """Inference prompt of every sentence with the previous one as reference.

    ``script``: ``script_id, pos, text, codes``; ``refs`` (optional):
    ``script_id, ref_text, ref_codes``, the caller's reference used by
    sentence 0.  Output: ``script_id, pos, context_text, context_codes,
    prompt``.  Because the previous sentence is never the last one, its
    codes are always trimmed."""
    s = script.select("script_id", "pos", "text", trim_context(F.col("codes"), trim).alias("trimmed"))
    if refs is not None:
        # the caller's reference enters as a virtual sentence at pos -1 (block
        # 0, untrimmed), so the same lag hands it to sentence 0: no join, no
        # second pass over the script (one reference row per script)
        virtual = refs.select("script_id", F.lit(-1).cast("bigint").alias("pos"),
                              F.col("ref_text").alias("text"), F.col("ref_codes").alias("trimmed"))
        s = s.unionByName(virtual)
    p = with_previous(s, ["text", "trimmed"], block).where(F.col("pos") >= 0)
    p = p.select("script_id", "pos", "text", F.col("prev_text").alias("context_text"),
                 F.col("prev_trimmed").alias("context_codes"))
    full_text = F.when(F.length("context_text") > 0, with_reference_text("text", "context_text")).otherwise(
        F.col("text"))
    return p.select(
        "script_id",
        "pos",
        "context_text",
        "context_codes",
        inference_prompt(full_text, F.col("context_codes")).alias("prompt"),
    )


def stitch_offsets(script: DataFrame, block: int = DEFAULT_BLOCK, trim: int = K.CONTEXT_TRIM,
                   materialize: bool = False) -> DataFrame:
    """Place every sentence's kept codes in the stitched sequence.

    Output per sentence: ``script_id, pos, is_last, kept, n_kept, start_seq,
    total, decodable`` (the last two on the last sentence); the stitched
    sequence of a script is the concatenation of ``kept`` by ``pos``, i.e.
    code ``kept[k]`` sits at ``start_seq + k``.

    Plan: a two-level blocked prefix sum.  The block table (sum of lengths
    and last position of each block of ``block`` positions) is one partial
    aggregation of the rows; a window inside each superblock of ``block``
    blocks, and one over the superblocks of a script (one row per
    ``block**2`` sentences), turn it into the offset of every block and the
    script's last position.  The row side is shuffled once, by
    ``(script_id, block)``, for both its running sum and the join with the
    offsets; a script holding a third of all rows spreads over many tasks at
    every level.  Every sentence but the last is trimmed, so the sums use
    trimmed lengths; the last sentence's own length never enters a prefix.

    The rows are read twice: once for the block table (a job of its own, whose
    small result goes to the shared checkpoint folder), once for the rows; with
    ``materialize=True`` the projected input is first written to the shared
    checkpoint folder, so an expensive upstream plan runs once and the
    lineage is cut."""
    src = script.select("script_id", "pos", "codes")
    if materialize:
        src = materialize_df(src, "stitch-input")
    b = _blocked(src, block)
    before = Window.unboundedPreceding, -1
    length = F.greatest(F.coalesce(F.array_size("codes"), F.lit(0)) - trim, F.lit(0))

    # one row per block, written once as both uses below need it; then its
    # offset inside its superblock
    blocks = b.groupBy("script_id", "_blk").agg(F.sum(length).alias("_bsum"), F.max("pos").alias("_bmax"))
    blocks = materialize_df(blocks, "stitch-blocks")
    blocks = blocks.withColumn("_sblk", F.expr(f"CAST(_blk DIV {int(block)} AS BIGINT)"))
    inside = Window.partitionBy("script_id", "_sblk")
    blocks = blocks.select(
        "script_id", "_blk", "_sblk",
        F.coalesce(F.sum("_bsum").over(inside.orderBy("_blk").rowsBetween(*before)), F.lit(0)).alias("_in_sblk_off"),
        F.sum("_bsum").over(inside).alias("_ssum"),
        F.max("_bmax").over(inside).alias("_smax"),
        F.max("_blk").over(inside).alias("_slast"),
    )

    # one row per superblock: its offset and the script's last position
    whole = Window.partitionBy("script_id").orderBy("_sblk")
    sblocks = blocks.where("_blk = _slast").select(
        "script_id", "_sblk",
        F.coalesce(F.sum("_ssum").over(whole.rowsBetween(*before)), F.lit(0)).alias("_sblk_off"),
        F.max("_smax").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"),
    )
    blocks = blocks.join(sblocks, ["script_id", "_sblk"]).select(
        "script_id", "_blk", (F.col("_sblk_off") + F.col("_in_sblk_off")).alias("_blk_off"), "_last")

    wb = Window.partitionBy("script_id", "_blk").orderBy("pos").rowsBetween(*before)
    rows = b.withColumn("_in_off", F.coalesce(F.sum(length).over(wb), F.lit(0)))
    j = rows.join(blocks, ["script_id", "_blk"])
    is_last = F.col("pos") == F.col("_last")
    kept = F.when(is_last, F.col("codes")).otherwise(trim_context(F.col("codes"), trim))
    out = j.select(
        "script_id",
        "pos",
        is_last.alias("is_last"),
        kept.alias("kept"),
        (F.col("_blk_off") + F.col("_in_off")).cast("bigint").alias("start_seq"),
    ).withColumn("n_kept", F.coalesce(F.array_size("kept"), F.lit(0)).cast("bigint"))
    total = F.col("start_seq") + F.col("n_kept")  # on the last row only
    out = out.withColumn("total", F.when(F.col("is_last"), total))
    # a script with no codes at all yields no audio (decoding [] is an error)
    return out.withColumn("decodable", F.when(F.col("is_last"), F.col("total") > 0))


def stitched_stream(offsets: DataFrame) -> DataFrame:
    """The stitched code sequence as rows ``script_id, seq, code``.

    Exploding per sentence keeps every row bounded by one sentence; no script
    is ever gathered into one array.  Scripts whose stitched sequence is
    empty produce no rows (nothing to decode)."""
    return offsets.select(
        "script_id",
        "start_seq",
        F.posexplode("kept").alias("k", "code"),
    ).select("script_id", (F.col("start_seq") + F.col("k")).alias("seq"), "code")
