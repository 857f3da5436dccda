"""Document fingerprints: one-permutation MinHash with densification.

DataFrame functions only.  A text's set is that of its five-word shingles
(words: lower case, split at white space; fewer words are one shingle).  Each
shingle is hashed once; its leading bits choose one of ``BINS`` bins and a bin
keeps its smallest hash.  An empty bin probes the bins in a hashed order of
its own and takes the value of the first full one (optimal densification),
hashed with its own number, so that bins filled from one shingle are
independent in their low bits.  The fingerprint holds the
``BITS`` low-order bits of each bin, packed as one hexadecimal digit a bin.
Two bins agree by chance once in ``2**BITS``, which the likeness corrects:
``(share of equal bins - 2**-BITS) / (1 - 2**-BITS)``, not below 0.

Equal texts have equal fingerprints.  Cases: null and empty texts and texts of
white space alone have no shingle and the fingerprint of all zeros; very long
texts are hashed whole; repeated rows each get their own; an empty table gives
an empty result; columns other than doc_id and text are ignored by
``compare_neighbours``, and columns named like its results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 128
BITS = 4
SHINGLE = 5
_SHIFT = 57  # 64 - log2(BINS); an arithmetic shift, so that bins run from -64 to 63
_LOW = -(BINS // 2)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(text: Column) -> Column:
    """Distinct or repeated 64-bit hashes of the shingles."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def joined(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - SHINGLE, F.lit(0)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)])))

    return _let(hashed, joined)


def _bin(h: Column) -> Column:
    return F.shiftright(h, _SHIFT).cast("int")


def _least(sorted_hashes: Column) -> Column:
    """The smallest hash of every full bin, from sorted hashes."""
    return _let(sorted_hashes, lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1)))))


def _nulls(n: Column) -> Column:
    return F.array_repeat(F.lit(None).cast("bigint"), n)


def _dense(least: Column) -> Column:
    """One entry a bin, null where it is empty."""

    def spread(full: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(_LOW - 1)).otherwise(_bin(F.get(full, i - 1)))
        heads = F.transform(full, lambda h, i: F.concat(_nulls(_bin(h) - before(i) - 1), F.array(h)))
        last = F.when(F.size(full) == 0, F.lit(_LOW - 1)).otherwise(_bin(F.get(full, F.size(full) - 1)))
        return F.concat(F.flatten(heads), _nulls(F.lit(_LOW + BINS - 1) - last))

    return _let(least, spread)


def _filled(dense: Column) -> Column:
    """Empty bins filled.  The ``t``-th probe of bin j is a permutation of the
    numbers below ``BINS`` that j's hash chooses: odd factors and sums modulo
    ``BINS`` around a shift, each of them one to one."""
    low = BINS - 1

    def fill(bins: Column) -> Column:
        def value(h: Column, j: Column) -> Column:
            def probed(own: Column) -> Column:
                part = lambda i: F.shiftrightunsigned(own, 8 * i).bitwiseAND(F.lit(low)).cast("int")

                def probe(t: Column) -> Column:
                    x = (t * part(0).bitwiseOR(F.lit(1)) + part(1)).bitwiseAND(F.lit(low))
                    return _let(x, lambda x: F.get(bins, (x.bitwiseXOR(F.shiftright(x, 4)) * part(2).bitwiseOR(F.lit(1)) + part(3)).bitwiseAND(F.lit(low))))

                soon = [probe(F.lit(t)) for t in range(4)]
                later = F.get(F.filter(F.transform(F.sequence(F.lit(4), F.lit(low)), probe), lambda x: x.isNotNull()), F.lit(0))
                found = F.coalesce(*soon, later)
                return _let(found, lambda v: F.when(v.isNotNull(), F.xxhash64(v, j)))

            return F.coalesce(h, _let(F.xxhash64(j), probed))

        return F.transform(bins, value)

    return _let(dense, fill)


def fingerprint(text: Column) -> Column:
    """``BINS`` hexadecimal digits, one for each bin."""
    values = _filled(_dense(_least(F.sort_array(_shingles(text)))))
    digit = lambda v: F.substring(F.lit("0123456789abcdef"), F.coalesce(v, F.lit(0)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(values, digit), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    chance = 2.0 ** -BITS

    def share(both: Column) -> Column:
        digit = lambda name, i: F.substring(both[name], i, F.lit(1))
        return F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: digit("a", i) == digit("b", i))) / F.lit(BINS)

    return F.greatest(F.lit(0.0), (_let(F.struct(a.alias("a"), b.alias("b")), share) - chance) / (1 - chance))


def with_next(docs: DataFrame, ranges: int = 256) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``next``: a struct of the same
    columns of the next row by descending doc_id, and of the first row for the
    last one.

    Rows are split into ranges of doc_id at approximate quantiles.  Inside a
    range a window finds the next row; the first row of each range is copied
    to the end of the range above, the very first one to the end of the
    lowest, so that nothing is ordered in one task.  Rows without a doc_id
    come last; rows with one doc_id are ordered by text."""
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    quantiles = docs.agg(F.percentile_approx(place, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(q).cast("long") for q in sorted(set(quantiles))]) if quantiles else F.array().cast("array<bigint>")
    ranged = docs.withColumn("_place", place).withColumn("_range", F.size(F.filter(cuts, lambda c: c < F.col("_place"))))
    tops = ranged.groupBy("_range").agg(F.max("_place").alias("top")).orderBy("_range").collect()  # at most ``ranges`` rows
    above = {t.top: tops[(i + 1) % len(tops)]["_range"] for i, t in enumerate(tops)}
    target = F.lit(None).cast("int")
    if above:
        pairs = F.create_map(*[F.lit(x).cast("long") if i % 2 == 0 else F.lit(x) for t in above.items() for i, x in enumerate(t)])
        target = F.element_at(pairs, F.col("_place"))
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("carried"))
    carried = F.struct(target.alias("range"), F.lit(True).alias("carried"))
    copies = ranged.withColumn("_copy", F.explode(F.when(target.isNull(), F.array(own)).otherwise(F.array(own, carried))))
    order = Window.partitionBy("_copy.range").orderBy("_copy.carried", F.desc("_place"), "text")
    following = F.lead(F.struct(*docs.columns)).over(order)
    return copies.withColumn("next", following).where("not _copy.carried").select(*docs.columns, "next")


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many of the beginning of
    the following text (or all of it)."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with fingerprints of each text, of its edited
    text (``edited_text`` with the next row's text) and of the next row."""
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("fingerprint", fingerprint(F.col("text")))
    both = with_next(marked)
    edited = both.withColumn("edited", edited_text(F.col("text"), F.col("next.text")))
    return edited.withColumn("edited_fingerprint", fingerprint(F.col("edited"))).select("doc_id", "text", "edited", "fingerprint", "edited_fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
