"""Vector math on ``array<float>`` columns, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..util import ColumnOrName, col_of

COSINE_EPS = 1e-8


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    prods = F.zip_with(col_of(a), col_of(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: ColumnOrName) -> Column:
    return F.sqrt(F.aggregate(col_of(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a: ColumnOrName, b: ColumnOrName, eps: float = COSINE_EPS) -> Column:
    """dot(a, b) / (max(|a|, eps) * max(|b|, eps)); a zero vector gives 0.

    Vectors of different length give NULL (``zip_with`` pads with NULL)."""
    return dot(a, b) / (F.greatest(l2_norm(a), F.lit(eps)) * F.greatest(l2_norm(b), F.lit(eps)))
