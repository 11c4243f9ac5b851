"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(a: Column, dims: int) -> Column:
    """Whether a vector can be compared: of that length, no nulls in it, not all zero."""
    return F.coalesce((F.size(a) == dims) & ~F.exists(a, lambda x: x.isNull()) & F.exists(a, lambda x: x != 0), F.lit(False))


def score(cosine: Column, mode: str = "normalized") -> Column:
    """``raw`` cosine, or ``normalized`` to 0..1 as vector indexes report it."""
    if mode not in ("raw", "normalized"):
        raise ValueError(mode)
    return cosine if mode == "raw" else (1 + cosine) / 2
