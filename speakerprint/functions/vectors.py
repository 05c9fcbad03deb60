"""Native vector expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speakerprint.functions.packed import SCALE


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quantised(vec: str | Column, scale: int = SCALE) -> Column:
    """``ARRAY<BIGINT>``: every element rounded to a multiple of 1/scale."""
    return F.transform(as_col(vec), lambda x: F.round(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def dot(a: str | Column, b: str | Column) -> Column:
    product = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine in double; 0.0 when either norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def hamming(a: str | Column, b: str | Column) -> Column:
    """Differing bits of two packed hypervectors."""
    diff = F.zip_with(as_col(a), as_col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(diff, F.lit(0), lambda s, x: s + x)


def bit_cosine(a: str | Column, b: str | Column, dim: int) -> Column:
    """Exact cosine of two +-1 hypervectors from their packed bits."""
    return (F.lit(dim) - F.lit(2) * hamming(a, b)) / F.lit(float(dim))


def bit_signs(bits: str | Column, dim: int) -> Column:
    """Packed bits -> ``ARRAY<INT>`` of +-1."""
    b = as_col(bits)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda m: (F.getbit(F.element_at(b, (F.floor(m / 64) + 1).cast("int")), m % 64) * 2 - 1).cast("int"),
    )
