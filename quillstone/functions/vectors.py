"""Vector expressions over ARRAY columns, evaluated in double precision.

A null vector or vectors of different lengths give null.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """dot / (norm * norm + eps): zero vectors have cosine 0."""
    return dot(a, b) / (norm(a) * norm(b) + eps)


def unit(v: Column, eps: float = 1e-12) -> Column:
    n = norm(v) + eps
    return F.transform(v, lambda x: x.cast("double") / n)


def rms_norm(v: Column, gain: Column | None = None, eps: float = 1e-6) -> Column:
    """The final norm of a model: v over its root mean square, times a gain for each dimension."""
    r = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(v) + eps)
    out = F.transform(v, lambda x: x.cast("double") / r)
    return out if gain is None else F.zip_with(out, gain, lambda x, g: x * g.cast("double"))


def scaled(v: Column, factor: float) -> Column:
    """As for logits that a model scales."""
    return F.transform(v, lambda x: x.cast("double") * F.lit(factor))


def add_scaled(v: Column, direction: Column, scale: float) -> Column:
    """Steering: v + scale * direction."""
    return F.zip_with(v, direction, lambda x, y: x.cast("double") + F.lit(scale) * y.cast("double"))


def top_k(v: Column, k: int) -> Column:
    """ARRAY<STRUCT<value, idx>> of the k largest, equal values by index."""
    pairs = F.transform(v, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("idx")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["neg"]).alias("value"), p["idx"].alias("idx")))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.round(x, digits) + F.lit(0.0)


def known(x: Column) -> Column:
    """NaN as null."""
    return F.nanvl(x, F.lit(None).cast("double"))
