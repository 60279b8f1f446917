"""Vector functions on array columns, all JVM-side higher-order functions.

Vectors are stored as ``array<float>``; arithmetic is done in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    """Inner product."""
    prod = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_norm(v) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def l2_normalize(v) -> Column:
    """Divide by the L2 norm, no epsilon. A zero vector gives null."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n))


def cosine(a, b) -> Column:
    """Cosine of two vectors; null when either is zero."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def scale_logits(score, log_scale: float) -> Column:
    """Multiply by exp(log_scale)."""
    return _c(score) * F.exp(F.lit(float(log_scale)))


def argmax(arr) -> Column:
    """0-based index of the first maximum."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def masked_fill(v, mask, value: float) -> Column:
    """Replace elements where the mask is set (non-zero / true)."""
    return F.zip_with(as_double(v), _c(mask),
                      lambda x, m: F.when(m.cast("boolean"), F.lit(float(value))).otherwise(x))


def standardize_channels(pixels, mean: list[float], std: list[float], max_value: float = 255.0,
                         channels: int = 3) -> Column:
    """X / max_value, minus the channel mean, over the channel std.

    Element i belongs to channel ``i % channels`` (interleaved layout).
    """
    m = F.array(*[F.lit(float(x)) for x in mean])
    s = F.array(*[F.lit(float(x)) for x in std])
    return F.transform(as_double(pixels), lambda x, i: (x / F.lit(float(max_value))
                       - F.element_at(m, F.pmod(i, F.lit(channels)) + 1))
                       / F.element_at(s, F.pmod(i, F.lit(channels)) + 1))


def vec_round(v, digits: int = 4) -> Column:
    """Round each element, folding -0.0 into 0.0 (for stable comparison)."""
    return F.transform(as_double(v), lambda x: F.round(x, digits) + F.lit(0.0))


def num_round(x, digits: int = 4) -> Column:
    return (F.round(_c(x).cast("double"), digits) + F.lit(0.0)).cast("double")
