"""Similarity of vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNROLL = 128  # up to this many dimensions a query vector becomes plain arithmetic, which is compiled


def _sized(v: Column, dim: Column | int, value: Column) -> Column:
    n = F.lit(dim) if isinstance(dim, int) else dim
    return F.when(v.isNull(), F.lit(None).cast("double")).when(F.size(v) != n, F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(value)


def _fold(terms: list[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def _dot(v: Column, q: list[float]) -> Column:
    if len(q) <= _UNROLL:
        return _fold([F.get(v, F.lit(i)).cast("double") * F.lit(float(x)) for i, x in enumerate(q)])
    return F.aggregate(F.zip_with(v, F.lit([float(x) for x in q]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def _square(v: Column, dim: int) -> Column:
    if dim <= _UNROLL:
        return _fold([F.get(v, F.lit(i)).cast("double") * F.get(v, F.lit(i)).cast("double") for i in range(dim)])
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine_to(v: Column, q: list[float]) -> Column:
    """Cosine of v to a driver-side vector; 0 where either has no length; an error where lengths differ."""
    own = sum(x * x for x in q) ** 0.5
    norm = F.sqrt(_square(v, len(q)))
    return _sized(v, len(q), F.lit(0.0) if own == 0 else F.when(norm == 0, 0.0).otherwise(_dot(v, q) / (norm * F.lit(own))))


def l2_score_to(v: Column, q: list[float]) -> Column:
    """Minus the squared distance of v to a driver-side vector."""
    if len(q) <= _UNROLL:
        diff = [F.get(v, F.lit(i)).cast("double") - F.lit(float(x)) for i, x in enumerate(q)]
        return _sized(v, len(q), -_fold([d * d for d in diff]))
    return _sized(v, len(q), -F.aggregate(F.zip_with(v, F.lit([float(x) for x in q]), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns."""
    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return _sized(a, F.size(b), F.when(norm == 0, 0.0).otherwise(dot / norm))


def finite(v: Column) -> Column:
    """Whether v is a non-empty vector of finite numbers."""
    return F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def checked(v: Column) -> Column:
    """v as doubles; an error if a number is not finite."""
    return F.when(finite(v), v.cast("array<double>")).otherwise(F.raise_error(F.lit("vector values must be finite numbers")).cast("array<double>"))


def rounded(c: Column, digits: int) -> Column:
    """c rounded, with the sign of what rounds to zero: -0.0 for negative numbers, as in IEEE arithmetic and SQL."""
    r = F.round(c, digits)
    return F.when(r == 0, c * F.lit(0.0)).otherwise(r)
