"""Column functions over vectors, intervals and decay; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance, rounded to 6 decimals so that ranks don't hang on the order of summation."""
    return F.round(F.sqrt(squared_l2(a, b)), 6)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """v over its norm; a zero vector gives null."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n))


def pad(v: Column, width: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(v)))


def affine(v: Column, w: Column, b: Column) -> Column:
    """v W + b for W as an array of columns."""
    return F.zip_with(w, b, lambda c, x: F.aggregate(F.zip_with(v, c, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y) + x)


def low_rank(v: Column, down: Column, up: Column, b: Column) -> Column:
    """U (V' v) + b, with V and U as arrays of columns and rows."""
    inner = F.transform(down, lambda c: F.aggregate(F.zip_with(v, c, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y))
    return affine(inner, up, b)


def width_of(eps: Column, scale: Column) -> Column:
    """scale * eps, infinite when either is: never the NaN of infinity times zero."""
    return F.when((eps == INF) | (scale == INF), F.lit(INF)).otherwise(eps * scale)


def cert_eps(eps: Column, by_region: bool) -> Column:
    """The radius that a certificate scales: the region's, or 1 for all regions with a finite one."""
    return eps if by_region else F.when(eps == INF, eps).otherwise(F.lit(1.0))


def lower_bound(d: Column, exact: Column, width: Column) -> Column:
    return F.when(exact, d).when(width == INF, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), d - width))


def upper_bound(d: Column, exact: Column, width: Column) -> Column:
    return F.when(exact, d).when(width == INF, F.lit(INF)).otherwise(d + width)


def normalized_error(d_hat: Column, d_star: Column, eps: Column) -> Column:
    """|d_hat - d_star| / eps; an infinite radius counts as 0, a zero radius as 0 or infinite."""
    err = F.abs(d_hat - d_star)
    return F.when(eps == INF, 0.0).when(eps > 0, err / F.nullif(eps, F.lit(0.0))).when(err > 0, INF).otherwise(0.0)


def decay(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age / F.lit(half_life))


def fence(incarnation: Column, counter: Column) -> Column:
    return F.shiftleft(incarnation.cast("bigint"), 40).bitwiseOR(counter.cast("bigint"))
