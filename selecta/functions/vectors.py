"""Dense vector expressions on ``array<float|double>`` columns.

Higher-order functions keep these JVM-side. ``aggregate`` sums in array
order, so results are deterministic per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from selecta.functions.core import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0), lambda acc, x: acc + x))


def l2_normalize(a) -> Column:
    """V / ||v||; a zero vector gives NULL (the reference would give NaN)."""
    # bind the vector, then its norm: each is evaluated once per row
    return let(_c(a), lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))))


def cosine(a, b) -> Column:
    """E5: dot / (||a|| ||b||); NULL when either norm is 0."""
    return let(F.struct(_c(a).alias("a"), _c(b).alias("b")), lambda p: let(
        norm(p["a"]) * norm(p["b"]), lambda den: F.when(den > 0, dot(p["a"], p["b"]) / den)))


def sq_euclidean(a, b) -> Column:
    d = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(F.transform(d, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)


def euclidean(a, b) -> Column:
    """E6."""
    return F.sqrt(sq_euclidean(a, b))


def to_double(a) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double"))
