"""Column -> Column vector functions over ARRAY<FLOAT|DOUBLE> columns.

These are the row-level forms (higher-order built-ins, no Python).  Volume
scoring of many pairs goes through :mod:`rivulet.operators.knn`, which does
blocked matrix products on Arrow batches instead.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    """Inner product accumulated in double."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm2(a) -> Column:
    """Squared L2 norm in double."""
    return F.aggregate(_c(a), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def cosine(a, b) -> Column:
    """Cosine similarity; null when either vector has zero norm."""
    den = F.sqrt(norm2(a)) * F.sqrt(norm2(b))
    return F.when(den > 0, dot(a, b) / den)


def l2_normalize(a) -> Column:
    n = F.sqrt(norm2(a))
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(
        F.transform(_c(a), lambda x: x.cast("double")))


def mips_augment_doc(a, phi) -> Column:
    """X15 (document side): append sqrt(phi - |v|^2)."""
    extra = F.sqrt(F.greatest(_c(phi) - norm2(a), F.lit(0.0)))
    return F.concat(F.transform(_c(a), lambda x: x.cast("double")), F.array(extra))


def mips_augment_query(a) -> Column:
    """X15 (query side): append a zero."""
    return F.concat(F.transform(_c(a), lambda x: x.cast("double")), F.array(F.lit(0.0)))


def first_token_pool(token_vectors) -> Column:
    """Pooled vector = the first token's vector."""
    return F.element_at(_c(token_vectors), 1)


def project(vec, matrix) -> Column:
    """Optional linear projection ``W @ v`` with a fixed (parameter) matrix."""
    rows = [F.array(*[F.lit(float(x)) for x in r]) for r in matrix]
    return F.array(*[dot(r, _c(vec)) for r in rows])
