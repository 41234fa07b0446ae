"""Evaluate columns once per row and use them inside higher-order lambdas.

Catalyst may inline a projected expression into every lambda invocation that
references it (collapsing projections), which turns ``transform(xs, i ->
tokens[i])`` over a *computed* ``tokens`` into one tokenization per element.
``let`` binds the values as lambda variables instead: a ``transform`` over a
one-element array evaluates its argument once, and nested lambdas read the
bound variable.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(fn, *cols: Column) -> Column:
    names = [f"v{i}" for i in range(len(cols))]
    packed = F.array(F.struct(*[c.alias(n) for c, n in zip(cols, names)]))
    return F.transform(packed, lambda r: fn(*[r[n] for n in names]))[0]
