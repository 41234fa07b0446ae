"""Data-quality checks (F15, F16): asserts of the reference turned into one
aggregate pass that counts violations per rule (partial aggregation, no
collection of offending rows); ``enforce`` raises when any count is non-zero."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rivulet.session import materialize


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: ``n_rows`` and ``bad_<rule>`` counts for boolean rule columns
    that are True on a *violating* row."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.coalesce(c, F.lit(False))).alias(f"bad_{name}") for name, c in rules.items()]
    return df.agg(*aggs)


def enforce(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Like :func:`check`, but the result raises at execution time
    (``raise_error``) when any rule is violated."""
    res = check(df, rules)
    bad = [F.col(f"bad_{n}") for n in rules]
    total = F.lit(0)
    for b in bad:
        total = total + b
    # the check guards the row itself: a column of its own would be pruned
    return res.where(F.when(total > 0, F.raise_error(F.lit("data-quality check failed")).cast("boolean"))
                     .otherwise(F.lit(True)))


def tsv_field_rules(cols) -> dict[str, Column]:
    """no TAB inside fields written to a TSV."""
    return {f"tab_in_{c}": F.col(c).contains("\t") for c in cols}


def counted(df: DataFrame, name: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``df`` stored, and aggregates of its rows that are taken while they are
    written: there is no second pass over what made them."""
    seen = Observation()
    stored = materialize(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return stored, seen.get


def stored(df: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    """``df`` stored; raises if a row violates a rule, which is counted in
    the same pass."""
    kept, bad = counted(df, name, {rule: F.count_if(F.coalesce(c, F.lit(False))) for rule, c in rules.items()})
    if any(bad.values()):
        raise ValueError(f"data-quality check failed: {({k: n for k, n in bad.items() if n})}")
    return kept
