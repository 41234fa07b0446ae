"""Order-dependent helpers: global dense ids and running totals without a
single-partition window (W4, W9 and the compat run ids of W3).

Method:
1. Bucket bounds on the leading order column are computed once
   (``approxQuantile``: ``n - 1`` values, bounded by the bucket count) and
   embedded as literals, so every later evaluation -- including a recompute
   after an executor loss -- assigns every row to the same bucket, no matter
   the upstream row order.  (A ``RangePartitioner`` would re-sample and could
   disagree between the two branches below.)
2. Rows are hash-partitioned by bucket; a window *per bucket* numbers / sums
   rows in the full order (no single-partition window).
3. Per-bucket totals (one row per bucket) get prefix sums and are broadcast
   back to offset every bucket.

The input is written once to the checkpoint folder first (``materialize_input``)
because steps 1-3 each read it; otherwise an expensive upstream would run
three times.

A leading value that holds more than 1/n of the rows (a hot key) gets extra
boundaries on the second order column, so it spreads over several buckets
instead of making one huge window partition.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _num_buckets(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _order_cols(order_by) -> list[Column]:
    cols = order_by if isinstance(order_by, (list, tuple)) else [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _bucketed(df: DataFrame, order_by, n: int, materialize_input: bool = True):
    if materialize_input:
        # the bounds pass, the per-bucket totals and the numbering all read the
        # input; write it once so the upstream plan runs once (columnar reads
        # of only the needed columns afterwards)
        from rivulet.session import materialize
        df = materialize(df, "ordered_input")
    cols = _order_cols(order_by)
    lead = cols[0]
    d = df.withColumn("__lead", lead.cast("double"))
    if n > 1:
        probs = [i / n for i in range(1, n)]
        bounds = sorted(set(x for x in d.approxQuantile("__lead", probs, 1.0 / (4 * n))
                            if x is not None))
    else:
        bounds = []
    bucket = F.lit(0)
    if bounds:
        arr = F.array(*[F.lit(float(b)) for b in bounds])
        bucket = F.coalesce(F.size(F.filter(arr, lambda b: b < F.col("__lead"))), F.lit(0))
    extra = _hot_boundaries(d, cols, n) if n > 1 and len(cols) > 1 else []
    if extra:
        # a leading value holding more than 1/n of the rows is split further
        # on the second order column: boundary (v, s) is below a row iff
        # lead > v, or lead == v and second > s (lexicographic)
        second = cols[1]
        hot = F.array(*[F.struct(F.lit(float(v)).alias("v"), F.lit(sv).alias("s")) for v, sv in extra])
        bucket = bucket + F.size(F.filter(hot, lambda x: (x["v"] < F.col("__lead")) |
                                          ((x["v"] == F.col("__lead")) & (x["s"] < second))))
    d = d.withColumn("__b", bucket.cast("int")).drop("__lead")
    return d.repartition(max(len(bounds) + len(extra) + 1, 1), "__b"), cols


def _hot_boundaries(d: DataFrame, cols, n: int) -> list:
    """Second-level bounds for leading values that hold more than 1/n of the
    rows.  Hot values are at most n (each exceeds 1/n of the rows); their
    bounds come from ``approxQuantile`` (numeric second key) or a bounded
    sample of the second key (used for bounds only; every row is kept)."""
    total = d.count()
    if total == 0:
        return []
    hot = (d.groupBy("__lead").count().where(F.col("count") > total / n)
           .orderBy("__lead").collect())  # <= n rows
    second = cols[1]
    out = []
    for r in hot:
        v, cnt = r["__lead"], r["count"]
        k = max(int(cnt * n / total), 1)          # sub-buckets for this value
        rows = d.where(F.col("__lead") == v).select(second.alias("__s"))
        if isinstance(rows.schema["__s"].dataType, (T.NumericType,)):
            qs = rows.withColumn("__s", F.col("__s").cast("double")).approxQuantile(
                "__s", [i / (k + 1) for i in range(1, k + 1)], 1.0 / (4 * (k + 1)))
        else:
            frac = min(1.0, 20.0 * (k + 1) / cnt)
            sample = sorted(x["__s"] for x in rows.sample(fraction=frac, seed=17).limit(20 * (k + 1)).collect()
                            if x["__s"] is not None)
            qs = [sample[(i * len(sample)) // (k + 1)] for i in range(1, k + 1)] if sample else []
        out += [(v, s) for s in sorted(set(x for x in qs if x is not None))]
    return out


def _with_offsets(local: DataFrame, totals: DataFrame, name: str, start: int) -> DataFrame:
    wp = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__b", F.coalesce(F.sum("__tot").over(wp), F.lit(0)).alias("__off"))
    out = local.join(F.broadcast(offsets), "__b")  # one row per bucket
    return (out.withColumn(name, (F.col("__off") + F.col("__loc") + F.lit(start)).cast("long"))
            .drop("__b", "__loc", "__off"))


def add_dense_id(df: DataFrame, order_by, name: str = "id", start: int = 1,
                 num_partitions: int | None = None, materialize_input: bool = True) -> DataFrame:
    """Dense ids ``start, start+1, ...`` in the total order ``order_by``.

    ``order_by`` must be a unique key (ties would make ids non-deterministic);
    its first column must be numeric (it drives the bucket bounds).
    """
    b, cols = _bucketed(df, order_by, _num_buckets(df, num_partitions), materialize_input)
    w = Window.partitionBy("__b").orderBy(*cols)
    local = b.withColumn("__loc", (F.row_number().over(w) - 1).cast("long"))
    totals = b.groupBy("__b").agg(F.count(F.lit(1)).alias("__tot"))
    return _with_offsets(local, totals, name, start)


def running_sum(df: DataFrame, order_by, value: str, name: str, start: int = 0,
                inclusive: bool = True, num_partitions: int | None = None,
                materialize_input: bool = True) -> DataFrame:
    """Global running sum of integer column ``value`` in the total order
    ``order_by``; ``inclusive=False`` sums only the rows strictly before."""
    b, cols = _bucketed(df, order_by, _num_buckets(df, num_partitions), materialize_input)
    v = F.coalesce(F.col(value).cast("long"), F.lit(0))
    w = Window.partitionBy("__b").orderBy(*cols).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    local = b.withColumn("__loc", F.coalesce(F.sum(v).over(w), F.lit(0)).cast("long"))
    totals = b.groupBy("__b").agg(F.sum(v).alias("__tot"))
    return _with_offsets(local, totals, name, start)
