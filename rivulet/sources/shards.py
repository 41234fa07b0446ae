"""Large outputs in shards that a stopped job can take up again.

An output is a folder with ``shard=N`` for each shard, dealt by a hash of the
key, and an entry under ``_done`` once a shard is whole.  A run writes the shards
that have no entry, one after the other, each as a job of its own over all
executors; what a stopped run left of a shard is replaced.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _done(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    try:
        rows = spark.read.schema("shards int, shard int").parquet(f"{path}/_done/*").collect()
    except AnalysisException as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
        return []
    return [(r["shards"], r["shard"]) for r in rows]


def finished(spark: SparkSession, path: str) -> set[int]:
    """The shards that are whole."""
    return {shard for _, shard in _done(spark, path)}


def write_shards(df: DataFrame, path: str, key: str, num_shards: int,
                 transform: Callable[[DataFrame], DataFrame] | None = None) -> list[int]:
    """Write ``transform`` (an encoder, say) of each shard of ``df`` that is not
    there yet; returns which these were.  Shards hang on the key alone, so any
    run deals the same rows to them."""
    spark, path = df.sparkSession, path.rstrip("/")
    there = _done(spark, path)
    if any(n != num_shards for n, _ in there):
        raise ValueError(f"{path} was begun with {there[0][0]} shards")
    missing = sorted(set(range(num_shards)) - {s for _, s in there})
    dealt = F.pmod(F.xxhash64(F.col(key)), F.lit(num_shards))
    for shard in missing:
        part = df.where(dealt == shard)
        (part if transform is None else transform(part)).write.mode("overwrite").parquet(f"{path}/shard={shard}")
        spark.range(1).select(F.lit(num_shards).alias("shards"), F.lit(shard).alias("shard")).coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/_done/{shard}")
    return missing


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all whole shards, with ``shard``."""
    path = path.rstrip("/")
    whole = sorted(finished(spark, path))
    if not whole:
        raise ValueError(f"{path} has no whole shard")
    return spark.read.option("basePath", path).parquet(*[f"{path}/shard={s}" for s in whole])
