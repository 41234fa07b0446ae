"""Spark session helpers.

Library code never creates its own cluster settings; it only reads what the
session already has.  ``get_session`` is a convenience for tests, the bench and
local runs: it fills in local defaults *only where a setting is unset*.
"""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "rivulet") -> SparkSession:
    """Return the active session, or build a local one for tests / bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        ship_package(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("RIVULET_MASTER", "local[8]"))
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only when it is unset and the master is local (tests) do we create a
    scratch folder; on a cluster a folder of one machine would be of no use to
    the others, so that raises.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = spark.sparkContext._jsc.sc().getCheckpointDir()
        cur = cur.get() if cur.isDefined() else None
    if not cur:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        cur = tempfile.mkdtemp(prefix="rivulet-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    spark.sparkContext.setCheckpointDir(cur)
    return cur


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def materialize(df, name: str = "table"):
    """Write ``df`` once as a Parquet table under the session's checkpoint
    folder (shared on a cluster) and return it read back: the lineage is cut,
    later branches read columnar files instead of recomputing, and a lost
    executor re-reads files rather than re-running the upstream plan."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/rivulet-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Rows up to which a stored table is sent to all tasks.
SENT_ROWS = 1 << 19


def sent(df):
    """``df``, a stored table or one made of such, to be sent to all tasks if it
    has few rows, so that what it is joined with stays where it is.  Its rows
    are counted, since Spark's guess of a joined or grouped table's size is a
    product of sizes."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def files_key(df) -> str:
    """A name for the data that ``df`` reads: its files, their sizes and times
    of change.  Changed data has another name, so what is stored under it is
    never stale."""
    from pyspark.sql import functions as F

    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}-{int(row['h'] or 0) % (1 << 64):016x}"


_SHIPPED: set[str] = set()
_ZIP: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Make ``rivulet`` importable in executor Python workers.

    UDFs and ``mapInArrow`` functions are pickled by reference to their
    module, so workers must import the package.  A zip of it is built once
    per driver process and added with ``addPyFile`` once per application
    (Spark distributes it to every executor)."""
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    if not _ZIP:
        pkg = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg)
        out = os.path.join(tempfile.mkdtemp(prefix="rivulet-pkg-"), "rivulet.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _dirs, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(d, f)
                        z.write(full, os.path.relpath(full, root))
        _ZIP.append(out)
    spark.sparkContext.addPyFile(_ZIP[0])
    _SHIPPED.add(app)
