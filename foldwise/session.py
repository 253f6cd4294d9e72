"""Spark session helpers.

The library never creates a session behind the caller's back: every operator
takes a DataFrame.  ``get_session`` is for scripts, tests and ``bench.py``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session settings every job of this package assumes.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "foldwise", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("FOLDWISE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is; it
    is an error to leave it unset there, because each executor would write to
    its own disk.  Only with a local master is a scratch folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="foldwise-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def null_safe_join(left, right, on, how="inner"):
    """Equi-join on the columns ``on`` in which null equals null; the columns
    of ``on`` come from ``left``."""
    from functools import reduce
    other = right.select(*[right[c].alias(f"_on_{c}") if c in on else right[c] for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[f"_on_{c}"]) for c in on])
    return left.join(other, cond, how).drop(*[f"_on_{c}" for c in on])


def run_folder(spark, *parts: str) -> str:
    """A new folder of its own below the shared checkpoint folder, so that one
    run never reads what another left."""
    import uuid
    return os.path.join(ensure_checkpoint_dir(spark), "runs", uuid.uuid4().hex, *parts)


def cut_lineage(df):
    """Materialise ``df`` into the shared checkpoint folder (reliable checkpoint).

    Survives executor loss, unlike a local checkpoint; used between the
    iterations of driver loops (tuning, epochs) so plans stay small.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df):
    """Write ``df`` once as a parquet table in the shared checkpoint folder
    and read it back: columnar, prunable, lineage cut, survives executor
    loss.  Used for intermediates that several branches of a plan reuse."""
    import uuid
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def open_fs(uri: str):
    """(file system, path) of a folder of the shared storage, as a task sees it."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def once(spark, folder: str, name: str, make):
    """The table ``name`` of a work ledger: read if an earlier run has finished it,
    else made by ``make()`` and written.  A run that was killed while writing left
    no success mark, so its part is made again."""
    path = os.path.join(folder, name)
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
