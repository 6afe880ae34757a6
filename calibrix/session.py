"""Session settings the engine relies on.

The library never creates a session behind the caller's back: every public
function takes DataFrames. ``build_session`` is for tests, the bench and
command-line use; on a cluster the job's own session is used, and only
``split_hot_batches`` sets what that session leaves unset.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans are designed around. AQE re-plans joins against the
# measured size of the per-batch fit tables (broadcast only when the runtime
# size is under the threshold) and splits a skewed batch in a sort-merge join.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(cores: int | str = "*", app: str = "calibrix",
                  shuffle_partitions: int | None = None,
                  driver_memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench (no UI, no server)."""
    n = shuffle_partitions or (8 if cores == "*" else int(cores))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(map=ENGINE_CONF)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def split_hot_batches(spark: SparkSession) -> None:
    """Let AQE split a skewed batch even where an aggregate by batch follows the
    join (it then adds the exchange the aggregate needs). Set only where the
    session does not say otherwise; ``BatchPipeline`` calls this."""
    key = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    if key not in spark.conf.getAll:
        spark.conf.set(key, "true")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; that value is always used.
    Only a ``local`` session (one machine, as in tests) without one gets a
    fresh scratch folder; on a cluster a missing setting is an error, since
    executors could not read each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="calibrix-ckpt-",
                                      dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame) -> DataFrame:
    """``df``, written once as Parquet into the shared folder. It takes a fraction
    of what ``materialize`` does, and the exchanges it was made from leave the
    executors' disks once it stands (their plan is not run again)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables of ``store`` that nothing reads any more."""
    for df in stored:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df):
    """Cut the lineage of a frame that several branches of a plan consume.

    Writes it once with ``checkpoint()`` into the shared checkpoint folder, so
    the branches read the written partitions instead of each recomputing the
    upstream plan (and a lost executor does not replay that plan either).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
