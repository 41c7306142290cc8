"""Session helpers.

On a cluster the session is created by the platform; ``get_session`` only
fills in settings that are unset, so it never overrides cluster settings.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the engine relies on.  ANSI mode stays on (Spark 4 default); all
# parsing goes through try_* functions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Keep generated methods under the JIT limit: a stage whose method would
    # exceed it falls back to split expression code instead of running in
    # the bytecode interpreter.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole texts travel to Python: fewer rows at a time.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "tallyframe",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one with engine defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        apply_runtime_defaults(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_runtime_defaults(spark: SparkSession) -> None:
    """Set the SQL settings that the engine's semantics depend on where the
    user left them unset (session scoped)."""
    for key in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy", "spark.sql.codegen.hugeMethodLimit",
                "spark.sql.execution.arrow.maxRecordsPerBatch"):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, DEFAULT_CONF[key])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; only a local master without the
    setting (tests, local runs) gets a private scratch folder.  Elsewhere
    executors would write to their own disks, so that is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tallyframe-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, for files that are not wanted
    after the session; it does not exist yet, the folder around it goes at the end."""
    import uuid

    around = os.path.join(ensure_checkpoint_dir(spark), name, uuid.uuid4().hex)
    folder = spark._jvm.org.apache.hadoop.fs.Path(around)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return os.path.join(around, "data")


def stage(df, name: str = "stage"):
    """Cut the lineage of ``df`` at a natural staging point of a run.

    Writes ``df`` as parquet under the shared checkpoint folder
    (``spark.checkpoint.dir``) and reads it back: one computation, later
    stages scan columnar staged rows (with pruning and pushdown) instead of
    re-running the whole plan, and a lost executor costs a re-read, not a
    recomputation from the raw files."""
    return df.sparkSession.read.parquet(stage_path(df, name))


def stage_path(df, name: str = "stage") -> str:
    """Write ``df`` under the shared checkpoint folder; return the folder."""
    import uuid

    root = ensure_checkpoint_dir(df.sparkSession)
    path = os.path.join(root, "staged", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    # staged data live as long as the session
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path
