"""Session settings that every operator with Python workers relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound Arrow batches by bytes so that rows of any length fit a worker."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if not 0 < int(spark.conf.get(key)) <= BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
    except Exception:  # a Spark without this setting: the row limit alone holds
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and tables that all executors share: the one that spark.checkpoint.dir names. Only a session
    on one machine, as in tests, may go without and gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="parley-checkpoint-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def build(app: str = "parley", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use __ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return ready(builder.getOrCreate())
