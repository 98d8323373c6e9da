"""Spark session helpers.

The library never builds its own cluster configuration: it reads what the session
already carries and only fills gaps for local runs (tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # pandas 2.x deprecation chatter from PySpark's own Arrow serializer in Python workers
    "spark.executorEnv.PYTHONWARNINGS": "ignore::FutureWarning",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "xmcforge",
                  driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster the folder must be shared storage named by ``spark.checkpoint.dir``.
    Only a local master may fall back to a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="xmcforge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.sparkContext.defaultParallelism)


def reliable_checkpoint(df):
    """``df.checkpoint(eager=True)`` into the session's shared checkpoint folder (set from
    ``spark.checkpoint.dir`` first when the context has none yet)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
