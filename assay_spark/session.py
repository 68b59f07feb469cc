"""Session construction and lineage cutting.

On a cluster the session is built by the platform; ``get_spark`` only fills
in settings that are unset, so cluster-level values (shuffle partitions,
checkpoint folder) always win.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings we want everywhere.  AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed join partitions.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "assay_spark", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object store) folder there, or the
    application has called ``setCheckpointDir``.  Only a local session may do
    without: it gets a folder under the system temp dir.  On a cluster the
    executors could not share that folder, so an unset one is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="assay-ckpt-")
        try:  # a core setting: some deployments refuse runtime changes
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001
            pass
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint) and truncates long
    plans such as iterative draws.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def write_stage(df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
    """Materialise ``df`` as Parquet under the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "stages", name)
    df.write.mode(mode).parquet(path)
    return spark.read.parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, now, into the shared checkpoint folder.

    For an intermediate read by several branches of one job: without an
    eager fill the branches run as parallel stages and each recomputes it.
    A reliable checkpoint (not a cache) holds no executor or driver heap
    across queries, survives executor loss and cuts the lineage.
    """
    return cut_lineage(df, eager=True)
