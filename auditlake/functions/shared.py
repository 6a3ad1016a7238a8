"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_folders: set[str] = set()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which all nodes see. Only a local session without that setting gets one of its own.

    All paths of an application lie in one folder, which goes when the driver's JVM ends in order."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else ""
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="auditlake-")
            spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/auditlake-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _folders.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder: it survives the loss of any executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *by: str) -> DataFrame:
    """Rows of a scan of few splits, dealt out by a hash so that every core has work; a scan of many splits stays as it is."""
    tasks = 4 * scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(tasks, *by) if scan.rdd.getNumPartitions() < tasks else scan
