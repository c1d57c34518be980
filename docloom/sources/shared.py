"""Tables and folders in the storage that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BASES: set = set()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, in a folder of the application that goes when it ends.

    Where a session of one process leaves the setting unset, a folder of this machine is taken; on a cluster that raises
    ValueError, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = next((b for b in _BASES if b.startswith("file:///")), None) or "file://" + tempfile.mkdtemp(prefix="docloom-")
    base = root if root in _BASES else f"{root.rstrip('/')}/docloom-tables-{spark.sparkContext.applicationId}"
    if base not in _BASES:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _BASES.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared storage and read again, so that it is computed once and survives executors."""
    path = shared_folder(df.sparkSession, "held")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
