"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, in the application's own folder,
    which goes when the driver ends.  A local session without that setting, as in
    tests, gets a temporary one; on a cluster no machine's folder would do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/marginalia-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """``df`` written there and read back: Python ran once, whatever is derived
    from it, and no executor's loss asks for it again."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
