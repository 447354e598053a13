"""Where intermediate tables live: the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``, in the application's own folder,
    which goes when the driver ends.  Without that setting a local session (a
    test) gets a temporary folder, and a cluster's session an error: a folder of
    one machine is none for the others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/marginalia-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    _made.append(f"{own}/{uuid.uuid4().hex}")
    return _made[-1]


#: Paths that shared_dir() gave out and that weren't removed.
_made: list[str] = []


def mark() -> int:
    """How many paths were given out and not removed."""
    return len(_made)


def kept(df: DataFrame, since: int) -> DataFrame:
    """``df`` written by cut().  What was written since mark() was ``since`` is
    removed, as nothing needs it once this is there; what was before stays."""
    spark, out = df.sparkSession, cut(df)
    for path in _made[since:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _made[since:-1]
    return out


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, any
    executor may be lost afterwards, and the planner knows its true size.  Texts
    take three quarters of the room that Parquet's usual compression leaves them."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of keys that a join may broadcast; about 60 MB of memory where they arrive.
BROADCAST_ROWS = 1_000_000


def lookup(keys: DataFrame) -> DataFrame:
    """A written table of keys, broadcast if it is small enough (its rows are
    counted); beyond that the join is left to shuffle both sides."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


#: Rows of an Arrow batch that holds texts, in a session that doesn't say how many.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``; its session sends texts to Python in batches of BATCH_ROWS at most.
    Spark counts a batch in rows, and 10,000 texts of a hundred kilobytes are a
    gigabyte.  A session that was given a value, Spark's own too, keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores added as no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
