"""Incremental ingestion: files are decoded as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators import comments as ops
from marginalia.sources import archives, document

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream(spark: SparkSession, path: str, parts: tuple[str, ...] = document.PARTS, pattern: str = "*.docx", files_per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame with one decoded row per new file."""
    found = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return archives.parse(found.select(F.col("path").alias("file_path"), "content"), parts, archives.ALL_FIELDS)


def write_comments(decoded: DataFrame, to: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes comments, statistics and errors of every micro-batch below ``to``,
    under the batch's number: a batch that runs again replaces its own files."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, table in (("comments", ops.full(batch)), ("document_stats", ops.document_stats(batch)), ("errors", ops.errors(batch))):
                table.write.mode("overwrite").parquet(f"{to}/{name}/batch={number}")
        finally:
            batch.unpersist()

    writer = decoded.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
