"""Archives as a stream: each micro-batch of new archives goes through the batch merge.

An extension; a run over a folder that grows gives the same index as batch runs in the same order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatloom.functions import chat

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def archive_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.zip").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(chat.file_name(F.col("path")).alias("source_zip"), "path", "content")


def start(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run merge(batch, id) for each micro-batch until the folder is read, then stop."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Messages per sender and window with a watermark; works on a stream and on a batch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "sender").agg(F.count("*").alias("messages")).select("w.start", "w.end", "sender", "messages")
