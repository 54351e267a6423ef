"""Documents as a file stream: each run takes what is new since its checkpoint, and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import decode


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text, replaced of every .txt file that arrives in the folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(folder)
    text, replaced = decode()
    return files.select(F.col("path").alias("doc_id"), text.alias("text"), replaced.alias("replaced"))


def process_new(documents: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run the transform on what is new, once, exactly once for each document; results go to a Parquet folder by batch.

    A batch that is run again after a failure replaces its own folder, so nothing is doubled.
    """

    def batch(rows: DataFrame, n: int) -> None:
        transform(rows.withColumn("doc_seq", F.monotonically_increasing_id())).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
