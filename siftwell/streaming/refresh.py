"""Incremental refresh: new document files are chunked, embedded and put into the index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.chunking import index_rows, write_index
from siftwell.session import written
from siftwell.sources.tables import SOURCES


def index_stream(spark: SparkSession, incoming: str, index: str, checkpoint: str, source: str, embed) -> StreamingQuery:
    """Takes all files below ``incoming`` that were not taken before, then stops (a scheduled job calls it again).

    A document that comes again replaces its chunks: each batch rewrites the source's partition from what it kept and what is new,
    so a batch that runs twice gives the same index.
    """
    docs = spark.readStream.schema(SOURCES[source]).parquet(incoming).select("*", F.col("_metadata.file_modification_time").alias("_written"))

    def put(batch: DataFrame, batch_id: int) -> None:
        last = Window.partitionBy("id").orderBy(F.col("_written").desc(), "content")
        newest = written(batch.withColumn("_r", F.row_number().over(last)).where(F.col("_r") == 1).drop("_r", "_written"), "batch")
        rows = embed(index_rows(newest, source), "content", "passage")
        try:
            old = spark.read.parquet(index).where(F.col("resource") == source)
            kept = old.join(newest.select(F.col("id").alias("mongo_id")), "mongo_id", "left_anti").select(rows.columns)
            rows = written(kept.unionByName(rows), "index")  # the partition that is read is the one that is replaced
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        write_index(rows, index)

    return docs.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start()


def feedback_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n, total) of a stream or table of (ts, event_type, value), late rows within a watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")
