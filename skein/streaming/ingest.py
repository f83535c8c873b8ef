"""The ingest feed as a stream: evidence, latest events, write-back, review queue.

Every stream ends in ``foreachBatch`` with a write keyed by the batch number, so a
batch that runs again after a failure replaces its own files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators import linking


def read_feed(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, ``files`` per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def evidence(feed: DataFrame, delay: str = "1 hour", window: str = "1 day", time: str = "ts", key: str = "name") -> DataFrame:
    """Mentions per key and day; rows later than the delay are dropped by the watermark.

    Times without zone are taken as UTC.
    """
    t = feed.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    g = t.groupBy(F.window("_t", window).alias("w"), F.col(key).alias("name")).agg(F.count("*").alias("mentions"))
    return g.select("name", F.col("w.start").alias("day"), "mentions")


def sessions(feed: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions per key: runs of rows without a gap."""
    t = feed.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    g = t.groupBy(F.session_window("_t", gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return g.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write each batch to its own folder ``batch=N``; a retry overwrites it."""

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def link_feed(feed: DataFrame, stored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """PRECEDES edges from stored events to each batch of new ones."""

    def put(df: DataFrame, n: int) -> None:
        linking.link_across(df, stored).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return feed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def review_queue(resolutions: DataFrame) -> DataFrame:
    """The ambiguous rows of a resolution stream or table: the side output for review."""
    return resolutions.filter(F.coalesce("is_ambiguous", F.lit(False)))
