"""Incremental ingestion (an extension: the batch semantics on files as they come)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import text as T


def stream_json(spark: SparkSession, path: str, schema: str, per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def new_content(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first of each content hash within the watermark; state is dropped behind it."""
    hashed = stream.withColumn("content_hash", F.sha2(F.col("content"), 256))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def clean_stream(stream: DataFrame) -> DataFrame:
    """Cleaned text and quality of each row; stateless."""
    kind = T.content_type(F.col("content"))
    return stream.withColumn("type", kind).withColumn("content", T.clean(F.col("content"), F.col("type.is_technical"))).withColumn("quality_score", T.quality(F.col("content"), F.col("type.is_technical")))


def load(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append micro-batches to a Parquet table; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Events of each user by session window."""
    w = events.withWatermark("ts", delay) if events.isStreaming else events
    return w.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"))
