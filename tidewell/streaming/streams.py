"""Streaming forms: idempotent append, version fold, polling, time to live, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.dataset import Store
from tidewell.operators.versions import latest_view


def source(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt)
    reader = reader.schema(schema if schema is not None else spark.read.format(fmt).load(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def append_stream(stream: DataFrame, store: Store, dataset: str, checkpoint: str, name: str = "append", once: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Each micro-batch is appended once: its epoch is the batch id that its rows carry."""
    def write(df: DataFrame, epoch: int) -> None:
        store.append(dataset, df, f"{name}-{epoch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def fold_versions(stream: DataFrame, path: str, key: str, version: str, checkpoint: str) -> StreamingQuery:
    """Keeps the highest version of each key: batches go to a log that grows by append; ``folded`` reads it.

    Arrival order does not matter; a repeated epoch overwrites its own part.
    """
    def write(df: DataFrame, epoch: int) -> None:
        best = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), version).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, path: str, key: str, version: str, deleted: str | None = None) -> DataFrame:
    return latest_view(spark.read.parquet(path).drop("epoch"), key, version, deleted)


def live(df: DataFrame, now_ms: int, start: str = "valid_from_ms", end: str = "valid_until_ms") -> DataFrame:
    """Rows valid at ``now_ms``; a null bound is open."""
    return df.where((F.col(start).isNull() | (F.col(start) <= now_ms)) & (F.col(end).isNull() | (F.col(end) >= now_ms)))


def window_counts(df: DataFrame, ts: str = "ts", size: str = "1 day", keys: tuple[str, ...] = ("event_type",), late: str = "1 hour") -> DataFrame:
    """Counts in tumbling event-time windows; on a stream with a watermark.  Batch and streaming frames alike."""
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if df.isStreaming:
        timed = timed.withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", size).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n")
