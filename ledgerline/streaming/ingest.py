"""Structured Streaming: ingest into a store, and a latest state kept by a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import padded
from ..operators.resolve import current
from ..schema import DELETE, PUT
from ..sources.files import Files, shared_dir


def changes_of(events: DataFrame) -> DataFrame:
    """Events as changes (seq, op, key, value), batch or stream."""
    gone = F.col("event_type") == "error"
    return events.select(F.col("event_id").alias("seq"), F.when(gone, DELETE).otherwise(PUT).alias("op"), padded("user:", "user_id", 8).alias("key"), F.when(~gone, F.col("props")).alias("value"))


def latest_state(changes: DataFrame) -> DataFrame:
    """The newest change of each key over a stream; changes that arrive late lose by their seq."""
    newest = F.max(F.struct("seq", "op", "value")).alias("n")
    return changes.groupBy("key").agg(newest).select("key", "n.op", "n.value", "n.seq")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Changes by window of event time and op; rows later than the watermark are dropped by Spark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    op = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("op")
    return timed.groupBy(F.window("at", every), op).agg(F.count("*").alias("changes")).select("window.start", "window.end", "op", "changes")


def ingest(changes: DataFrame, store, checkpoint: str, trigger: dict | None = None):
    """Appends each micro-batch of changes (seq, op, key, value) to the store; returns the running query.

    The manifest that publishes a batch holds its id, so a batch is applied once, wherever a run before stopped.
    """
    name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            store.append(batch, order_by="seq", stream=(name, batch_id))
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_state_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys of the events table, read as a stream of files until its end.

    Each batch writes only the keys that it changed, under its own id, so a repeated batch replaces itself; the batches
    are a change log, and the state is its newest change of each key.
    """
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet")
    folder, _, name = path.rpartition("/")
    is_file = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isFile()
    rows = events.option("pathGlobFilter", name).parquet(folder) if is_file else events.parquet(path)
    place = Files(spark, f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}")
    place.make("state")
    state = latest_state(changes_of(rows))
    write = state.writeStream.outputMode("update").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(place.full(f"state/batch={i}")))
    write.option("checkpointLocation", place.full("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return current(spark.read.schema(state.schema).parquet(place.full("state")))
