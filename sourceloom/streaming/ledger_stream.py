"""Ledgers as streams: current suggestion state, and daily operation counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir


#: Setting for how many batches' progress a query keeps, and that number.
_PROGRESS, _BATCHES = "spark.sql.streaming.numRecentProgressUpdates", "100000"


def stream_events(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """File stream of events with the event time as TIMESTAMP, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def latest_status(events: DataFrame, late: str = "45 days") -> DataFrame:
    """State per id over a stream: duplicates within the watermark go, and arrival order does not matter."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("events"),
    )


def daily_counts(operations: DataFrame, late: str = "1 day") -> DataFrame:
    """Operations per day and type. In update mode every day is emitted, and again when it changes; in append mode a day is
    emitted once, after the watermark has passed it."""
    day = F.window("ts", "1 day")
    counted = operations.withWatermark("ts", late).groupBy(day, "operation_type").agg(F.count(F.lit(1)).alias("operations"))
    return counted.select(F.col("window.start").alias("day"), "operation_type", "operations")


def _run(stream: DataFrame, mode: str) -> tuple[str, list[dict]]:
    """Runs a stream over all available input; the folder of its rows, and the progress of each batch.

    Every micro-batch is written to the shared folder under its batch number, so a repeated batch overwrites itself.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    kept = spark.conf.get(_PROGRESS)
    spark.conf.set(_PROGRESS, _BATCHES)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_PROGRESS, kept)
    return root, [json.loads(p.json) for p in query.recentProgress]


def _last_rows(stream: DataFrame, keys: list[str], schema: str, root: str) -> DataFrame:
    names = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.schema(schema + ", batch int").parquet(f"{root}/rows")
    return rows.groupBy(*keys).agg(*[F.max_by(n, "batch").alias(n) for n in names])


def run_to_table(stream: DataFrame, keys: list[str], mode: str, schema: str) -> DataFrame:
    """Runs a stream over all available input and returns its final rows.

    In update mode a later batch replaces the rows of an earlier one with the same keys.
    """
    return _last_rows(stream, keys, schema, _run(stream, mode)[0])


def batch_counts(progress: dict) -> dict[str, int]:
    """What became of a batch's rows, from its progress: ``received`` rows are ``kept``, ``duplicates`` or ``late``.

    Late rows are those behind the watermark; the operator that drops duplicates leaves them out and counts both. Use it in a
    listener to account for a stream that goes on.
    """
    found = [o for o in progress["stateOperators"] if o["operatorName"] == "dedupeWithinWatermark"]
    late = sum(o["numRowsDroppedByWatermark"] for o in found)
    duplicates = sum(o["customMetrics"].get("numDroppedDuplicateRows", 0) for o in found)
    received = progress["numInputRows"]
    return {"batch": progress["batchId"], "received": received, "kept": received - late - duplicates, "duplicates": duplicates, "late": late}


def run_counted(stream: DataFrame, keys: list[str], mode: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """As ``run_to_table``, and (batch, received, kept, duplicates, late) of each batch: no row of the input goes unaccounted for."""
    root, progress = _run(stream, mode)
    counts = [batch_counts(p) for p in progress if p["numInputRows"]]
    fields = "batch bigint, received bigint, kept bigint, duplicates bigint, late bigint"
    return _last_rows(stream, keys, schema, root), stream.sparkSession.createDataFrame(counts, fields)
