"""Temporal windows over event streams; the same plan runs on a table and on a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import shared_dir


def window_counts(events: DataFrame, by: list[str], size: str, slide: str | None = None, watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """Count and sum per window and key; windows are [start, end). With a watermark, later rows are left out of a stream."""
    late = events.withWatermark(ts, watermark) if watermark else events
    grouped = late.groupBy(F.window(ts, size, slide or size).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, by: list[str], gap: str, watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """Sessions of each key that end after a gap."""
    late = events.withWatermark(ts, watermark) if watermark else events
    grouped = late.groupBy(F.session_window(ts, gap).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is available now and read what it wrote in the end.

    The sink and the checkpoint are new folders under spark.checkpoint.dir. Each batch replaces the table of its
    number, so a batch that is tried again changes nothing."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{number}")
        batches.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    wanted = batches[-1:] if mode == "complete" else batches
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{root}/out/{n}" for n in sorted(set(wanted))])
