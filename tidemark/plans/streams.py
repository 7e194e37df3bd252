"""Stream lens: event windows and sessions, read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.common import Lens, table
from tidemark.streaming import windows

lens = Lens()


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@lens("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, CAST(floor(sum(value) * 100 + 0.5) AS BIGINT) AS total FROM events GROUP BY ALL")
def w_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.drained(windows.window_counts(_stream(spark, sf_dir), ["event_type"], "6 hours", watermark="1 day"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.floor(F.col("total") * 100 + 0.5).cast("bigint").alias("total"))


@lens("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def w_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "3 hours")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")
