"""The decision log as a stream: late rows within a watermark, repeats dropped, a table kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillgraph.schemas import DECISION


def stream(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """New decisions with their time, each run and question once within the watermark."""
    rows = spark.readStream.schema(DECISION).json(path).withColumn("at", F.to_timestamp("ts")).where(F.col("at").isNotNull())
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "question_id"])


def route_counts(rows: DataFrame, window: str = "1 hour") -> DataFrame:
    return rows.groupBy(F.window("at", window), "route").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("latency_ms")).select(F.col("window.start").alias("start"), "route", "n", "latency_ms")


def start(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all there is and stop; run again, it goes on where it was."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
