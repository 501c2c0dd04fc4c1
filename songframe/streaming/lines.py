"""Resumable and running work on new files: an addition of our own.

process_new() takes each new file of a folder once, however often it is run.
note_counts() counts the notes of charts over event time, with late ones
dropped after a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_new(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, step) -> StreamingQuery:
    """Run step(DataFrame) on the rows of Parquet files that are new since the last
    call, append the result to `out` and stop. A batch that is repeated after a
    failure writes into its own folder again."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(path)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def note_counts(notes: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """notes (chart_id, ts, kind), a stream or not: counts by chart and window."""
    rows = notes.withWatermark("ts", late).groupBy("chart_id", F.window("ts", window))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "golden").alias("golden"))
    return out.select("chart_id", F.col("window.start").alias("begin"), "n", "golden")
