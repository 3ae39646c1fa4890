"""Daily totals over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Finished days are rewritten as long.
LATE = "48 hours"
AHEAD = 9


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files below path as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def daily_totals(events: DataFrame, at: str = "ts", source: str = "user_id", late: str = LATE) -> DataFrame:
    """(day, articles, media) of each civil day; the distinct sources are a sketch, for exact ones need all keys as state.

    Runs on streams and on tables. Rows later than the watermark do not count.
    """
    stamped = events.withColumn("_at", (F.col(at) + F.expr(f"INTERVAL {AHEAD} HOURS")).cast("timestamp"))
    days = stamped.withWatermark("_at", late).groupBy(F.window("_at", "1 day"))
    counted = days.agg(F.count(F.lit(1)).alias("articles"), F.approx_count_distinct(source, 0.01).alias("media"))
    return counted.select(F.to_date("window.start").cast("string").alias("day"), "articles", "media")


def exact_daily_totals(events: DataFrame, at: str = "ts", source: str = "user_id", late: str = LATE) -> DataFrame:
    """daily_totals() with an exact count of sources: (day, source) first, then the day; its state has a row for each source of an open day.

    On streams in append mode only.
    """
    stamped = events.withColumn("_at", (F.col(at) + F.expr(f"INTERVAL {AHEAD} HOURS")).cast("timestamp"))
    parts = stamped.withWatermark("_at", late).groupBy(F.window("_at", "1 day"), source).agg(F.count(F.lit(1)).alias("n"))
    days = parts.select(F.window_time("window").alias("_at"), "n", source).groupBy(F.window("_at", "1 day"))
    counted = days.agg(F.sum("n").alias("articles"), F.count(source).alias("media"))
    return counted.select(F.to_date("window.start").cast("string").alias("day"), "articles", "media")


def write_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now and stop; a later call goes on from the checkpoint."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
