"""Days that a stream publishes again while rows for them still come in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import time
from ..operators.rolling import STATE, day_state, merged, totals
from ..sources.documents import publish
from ..sources.scratch import exists, written

#: Rows of a day count until so long after its end.
LATE = "48 HOURS"


@dataclass(frozen=True)
class DayRefresh:
    """Daily totals below path, rewritten by each batch of a stream for the days that it has rows of.

    A batch leaves its days' states (parts/batch=N) and the latest time in it (marks/batch=N);
    what is published is made of these alone. So a batch that comes again overwrites what
    it left and publishes the same, and the days of other batches stay as they are. A row
    counts unless its day ended more than `late` before the latest time of the batches
    before its own; which rows those are does not change when a batch comes again.
    """

    path: str
    late: str = LATE
    at: str = "ts"
    source: str = "user_id"

    def apply(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: take in one batch and publish its days again."""
        spark = batch.sparkSession
        rows = batch.select(F.col(self.at).alias("at"), F.col(self.source).alias("source"), time.civil_day(F.col(self.at)).cast("string").alias("day"))
        ends = time.day_end(F.col("day").cast("date")) + F.expr(f"INTERVAL {self.late}")
        before = F.broadcast(self._marks(spark).where(F.col("batch") < number).agg(F.max("high").alias("before")))  # one row
        counted = written(rows.join(before, F.lit(True)).where(F.col("before").isNull() | (ends >= F.col("before"))).select("at", "source", "day"), "batch")
        state = day_state(counted).withColumn("batch", F.lit(number).cast("long"))
        state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(f"{self.path}/parts")
        high = batch.agg(F.max(self.at).alias("high")).withColumn("batch", F.lit(number).cast("long"))
        high.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/marks")

        parts = spark.read.schema(f"{STATE}, batch long, day string").parquet(f"{self.path}/parts")
        touched = parts.where(F.col("batch") == number).select("day").distinct()
        # (day, bucket) rows of the touched days; a day's last batch says up to when it is known
        days = totals(merged(parts.join(touched, "day", "left_semi"), F.max("batch").alias("batch")), F.max("batch").alias("batch"))
        marks = F.broadcast(self._marks(spark).agg(F.collect_list(F.struct("batch", "high")).alias("marks")))  # one row; a batch is one entry
        known = F.array_max(F.transform(F.filter("marks", lambda m: m["batch"] <= F.col("batch")), lambda m: m["high"]))
        out = written(days.join(marks, F.lit(True)).select("day", "articles", "media", "batch", known.alias("updated")), "days")
        publish(out.withColumn("until", time.until(F.col("updated"), F.col("day").cast("date"))), f"{self.path}/days", "day")

    def _marks(self, spark: SparkSession) -> DataFrame:
        schema, path = "high timestamp_ntz, batch long", f"{self.path}/marks"
        return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)

    def days(self, spark: SparkSession) -> DataFrame:
        """(day, articles, media, batch, updated, until) as published last; an open day's until is its updated."""
        return spark.read.schema("articles long, media long, batch long, updated timestamp_ntz, until timestamp_ntz, day string").parquet(f"{self.path}/days")

    def run(self, stream: DataFrame) -> StreamingQuery:
        """Take in what is there now and stop; a later call goes on from there."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
