"""Totals that are kept up to date: states that merge, so a run reads its new rows and the days that they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.documents import publish
from ..sources.scratch import exists, written

STATE = "bucket long, articles long, sources binary"


def day_state(rows: DataFrame, day: str = "day", source: str = "source") -> DataFrame:
    """(day, bucket, articles, sources): rows of each day, and the bitmap of its sources, whole numbers, in buckets of 32,768.

    Bitmaps of two states merge without loss, so distinct counts stay exact. A row
    without source counts as an article alone.
    """
    bucket = F.coalesce(F.bitmap_bucket_number(source), F.lit(0))
    return rows.groupBy(day, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("articles"), F.bitmap_construct_agg(F.bitmap_bit_position(source)).alias("sources"))


def merged(states: DataFrame, *more, day: str = "day") -> DataFrame:
    """One state of several; more are further aggregates."""
    return states.groupBy(day, "bucket").agg(F.sum("articles").alias("articles"), F.bitmap_or_agg("sources").alias("sources"), *more)


def totals(state: DataFrame, *more, day: str = "day") -> DataFrame:
    """(day, articles, media) of a state."""
    return state.groupBy(day).agg(F.sum("articles").alias("articles"), F.sum(F.bitmap_count("sources")).alias("media"), *more)


def update_totals(spark: SparkSession, path: str, rows: DataFrame, run: int, day: str = "day", source: str = "source") -> None:
    """Add rows to the state below path, which is partitioned by day.

    Only the days of the rows are read and rewritten, with `run` beside them; the files of
    other days stay. Runs must not be repeated with the same rows.
    """
    new = written(day_state(rows, day, source), "new_state")
    if exists(spark, path):
        days = new.select(day).distinct()
        old = spark.read.schema(f"{STATE}, run int, {day} string").parquet(path).join(days, day, "left_semi")
        new = written(merged(new.unionByName(old.drop("run")), day=day), "merged_state")
    publish(new.withColumn("run", F.lit(run)), path, day)


def read_totals(spark: SparkSession, path: str, day: str = "day") -> DataFrame:
    """(day, articles, media, run): run is the last that rewrote the day."""
    return totals(spark.read.schema(f"{STATE}, run int, {day} string").parquet(path), F.max("run").alias("run"), day=day)


def sliding(rows: DataFrame, hours: dict[str, int], key: str = "id", at: str = "at") -> DataFrame:
    """(key, hour, one column for each of hours): how many rows of key lie in the last so many hours, at each hour where one of these counts changes.

    at is in whole seconds; hour is counted from 1970 and its own rows belong to it.
    Rows are counted in panes of an hour. A pane is added at its hour and taken off when
    a window has passed it, so a window function sees a key's panes, not its rows, once
    for all lengths.
    """
    panes = rows.groupBy(key, F.floor(F.col(at) / 3600).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    step = lambda after, name: F.struct((F.col("hour") + after).alias("hour"), *[(F.col("n") if name is None else -F.col("n") if c == name else F.lit(0)).cast("long").alias(c) for c in hours])
    steps = panes.select(key, F.explode(F.array(step(0, None), *[step(n, c) for c, n in hours.items()])).alias("s")).select(key, "s.*")
    changes = steps.groupBy(key, "hour").agg(*[F.sum(c).alias(c) for c in hours])
    so_far = Window.partitionBy(key).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return changes.select(key, "hour", *[F.sum(c).over(so_far).alias(c) for c in hours])
