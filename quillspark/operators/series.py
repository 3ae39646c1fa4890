"""Coverage over days, bursts, and runs of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(df: DataFrame, key: str = "id", day: str = "day") -> DataFrame:
    """(key, day, added, coverage, is_first): rows of each day and their sum so far.

    Rows are counted for each (key, day) first, so a window holds days, not rows.
    """
    days = df.groupBy(key, day).agg(F.count(F.lit(1)).alias("added"))
    past = Window.partitionBy(key).orderBy(day)
    return days.withColumn("coverage", F.sum("added").over(past.rowsBetween(Window.unboundedPreceding, 0))).withColumn("is_first", F.row_number().over(past) == 1)


def coverage_steps(covered: DataFrame, key: str = "id", day: str = "day") -> DataFrame:
    """covered with the day and coverage before, and whether coverage = before + added holds."""
    past = Window.partitionBy(key).orderBy(day)
    out = covered.withColumn("day_before", F.lag(day).over(past)).withColumn("coverage_before", F.lag("coverage").over(past))
    return out.withColumn("holds", F.col("coverage") == F.coalesce("coverage_before", F.lit(0)) + F.col("added"))


def first_at(df: DataFrame, key: str = "id", day: str = "day", at: str = "at") -> DataFrame:
    """(key, day, first_at, stable): the least time of key among its rows up to each day, and whether the day before had the same."""
    past = Window.partitionBy(key).orderBy(day)
    days = df.groupBy(key, day).agg(F.min(at).alias("_least"))
    days = days.withColumn("first_at", F.min("_least").over(past.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("first_at").over(past)
    return days.select(key, day, "first_at", (before.isNull() | before.eqNullSafe(F.col("first_at"))).alias("stable"))


def burst(df: DataFrame, seconds: int, key: str = "id", at: str = "at", by: tuple[str, ...] = ()) -> DataFrame:
    """(key, by, burst): the most rows of key in any `seconds` up to one of its rows.

    at is in whole seconds. Each row is also put into the next bucket of
    `seconds`, where it can only be looked back at, so a window holds two
    buckets of a key and never all of its rows.
    """
    bucket = F.floor(F.col(at) / seconds)
    parts = df.select(key, at, *by, F.explode(F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own")))).alias("b"))
    near = Window.partitionBy(key, "b.bucket").orderBy(at).rangeBetween(-seconds + 1, 0)
    counted = parts.withColumn("n", F.count(F.lit(1)).over(near)).where("b.own")
    return counted.groupBy(key, *by).agg(F.max("n").alias("burst"))


def failure_runs(df: DataFrame, key: str = "id", at: str = "at", failed: str = "failed", order: str = "seq", day: str = "day") -> DataFrame:
    """(key, failures, longest): the failures since the last success, and the longest run of failures.

    Runs inside a day are found in windows over (key, day). What a day leaves is
    one row: its first and last run and whether anything succeeded. Runs across
    days come from those rows, so no window holds all rows of a key.
    """
    in_day = Window.partitionBy(key, day).orderBy(at, order)
    marked = df.select(key, day, at, order, F.col(failed).cast("int").alias("bad")).withColumn("island", F.sum(1 - F.col("bad")).over(in_day))
    runs = marked.groupBy(key, day, "island").agg(F.sum("bad").alias("run"))
    days = runs.groupBy(key, day).agg(
        F.min_by("run", "island").alias("head"),
        F.max_by("run", "island").alias("tail"),
        F.max("run").alias("most"),
        (F.max("island") > 0).alias("any_ok"),
        (F.min("island") > 0).alias("starts_ok"),
    )
    over = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("chain", F.sum(F.col("any_ok").cast("int")).over(over))
    # a day without a success prolongs the chain; one with a success ends it by its head and starts the next by its tail
    head = F.when(F.col("any_ok") & F.col("starts_ok"), 0).otherwise(F.col("head"))
    pieces = days.select(key, "most", F.explode(F.when(F.col("any_ok"), F.array(F.struct((F.col("chain") - 1).alias("chain"), head.alias("n")), F.struct(F.col("chain").alias("chain"), F.col("tail").alias("n")))).otherwise(F.array(F.struct(F.col("chain").alias("chain"), F.col("tail").alias("n"))))).alias("p"))
    chains = pieces.groupBy(key, "p.chain").agg(F.sum("p.n").alias("n"), F.max("most").alias("most"))
    return chains.groupBy(key).agg(F.max_by("n", "chain").alias("failures"), F.greatest(F.max("n"), F.max("most")).alias("longest"))


def health(df: DataFrame, key: str = "id", at: str = "at", failed: str = "failed") -> DataFrame:
    """(key, checks, ok_at, failed_at, healthy): times of the last success and failure; healthy where the success is later."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("checks"), F.max(F.when(~F.col(failed), F.col(at))).alias("ok_at"), F.max(F.when(F.col(failed), F.col(at))).alias("failed_at"))
    return out.withColumn("healthy", F.coalesce(F.col("ok_at") > F.col("failed_at"), F.col("failed_at").isNull()))


def lives(df: DataFrame, seconds: int, key: str = "id", at: str = "at") -> DataFrame:
    """(key, life, first, last, days, rows, longest_gap, expired): the lives of each key, which end where it is not seen for more than `seconds`.

    at is in whole seconds, and `seconds` a day or more. Rows are first reduced to one for
    each (key, day): gaps inside a day cannot end a life, so a window holds a key's days,
    however often it is seen. A life has expired if it ended more than `seconds` before
    the last row of all. Lives count from 1.
    """
    if seconds < 86400:
        raise ValueError("a life's gap is a day or more")
    day = F.floor(F.col(at) / 86400)
    inside = Window.partitionBy(key).orderBy("_day")
    days = df.groupBy(key, day.alias("_day")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("rows"))
    gap = F.col("first") - F.lag("last").over(inside)
    days = days.withColumn("gap", gap).withColumn("life", 1 + F.sum(F.when(F.col("gap") > seconds, 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = days.groupBy(key, "life").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("days"), F.sum("rows").alias("rows"), F.max(F.when(F.col("gap") <= seconds, F.col("gap"))).alias("longest_gap"))
    end = out.agg(F.max("last").alias("_end"))  # one row
    return out.join(F.broadcast(end), F.lit(True)).withColumn("expired", F.col("_end") - F.col("last") > seconds).drop("_end")
