"""Ranks, top lists, floors and digest order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 15
FLOOR = 5


def ranked(df: DataFrame, day: str = "day", peak: str = "peak", coverage: str = "coverage", key: str = "id") -> DataFrame:
    """rank within the day: peak, then coverage, both descending, then key."""
    order = Window.partitionBy(day).orderBy(F.desc(peak), F.desc(coverage), F.asc(key))
    return df.withColumn("rank", F.row_number().over(order))


def top(df: DataFrame, k: int = TOP, **columns: str) -> DataFrame:
    """The first k of each day; the filter on rank lets each task keep k rows a day before the shuffle."""
    return ranked(df, **columns).where(F.col("rank") <= k)


def _digest_first(coverage: str, at: str, key: str) -> list:
    return [F.desc(F.coalesce(coverage, F.lit(1))), F.desc(at), F.asc(key)]


def digest_order(df: DataFrame, day: str = "day", coverage: str = "coverage", at: str = "at", key: str = "id") -> DataFrame:
    """place within the day: coverage descending, null counting as 1, then newest first (null last), then key.

    at is a time. Rows are numbered within (day, coverage, minute), and the sizes of those
    groups say how many rows come before each, so no window holds all rows of a day.
    """
    keys = ["day", "weight", "minute"]
    parts = df.select(F.struct("*").alias("row"), F.col(day).alias("day"), F.coalesce(coverage, F.lit(1)).alias("weight"), F.date_trunc("minute", at).alias("minute"))
    earlier = Window.partitionBy("day").orderBy(F.desc("weight"), F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys).orderBy(F.desc(F.col("row")[at]), F.asc(F.col("row")[key]))
    placed = parts.withColumn("number", F.row_number().over(inside)).join(starts, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    return placed.select(*[F.col("row")[c].alias(c) for c in df.columns if c != "place"], (F.col("start") + F.col("number")).alias("place"))


def top_with_kept(now: DataFrame, before: DataFrame, k: int = TOP, day: str = "day", key: str = "id", **columns: str) -> DataFrame:
    """The first k of each day, and those of an earlier run's list that are still topics of the day, ranked anew.

    Why lists can be longer than k is unknown; this is an option, not a finding.
    """
    listed = top(now, k, day=day, key=key, **columns).select(day, key).unionByName(before.select(day, key)).distinct()
    return ranked(now.join(listed, [day, key], "left_semi"), day=day, key=key, **columns)


def digest(df: DataFrame, cap: int, day: str = "day", genre: str = "genre", coverage: str = "coverage", at: str = "at", key: str = "id", floor: int = FLOOR) -> DataFrame:
    """The first rows of each day's digest after genre_floor, at most cap; each task keeps cap rows a day before the shuffle.

    How the source data chooses its cap is unknown.
    """
    order = Window.partitionBy(day).orderBy(*_digest_first(coverage, at, key))
    return genre_floor(df, day, genre, coverage, at, key, floor).withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def genre_floor(df: DataFrame, day: str = "day", genre: str = "genre", coverage: str = "coverage", at: str = "at", key: str = "id", floor: int = FLOOR) -> DataFrame:
    """Covered rows, and in each (day, genre) with fewer than floor of them the newest uncovered rows up to floor.

    A row is covered where coverage is not null. At most floor uncovered rows of
    a group leave a task.
    """
    covered = df.where(F.col(coverage).isNotNull())
    count = covered.groupBy(F.col(day).alias("_day"), F.col(genre).alias("_genre")).agg(F.count(F.lit(1)).alias("_covered"))
    newest = Window.partitionBy(day, genre).orderBy(F.desc(at), F.asc(key))
    spare = df.where(F.col(coverage).isNull()).withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= floor)
    spare = spare.join(count, F.col(day).eqNullSafe(F.col("_day")) & F.col(genre).eqNullSafe(F.col("_genre")), "left")
    filled = spare.where(F.col("_place") <= F.lit(floor) - F.coalesce("_covered", F.lit(0)))
    return covered.unionByName(filled.select(*df.columns))
