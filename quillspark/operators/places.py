"""Places of rows in a global order, without a window over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: monotonically_increasing_id() has the row of a partition in so many low bits.
_ROW_BITS = 33


def places(df: DataFrame, order: Sequence[Column | str], within: Sequence[str] = (), name: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in `order` among the rows of the same `within`.

    Rows are dealt by ranges of the order and sorted inside them. What a range has of a
    group is counted, and the counts of the ranges before it say where its rows begin. A
    window sees one row for each group and range, so neither a large group nor one order
    of everything meets in a task. Rows that order does not tell apart have places of
    their own, in any order, and are spread too. Groups that are null are one group.
    """
    given = written(df, "unplaced")  # finding the ranges reads it a second time
    keys = [*(F.col(w) for w in within), *order, F.col("_tie")]
    ranged = given.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_at", _ROW_BITS))

    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*within, "_range").agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    starts = starts.select("_least", "_start", *[F.col(c).alias(f"_of_{c}") for c in (*within, "_range")])
    placed = ranged.join(starts, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*within, "_range")])
    return placed.select(*[c for c in df.columns if c != name], (F.col("_start") + F.col("_at") - F.col("_least") + 1).alias(name))
