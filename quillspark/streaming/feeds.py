"""State of feeds that a stream of checks keeps: failures in a row, times, the last error, and feeds that fell silent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import file_system, written

#: A feed without a check for so long is silent.
SILENT_SECONDS = 48 * 3600
#: How far checks of different feeds may come out of order.
DELAY = "1 hour"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = "checks long, failures long, longest long, ok_at long, failed_at long, checked_at long, error string"
OUTPUT = f"id long, {FIELDS}, silent boolean"


def after_checks(state: tuple, at: np.ndarray, failed: np.ndarray, error: list) -> tuple:
    """The state (FIELDS) after checks in order: microseconds, whether each failed, and its error.

    ok_at stays while a feed fails; failed_at and error stay when it recovers.
    """
    checks, failures, longest, ok_at, failed_at, _, last = state
    fine, bad = np.flatnonzero(~failed), np.flatnonzero(failed)
    if fine.size:
        runs = np.diff(fine) - 1
        longest = max(longest, failures + int(fine[0]), int(runs.max(initial=0)))
        failures, ok_at = len(at) - 1 - int(fine[-1]), int(at[fine[-1]])
    else:
        failures += len(at)
    if bad.size:
        failed_at, last = int(at[bad[-1]]), error[bad[-1]]
    return checks + len(at), failures, max(longest, failures), ok_at, failed_at, int(at[-1]), last


class Feeds(StatefulProcessor):
    """One feed's state. A batch's checks of a feed are sorted in its task; how many there are is bounded by what a trigger takes in."""

    def __init__(self, silent_seconds: int = SILENT_SECONDS):
        self.silent = silent_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", FIELDS)

    def _row(self, key, state: tuple, silent: bool) -> pd.DataFrame:
        frame = pd.DataFrame([(key[0], *state, silent)], columns=[c.split()[0] for c in OUTPUT.split(", ")])
        return frame.astype({c: "Int64" for c in ("ok_at", "failed_at")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        checks = pd.concat(rows).sort_values(["us", "seq"], kind="stable")
        before = self.state.get() if self.state.exists() else (0, 0, 0, None, None, None, None)
        state = after_checks(tuple(before), checks["us"].to_numpy(), checks["failed"].to_numpy(bool), checks["error"].tolist())
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state[5] // 1000 + self.silent)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, tuple(self.state.get()), True)

    def close(self) -> None:
        pass


def _rows(checks: DataFrame) -> DataFrame:
    """Checks with their types, those that count, with their time in microseconds too."""
    rows = checks.select(F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("seq").cast("long").alias("seq"), F.col("failed").cast("boolean").alias("failed"), F.col("error").cast("string").alias("error"))
    return rows.where("id IS NOT NULL AND at IS NOT NULL AND failed IS NOT NULL")


def feed_states(checks: DataFrame, silent_seconds: int = SILENT_SECONDS, delay: str = DELAY) -> DataFrame:
    """OUTPUT rows of a stream of checks (id, at, seq, failed, error), whenever a feed's state changes.

    at is a timestamp, seq orders checks of one time. A feed that has no check for
    silent_seconds of event time gives a row with silent set, once. Batches may be cut
    anywhere as long as a feed's checks come in order.
    """
    checks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = _rows(checks).withWatermark("at", delay)
    return rows.groupBy("id").transformWithStateInPandas(Feeds(silent_seconds), OUTPUT, "Update", "EventTime")


def _checks_of(batch: DataFrame) -> DataFrame:
    """A row for each feed of a batch: its checks, failures at its beginning and end, longest run, last times and last failure."""
    tie = [F.isnull("seq"), "seq"]
    checked = batch.withColumn("island", F.sum((~F.col("failed")).cast("long")).over(Window.partitionBy("id").orderBy("us", *tie).rowsBetween(Window.unboundedPreceding, 0)))
    bad = F.when(F.col("failed"), F.struct("us", F.isnull("seq").alias("last"), "seq", "error"))
    runs = checked.groupBy("id", "island").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("run"), F.max(F.when(~F.col("failed"), F.col("us"))).alias("fine_at"), F.max(bad).alias("bad"), F.max("us").alias("us"))
    begins = F.sum(F.when(F.col("island") == 0, F.col("run")).otherwise(0))
    return runs.groupBy("id").agg(F.sum("n").alias("n"), begins.alias("begins"), F.max_by("run", "island").alias("ends"), F.max("run").alias("run"), F.max("fine_at").alias("fine_at"), F.max("bad").alias("bad"), F.max("us").alias("us"))


def _after(old: DataFrame, new: DataFrame) -> DataFrame:
    """States (id, FIELDS, silent) after the rows of _checks_of(), as after_checks() gives them; touched where there was one."""
    was = old.select("id", *[F.col(c).alias(f"old_{c}") for c in old.columns if c != "id"])
    both = was.join(new, "id", "full_outer")
    failures, longest = F.coalesce("old_failures", F.lit(0)), F.coalesce("old_longest", F.lit(0))
    fresh = {
        "checks": F.coalesce("old_checks", F.lit(0)) + F.col("n"),
        "failures": F.when(F.col("fine_at").isNull(), failures + F.col("n")).otherwise(F.col("ends")),
        "longest": F.greatest(longest, failures + F.col("begins"), F.col("run")),
        "ok_at": F.coalesce("fine_at", "old_ok_at"),
        "failed_at": F.coalesce("bad.us", "old_failed_at"),
        "checked_at": F.col("us"),
        "error": F.when(F.col("bad").isNull(), F.col("old_error")).otherwise(F.col("bad.error")),
        "silent": F.lit(False),
    }
    touched = F.col("n").isNotNull()
    return both.select("id", *[F.when(touched, c).otherwise(F.col(f"old_{k}")).alias(k) for k, c in fresh.items()], touched.alias("touched"))


def keep_states(checks: DataFrame, path: str, silent_seconds: int = SILENT_SECONDS, delay: str = DELAY) -> StreamingQuery:
    """Take in what is there now and stop: each batch's rows, those of feed_states(), go to path/rows/batch=N, overwritten if the batch comes again.

    For runs that take in much at once: a batch is aggregated by feed and joined to the
    states that the batch before it left (path/states/batch=N, with the newest time in
    path/marks), so no feed costs a call of its own. As with a watermark, checks that are
    later than `delay` behind the batches before are left out.
    """
    spark = checks.sparkSession
    micros = int(spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {delay}"))).first()[0])
    state = f"id long, {FIELDS}, silent boolean"

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = session.read.schema("high long, batch long").parquet(f"{path}/marks").where(F.col("batch") < number) if number else None
        high, last = earlier.agg(F.max("high"), F.max("batch")).first() if number else (None, None)
        rows = batch if high is None else batch.where(F.col("us") > high // 1000 * 1000 - micros)
        new = written(_checks_of(rows), "checked")
        high = max((x for x in (high, new.agg(F.max("us")).first()[0]) if x is not None), default=None)
        old = session.createDataFrame([], state) if last is None else session.read.schema(state).parquet(f"{path}/states/batch={last}")
        after = _after(old, new)
        now = None if high is None else (high - micros) // 1000
        gone = F.lit(False) if now is None else ~F.col("silent") & (F.floor(F.col("checked_at") / 1000) + silent_seconds * 1000 < now)
        after = written(after.withColumn("gone", gone).withColumn("silent", F.col("silent") | F.col("gone")), "after")
        after.drop("touched", "gone").write.mode("overwrite").parquet(f"{path}/states/batch={number}")
        changes = F.explode(F.expr("filter(array(if(touched, false, null), if(gone, true, null)), x -> x IS NOT NULL)"))
        after.drop("silent").select("*", changes.alias("silent")).drop("touched", "gone").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        session.createDataFrame([(high,)], "high long").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        if last is not None and last > 0:
            fs, older = file_system(session, f"{path}/states/batch={last - 1}")  # this batch may come again, that one not
            fs.delete(older, True)

    return _rows(checks).writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def latest_states(spark, path: str) -> DataFrame:
    """The last row of each feed of keep_states()."""
    rows = spark.read.schema(f"{OUTPUT}, batch long").parquet(f"{path}/rows")
    return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "batch")]), F.struct("batch", "silent")).alias("s")).select("id", "s.*")
