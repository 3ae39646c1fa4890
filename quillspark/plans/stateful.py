"""Queries that keep state between runs: streams, totals, tables with upserts, versions.

Each replays the events of its tables in several runs, as they would come in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time
from ..operators import rolling, series
from ..sources.scratch import scratch_path
from ..streaming import feeds, refresh
from .catalog import _A, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: A topic's life ends where it is not seen for so long.
LIFE = 72 * 3600


def query(sql: str):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_ARRIVALS = """e AS (SELECT *, least(3, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END + (event_id % 5 = 0)::INT) AS arrives FROM events)"""


def _arrivals(events: DataFrame) -> DataFrame:
    """Events with the run in which they arrive: by time, but a fifth of them one run late."""
    own = F.when(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"), 1).when(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"), 2).otherwise(3)
    return events.withColumn("arrives", F.least(F.lit(3), own + (F.col("event_id") % 5 == 0).cast("int")))


@query(f"""WITH {_ARRIVALS}, h AS (SELECT arrives, max(ts) AS high FROM e GROUP BY 1),
d AS (SELECT e.arrives, user_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, (SELECT max(high) FROM h WHERE h.arrives < e.arrives) AS before FROM e),
k AS (SELECT * FROM d WHERE before IS NULL OR day + INTERVAL 15 HOUR + INTERVAL 48 HOUR >= before),
t AS (SELECT day, count(*) AS articles, count(DISTINCT user_id) AS media, max(arrives) AS last FROM k GROUP BY day),
u AS (SELECT *, (SELECT max(high) FROM h WHERE arrives <= last) AS updated FROM t)
SELECT CAST(day AS VARCHAR) AS day, articles, media, last - 1 AS batch, CAST(least(updated, day + INTERVAL 15 HOUR) AS VARCHAR) AS until, updated < day + INTERVAL 15 HOUR AS is_open FROM u""")
def refreshed_days(spark, sf_dir):
    """Daily totals published by a stream in three batches, the second of which comes twice; a fifth of the rows are late, within 48 hours and beyond."""
    events = _arrivals(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"))
    source, days = scratch_path(spark, "arrivals"), refresh.DayRefresh(scratch_path(spark, "refreshed"))
    for k in (1, 2, 3):
        events.where(F.col("arrives") == k).drop("arrives").write.mode("append").parquet(source)
        days.run(spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long").parquet(source)).awaitTermination()
    days.apply(events.where("arrives = 2"), 1)
    day = F.col("day").cast("date")
    return days.days(spark).select("day", "articles", "media", "batch", F.col("until").cast("string").alias("until"), (F.col("updated") < time.day_end(day)).alias("is_open"))


@query(f"""WITH m AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, props, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, island, CAST(sum(bad::INT) AS BIGINT) AS run FROM m GROUP BY ALL),
f AS (SELECT user_id, arg_max(run, island) AS failures, max(run) AS longest FROM r GROUP BY user_id),
h AS (SELECT user_id, count(*) AS checks, CAST(max(ts) FILTER (NOT bad) AS VARCHAR) AS ok_at, CAST(max(ts) FILTER (bad) AS VARCHAR) AS failed_at,
  arg_max('k ' || json_extract_string(props, '$.k'), (ts, event_id)) FILTER (bad) AS error, max(ts) AS last FROM m GROUP BY user_id)
SELECT user_id, checks, failures, longest, ok_at, failed_at, error, last + INTERVAL {feeds.SILENT_SECONDS} SECOND < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS silent FROM f JOIN h USING (user_id)""")
def feed_states(spark, sf_dir):
    """Feed states that a stream of checks keeps, over three batches: events are checks, and an error is a failure with its props as message."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    checks = e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), failed.alias("failed"), F.when(failed, F.concat(F.lit("k "), F.get_json_object("props", "$.k"))).alias("error"))
    source, path = scratch_path(spark, "checks"), scratch_path(spark, "feed_states")
    edges = ["2023-01-01", "2024-01-08", "2024-01-19", "2100-01-01"]
    for low, high in zip(edges, edges[1:], strict=False):
        at = [F.lit(x).cast("timestamp_ntz") for x in (low, high)]
        checks.where((F.col("at") >= at[0]) & (F.col("at") < at[1])).write.mode("append").parquet(source)
        feeds.keep_states(spark.readStream.schema(checks.schema).parquet(source), path).awaitTermination()
    time_of = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").cast("string").alias(c)
    return feeds.latest_states(spark, path).select(F.col("id").alias("user_id"), "checks", "failures", "longest", time_of("ok_at"), time_of("failed_at"), "error", "silent")


@query(f"""WITH {_ARRIVALS} SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS articles, count(DISTINCT user_id) AS media, max(arrives) AS run FROM e GROUP BY 1""")
def rolling_totals(spark, sf_dir):
    """Daily totals kept up to date over three runs with late rows; run is the last that rewrote the day."""
    events = _arrivals(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"))
    rows = events.select("arrives", time.civil_day(F.col("ts")).cast("string").alias("day"), F.col("user_id").alias("source"))
    path = scratch_path(spark, "rolling")
    for k in (1, 2, 3):
        rolling.update_totals(spark, path, rows.where(F.col("arrives") == k), k)
    return rolling.read_totals(spark, path)


@query(f"""WITH t AS (SELECT event_type || '-' || user_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
g AS (SELECT *, sec - lag(sec) OVER (PARTITION BY id ORDER BY sec) AS gap FROM t),
l AS (SELECT *, 1 + sum(CASE WHEN gap > {LIFE} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS life FROM g)
SELECT id, CAST(life AS BIGINT) AS life, min(sec) AS first, max(sec) AS last, count(DISTINCT sec // 86400) AS days, count(*) AS rows, (SELECT max(sec) FROM t) - max(sec) > {LIFE} AS expired FROM l GROUP BY id, life""")
def topic_lives(spark, sf_dir):
    """The lives of topics across days: where one is not seen for 72 hours, it ends, and later rows are another life."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return series.lives(e, LIFE).select("id", F.col("life").cast("long").alias("life"), "first", "last", "days", "rows", "expired")


@query("""WITH p AS (SELECT user_id AS id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT DISTINCT id, hour + unnest([0, 24, 168]) AS hour FROM p)
SELECT c.id, c.hour, CAST(coalesce(sum(n) FILTER (p.hour > c.hour - 24), 0) AS BIGINT) AS day, CAST(coalesce(sum(n), 0) AS BIGINT) AS week
FROM c LEFT JOIN p ON p.id = c.id AND p.hour <= c.hour AND p.hour > c.hour - 168 GROUP BY ALL""")
def sliding_popularity(spark, sf_dir):
    """How often each id was seen in the last day and week, at every hour where that changes."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return rolling.sliding(e, {"day": 24, "week": 168})
