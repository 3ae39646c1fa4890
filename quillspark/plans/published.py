"""Queries through the published JSON documents: written in their own form, read back by the readers.

What a document holds is aggregated first, so a file is as large as its day's
genres or its month's notes, however many rows the tables have.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nested
from ..operators import daily, ranking, series
from ..sources import documents, schemas
from ..sources.scratch import scratch_path
from .catalog import _A, _COVERED, _TOPICS, _articles, _covered, _topics, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: A day's list in a trend document is this long.
LISTED = 15


def query(sql: str):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trend document for each day, written to a file of its own and read again."""
    a = _articles(spark, sf_dir).select("day", "genre", "source")
    genres = daily.genre_topics(a.withColumn("topic", F.col("source")))
    genres = genres.groupBy("day").agg(nested.sorted_map(F.col("genre"), F.struct(F.col("articles").cast("int").alias("articles"), F.col("topics").cast("int").alias("topics"))).alias("genres"), F.sum("topics").cast("int").alias("topics"))
    top = ranking.top(_topics(spark, sf_dir), LISTED).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "coverage", "peak"))).alias("top"))
    days = daily.totals(a).join(genres, "day").join(top, "day", "left")
    path = scratch_path(spark, "trends")
    documents.write_named(days.select(F.col("day").alias("file"), F.col("day").alias("date"), "articles", "media", "topics", "genres", "top"), path, "file")
    return documents.read_days(spark, path)


@query(f"""WITH {_A}, g AS (SELECT day, genre, source, count(*) AS n FROM a GROUP BY ALL),
t AS (SELECT day, CAST(count(*) AS INTEGER) AS day_articles, CAST(count(DISTINCT source) AS INTEGER) AS day_media FROM a GROUP BY day)
SELECT day, genre, CAST(sum(n) AS INTEGER) AS articles, CAST(count(*) FILTER (n >= 2) AS INTEGER) AS topics, day_articles, day_media FROM g JOIN t USING (day) GROUP BY day, genre, day_articles, day_media""")
def trend_documents(spark, sf_dir):
    """The genres of each day and the day's totals, read from one document a day."""
    trends = _trends(spark, sf_dir)
    genres = documents.genre_days(trends).select(F.col("date").cast("string").alias("day"), "genre", "articles", "topics")
    return genres.join(trends.select(F.col("date").cast("string").alias("day"), F.col("articles").alias("day_articles"), F.col("media").alias("day_media")), "day")


@query(f"""WITH {_TOPICS} SELECT day, CAST(row_number() OVER (PARTITION BY day ORDER BY peak DESC, coverage DESC, id) AS INTEGER) AS rank, id, CAST(coverage AS INTEGER) AS coverage, CAST(peak AS INTEGER) AS peak
FROM t QUALIFY rank <= {LISTED}""")
def trend_topics(spark, sf_dir):
    """The topics that each day's document lists, with the rank that their place in it gives."""
    return documents.topic_days(_trends(spark, sf_dir)).select(F.col("date").cast("string").alias("day"), "rank", "id", "coverage", "peak")


@query("""WITH a AS (SELECT strftime(ts, '%Y-%m') AS month, event_type AS topic, user_id, ts FROM events),
n AS (SELECT month, topic, min(ts) AS first_at, CAST(min(user_id) AS VARCHAR) AS low, CAST(max(user_id) AS VARCHAR) AS high, count(*) AS n FROM a GROUP BY ALL),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY first_at DESC, topic) AS INTEGER) AS place FROM n)
SELECT month, topic, place, CAST(date_trunc('second', first_at) AS VARCHAR) AS first_at, claim, source, n || ' articles' AS background FROM p,
LATERAL (SELECT 'lowest' AS claim, low AS source UNION ALL SELECT 'both', low UNION ALL SELECT 'both', high WHERE high <> low) c""")
def note_documents(spark, sf_dir):
    """Notes of each month, newest first in one array a month, with the sources of their nested claims."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_type").alias("topic"), F.col("user_id").alias("source"), "ts")
    low, high = F.min("source").cast("string"), F.max("source").cast("string")
    claim = lambda text, sources: F.struct(F.lit(text).alias("text"), F.array_distinct(F.array(*sources)).alias("sources"))
    notes = e.groupBy("month", "topic").agg(
        F.min("ts").alias("at"),
        F.array_distinct(F.array(low, high)).alias("items"),
        F.array(claim("lowest", [low]), claim("both", [low, high])).alias("common"),
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" articles")).alias("background"),
    )
    note = F.struct("topic", "items", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("firstAt"), "common", "background")
    newest_first = Window.partitionBy("month").orderBy(F.desc("at"), F.asc_nulls_last("topic"))  # a row for each topic
    listed = F.array_sort(F.collect_list(F.struct("place", note.alias("note"))))
    months = notes.withColumn("place", F.row_number().over(newest_first)).groupBy("month").agg(F.transform(listed, lambda x: x["note"]).alias("notes"))
    path = scratch_path(spark, "notes")
    documents.write_arrays(months, path, "month", "notes")
    placed = documents.read_listed(spark, path, schemas.NOTE)
    claims = placed.select("month", "topic", "place", F.date_format("firstAt", "yyyy-MM-dd HH:mm:ss").alias("first_at"), "background", F.explode("common").alias("c"))
    return claims.select("month", "topic", "place", "first_at", F.col("c.text").alias("claim"), F.explode("c.sources").alias("source"), "background")


@query("""SELECT n_name AS id, CAST(count(*) FILTER (s_acctbal < 0) AS INTEGER) AS failures, CAST(count(s_suppkey) AS INTEGER) AS count, CASE WHEN count(*) FILTER (s_acctbal < 0) > 0 THEN 'HTTP 503' END AS error
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def feed_documents(spark, sf_dir):
    """Feed states from one object keyed by source, its keys in order; a feed without failures has no error."""
    n, s = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    bad = F.count_if(F.col("s_acctbal") < 0).cast("int")
    feeds = n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(bad.alias("failures"), F.count("s_suppkey").cast("int").alias("count"), F.when(bad > 0, F.lit("HTTP 503")).alias("error"))
    root = feeds.agg(nested.sorted_map(F.col("n_name"), F.struct("failures", "count", "error")).alias("feeds"))
    path = scratch_path(spark, "feeds")
    root.select(F.to_json("feeds")).write.text(path)
    return documents.read_map(spark, path).select(F.col("sourceId").alias("id"), "failures", "count", "error")


@query(f"""WITH {_A}, c AS (SELECT max(day) AS last FROM a WHERE ts < TIMESTAMP '2024-01-20'),
one AS (SELECT day, count(*) AS articles, 1 AS run FROM a WHERE ts < TIMESTAMP '2024-01-20' GROUP BY day),
two AS (SELECT day, count(*) AS articles, 2 AS run FROM a, c WHERE day >= CAST(CAST(last AS DATE) - 2 AS VARCHAR) GROUP BY day)
SELECT * FROM two UNION ALL SELECT * FROM one WHERE day NOT IN (SELECT day FROM two)""")
def published_days(spark, sf_dir):
    """Daily totals published twice: the second run rewrites the open days and adds later ones, the others stay as the first left them."""
    a = _articles(spark, sf_dir).select("day", "ts")
    first = a.where("ts < TIMESTAMP_NTZ '2024-01-20'")
    count = F.count(F.lit(1)).alias("articles")
    path = scratch_path(spark, "days")
    documents.publish(first.groupBy("day").agg(count).withColumn("run", F.lit(1)), path, "day")
    last = F.broadcast(first.agg(F.date_sub(F.max("day").cast("date"), 2).cast("string").alias("open")))  # one row
    documents.publish(a.join(last, F.col("day") >= F.col("open")).groupBy("day").agg(count).withColumn("run", F.lit(2)), path, "day")
    return spark.read.schema("articles long, run int, day string").parquet(path).select("day", "articles", "run")


@query("""SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS source, CAST(o_orderdate AS VARCHAR) AS at, o_orderdate >= TIMESTAMP '1998-01-01' AS new FROM orders""")
def request_log(spark, sf_dir):
    """The log of requests with the new ones put in, newest first."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("source"), F.col("o_orderdate").alias("requestedAt"))
    fresh = F.col("requestedAt") >= F.lit("1998-01-01").cast("timestamp_ntz")
    log = documents.enqueue(o.where(~fresh), o.where(fresh))
    return log.select("id", "source", F.date_format("requestedAt", "yyyy-MM-dd HH:mm:ss").alias("at"), fresh.alias("new"))


@query("""WITH d AS (SELECT l_partkey AS id, l_orderkey // 1000 AS run, min(l_shipdate) AS least FROM lineitem GROUP BY ALL),
f AS (SELECT id, run, min(least) OVER (PARTITION BY id ORDER BY run) AS first_at FROM d)
SELECT id, run, CAST(CAST(first_at AS DATE) AS VARCHAR) AS first_at, coalesce(lag(first_at) OVER (PARTITION BY id ORDER BY run) = first_at, TRUE) AS stable FROM f""")
def first_at_stability(spark, sf_dir):
    """The first time of a topic as each run knows it; what comes in late may be older."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.expr("l_orderkey div 1000").alias("run"), F.col("l_shipdate").alias("at"))
    return series.first_at(items, day="run").select("id", "run", F.col("first_at").cast("date").cast("string").alias("first_at"), "stable")


#: Rows of a day's digest at most.
DIGEST = 60


@query(f"""WITH {_COVERED}, k AS (SELECT day, genre, count(coverage) AS covered FROM c GROUP BY day, genre),
s AS (SELECT *, row_number() OVER (PARTITION BY day, genre ORDER BY ts DESC, id) AS place FROM c WHERE coverage IS NULL),
f AS (SELECT id, day, genre, coverage, ts FROM c WHERE coverage IS NOT NULL UNION ALL SELECT s.id, s.day, s.genre, s.coverage, s.ts FROM s JOIN k USING (day, genre) WHERE place <= 5 - covered),
d AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY coalesce(coverage, 1) DESC, ts DESC, id) AS place FROM f QUALIFY place <= {DIGEST})
SELECT day, CAST(place AS INTEGER) AS place, CAST(id AS VARCHAR) AS id, genre AS category, CAST(coverage AS INTEGER) AS coverage, coverage IS NOT NULL AS has_key, CAST(count(*) OVER (PARTITION BY day) AS INTEGER) AS total FROM d""")
def digest_documents(spark, sf_dir):
    """Each day's digest as a document, at most DIGEST rows; an article that is alone has no key for its coverage, in the file too."""
    rows = ranking.digest(_covered(spark, sf_dir), DIGEST)
    item = F.struct(F.col("id").cast("string").alias("id"), F.col("genre").alias("category"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), F.col("coverage").cast("int").alias("coverage"))
    listed = F.array_sort(F.collect_list(F.struct("place", item.alias("item"))))
    days = rows.groupBy("day").agg(F.count(F.lit(1)).cast("int").alias("total"), F.transform(listed, lambda x: x["item"]).alias("items"))
    path = scratch_path(spark, "digests")
    documents.write_named(days.select(F.col("day").alias("file"), F.col("day").alias("date"), "total", "items"), path, "file")
    read = documents.read_days(spark, path, schemas.DIGEST).select(F.col("date").cast("string").alias("day"), "total", F.posexplode("items").alias("at", "item"))
    plain = spark.read.text(path, wholetext=True).select(F.from_json("value", "date string, items array<map<string,string>>").alias("d"))
    keys = plain.select(F.col("d.date").alias("day"), F.posexplode("d.items").alias("at", "m")).select("day", "at", F.map_contains_key("m", "coverage").alias("has_key"))
    return read.join(keys, ["day", "at"]).select("day", (F.col("at") + 1).alias("place"), "item.id", "item.category", "item.coverage", "has_key", "total")


@query(f"""WITH {_TOPICS}, l AS (SELECT day, id, peak, coverage, row_number() OVER (PARTITION BY day ORDER BY peak DESC, coverage DESC, id) AS rank FROM t QUALIFY rank <= {LISTED})
SELECT substr(day, 1, 7) AS month, day || '-' || id AS id, coverage || ' articles' AS summary, 'peak ' || peak || '|' || 'rank ' || rank AS points, split_part(id, '-', 1) || '|' || split_part(id, '-', 2) AS keywords, day AS background FROM l""")
def summary_documents(spark, sf_dir):
    """Summaries of the listed topics with their nested points and keywords, one array a month; a month has at most LISTED for each day."""
    top = ranking.top(_topics(spark, sf_dir), LISTED)
    said = lambda word, c: F.concat(F.lit(f"{word} "), F.col(c).cast("string"))
    summary = F.struct(F.concat_ws("-", "day", "id").alias("id"), F.concat(F.col("coverage").cast("string"), F.lit(" articles")).alias("summary"), F.array(said("peak", "peak"), said("rank", "rank")).alias("points"), F.col("day").alias("background"), F.split("id", "-").alias("keywords"))
    months = top.select(F.substring("day", 1, 7).alias("month"), summary.alias("s")).groupBy("month").agg(F.array_sort(F.collect_list("s")).alias("summaries"))
    path = scratch_path(spark, "summaries")
    documents.write_arrays(months, path, "month", "summaries")
    read = documents.read_months(spark, path, schemas.SUMMARY)
    return read.select("month", "id", "summary", F.array_join("points", "|").alias("points"), F.array_join("keywords", "|").alias("keywords"), "background")


@query(f"WITH {_A} SELECT day, CAST(count(*) AS INTEGER) AS articles, CAST(count(DISTINCT source) AS INTEGER) AS media, day || '.json' AS file, FALSE AS broken FROM a WHERE day BETWEEN '2024-01-09' AND '2024-01-11' GROUP BY day")
def day_range(spark, sf_dir):
    """The documents of three days out of all that there are; no other file is opened."""
    a = _articles(spark, sf_dir).select("day", "source")
    path = scratch_path(spark, "day_range")
    documents.write_named(daily.totals(a).select(F.col("day").alias("file"), F.col("day").alias("date"), "articles", "media"), path, "file")
    read = documents.read_between(spark, path, "2024-01-09", "2024-01-11")
    return read.select(F.col("date").cast("string").alias("day"), "articles", "media", "file", F.col("broken").isNotNull().alias("broken"))


@query(f"WITH {_A} SELECT day, count(*) AS articles, count(DISTINCT source) AS media, '2024-02-01 00:00:00' AS updated FROM a GROUP BY day")
def published_version(spark, sf_dir):
    """Daily totals that two runs publish, the newer one first: the older, which ends later, does not take its place."""
    a = _articles(spark, sf_dir).select("day", "source", "ts")
    path = scratch_path(spark, "published")
    documents.publish_version(daily.totals(a), path, dt.datetime(2024, 2, 1))
    documents.publish_version(daily.totals(a.where("ts < TIMESTAMP_NTZ '2024-01-20'")), path, dt.datetime(2024, 1, 20))
    return documents.read_version(spark, path).withColumn("updated", F.col("updated").cast("string"))


@query("""WITH old AS (SELECT o_custkey AS id, max(o_orderpriority) AS etag, count(*) AS count, 1 AS run FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
new AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS etag, max(o_orderkey) AS count, 2 AS run FROM orders WHERE o_orderkey % 2 = 1 AND o_orderdate >= TIMESTAMP '1997-06-01' GROUP BY 1)
SELECT coalesce(new.id, old.id) AS id, coalesce(new.etag, old.etag) AS etag, coalesce(new.count, old.count) AS count, coalesce(new.run, old.run) AS run FROM old FULL JOIN new ON old.id = new.id""")
def feed_table(spark, sf_dir):
    """Feed state in a table of buckets: a second run's replies, several of a feed among them, rewrite the buckets that they fall in."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    path = scratch_path(spark, "feed_table")
    first = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("etag"), F.count(F.lit(1)).alias("count"), F.lit(1).alias("run"))
    documents.upsert_table(spark, path, first, "id", buckets=64)
    replies = o.where("o_orderkey % 2 = 1 AND o_orderdate >= TIMESTAMP_NTZ '1997-06-01'")
    replies = replies.select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("etag"), F.col("o_orderkey").alias("count"), F.lit(2).alias("run"))
    documents.upsert_table(spark, path, replies, "id", order="count", buckets=64)
    return spark.read.schema("id long, etag string, count long, run int, bucket int").parquet(path).drop("bucket")
