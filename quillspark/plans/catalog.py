"""Queries over the test tables, each with the SQL that gives the same rows.

Events stand for articles: ts for the time of publication, user_id for the
source, event_type for the genre, and (event_type, user_id) for a topic.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nested, text, time
from ..operators import daily, ranking, series
from ..operators.places import places
from ..sources import documents
from ..sources.scratch import written
from ..streaming import daily as streaming

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Vocabulary of the word queries.
WORDS = ["the", "that", "with", "from", "idiot", "trash", "license", "MIT", "Version", "der", "und", "que", "pour", "ción", "ß", "für"]
#: Words that stand inside each other, letters other than A-Z among them.
NESTED_WORDS = ["ión", "ción", "ación", "ó", "ßen", "eß", "être", "êt", "tion", "io", "für", "ür"]
BURST_SECONDS = 3600
DAY = dt.date(2024, 1, 15)


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as articles, with only the columns that a query goes on to use."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("source"), F.col("event_type").alias("genre"), "value", "props", time.civil_day(F.col("ts")).cast("string").alias("day"))


_A = "a AS (SELECT event_id AS id, ts, user_id AS source, event_type AS genre, value, props, CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day FROM events)"


def _second(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


# totals and genres


@query(f"WITH {_A} SELECT day, count(*) AS articles, count(DISTINCT source) AS media FROM a GROUP BY day")
def daily_totals(spark, sf_dir):
    return daily.totals(_articles(spark, sf_dir))


@query(f"WITH {_A} SELECT id, genre, source FROM a WHERE day = '{DAY}'")
def day_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(time.on_civil_day(F.col("ts"), DAY))
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("genre"), F.col("user_id").alias("source"))


@query(f"WITH {_A} SELECT day, genre, count(*) AS articles FROM a GROUP BY GROUPING SETS ((day, genre), (day))")
def genre_counts(spark, sf_dir):
    return daily.genre_rollup(_articles(spark, sf_dir))


@query(f"""WITH {_A}, p AS (SELECT day, genre, source, count(*) AS n FROM a GROUP BY ALL)
SELECT day, genre, CAST(sum(n) AS BIGINT) AS articles, count(*) FILTER (n >= 2) AS topics FROM p GROUP BY day, genre""")
def genre_topics(spark, sf_dir):
    return daily.genre_topics(_articles(spark, sf_dir), topic="source")


@query(f"""WITH {_A}, p AS (SELECT day, genre, source, count(*) AS n FROM a GROUP BY ALL HAVING count(*) >= 2)
SELECT day, genre, sum(n * 37)::BIGINT / 100.0::DOUBLE AS heat FROM p GROUP BY day, genre""")
def genre_heat(spark, sf_dir):
    """The score of a topic is a choice of this repository: 0.37 for each member."""
    topics = daily.topics(_articles(spark, sf_dir), ["day", "genre", "source"])
    return daily.heat(topics.withColumn("score", F.col("coverage") * F.lit(0.37)))


@query(f"""WITH {_A}, p AS (SELECT day, genre, count(*) AS n FROM a GROUP BY ALL)
SELECT day, string_agg(genre || '=' || n, ',' ORDER BY genre) AS counts FROM p GROUP BY day""")
def digest_counts(spark, sf_dir):
    counted = daily.count_map(_articles(spark, sf_dir), "genre")
    shown = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return counted.select("day", F.array_join(shown, ",").alias("counts"))


@query(f"""WITH {_A}, p AS (SELECT day, genre, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT day, count(*) AS total FROM a GROUP BY day)
SELECT t.day, total, CAST(sum(n) AS BIGINT) AS counted, total = sum(n) AS equal FROM t JOIN p USING (day) GROUP BY t.day, total""")
def digest_against_trend(spark, sf_dir):
    a = _articles(spark, sf_dir)
    genres = a.groupBy("day", "genre").agg(F.count(F.lit(1)).alias("n")).groupBy("day").agg(F.sum("n").alias("counted"))
    days = a.groupBy("day").agg(F.count(F.lit(1)).alias("total"))
    return days.join(genres, "day").select("day", "total", "counted", (F.col("total") == F.col("counted")).alias("equal"))


@query(f"WITH {_A} SELECT source, genre, count(id) AS coverage FROM a GROUP BY source, genre HAVING count(id) >= 2")
def topic_eligibility(spark, sf_dir):
    return daily.topics(_articles(spark, sf_dir), ["source", "genre"])


@query(f"WITH {_A}, p AS (SELECT day, source, count(*) AS n FROM a GROUP BY ALL) SELECT day, source, CASE WHEN n > 1 THEN n END AS coverage FROM p")
def optional_coverage(spark, sf_dir):
    counted = _articles(spark, sf_dir).groupBy("day", "source").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("day", "source", F.when(F.col("n") > 1, F.col("n")).alias("coverage"))


# ranks and digests

_TOPICS = f"""{_A},
h AS (SELECT day, source, genre, date_trunc('hour', ts) AS hour, count(*) AS n FROM a GROUP BY ALL),
t AS (SELECT day, genre || '-' || source AS id, CAST(max(n) AS BIGINT) AS peak, CAST(sum(n) AS BIGINT) AS coverage FROM h GROUP BY day, source, genre)"""


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _articles(spark, sf_dir).groupBy("day", "source", "genre", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.groupBy("day", "source", "genre").agg(F.max("n").alias("peak"), F.sum("n").alias("coverage")).select("day", F.concat_ws("-", "genre", F.col("source").cast("string")).alias("id"), "peak", "coverage")


@query(f"WITH {_TOPICS} SELECT day, id, peak, coverage, row_number() OVER (PARTITION BY day ORDER BY peak DESC, coverage DESC, id) AS rank FROM t QUALIFY rank <= 15")
def top_per_day(spark, sf_dir):
    return ranking.top(_topics(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_TOPICS} SELECT day, id, peak FROM t WHERE peak >= 2")
def peak_score(spark, sf_dir):
    """The score behind a peak is a choice of this repository: members in one hour."""
    return _topics(spark, sf_dir).where(F.col("peak") >= 2).select("day", "id", "peak")


_COVERED = f"""{_A}, c AS (SELECT id, day, genre, source, ts, CASE WHEN count(*) OVER (PARTITION BY day, genre, source) > 1 THEN count(*) OVER (PARTITION BY day, genre, source) END AS coverage FROM a)"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with the coverage of their topic, written once for all that a digest asks of them."""
    a = _articles(spark, sf_dir)
    n = daily.topics(a, ["day", "genre", "source"])
    return written(a.select("id", "day", "genre", "source", F.col("ts").alias("at")).join(n, ["day", "genre", "source"], "left"), "covered")


@query(f"WITH {_COVERED} SELECT id, day, row_number() OVER (PARTITION BY day ORDER BY coalesce(coverage, 1) DESC, ts DESC, id) AS place FROM c")
def digest_order(spark, sf_dir):
    return ranking.digest_order(_covered(spark, sf_dir)).select("id", "day", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_COVERED}, k AS (SELECT day, genre, count(coverage) AS covered FROM c GROUP BY day, genre),
s AS (SELECT *, row_number() OVER (PARTITION BY day, genre ORDER BY ts DESC, id) AS place FROM c WHERE coverage IS NULL)
SELECT id, day, genre, coverage FROM c WHERE coverage IS NOT NULL
UNION ALL SELECT s.id, s.day, s.genre, s.coverage FROM s JOIN k USING (day, genre) WHERE place <= 5 - covered""")
def genre_floor(spark, sf_dir):
    return ranking.genre_floor(_covered(spark, sf_dir)).select("id", "day", "genre", "coverage")


@query(f"""WITH {_COVERED}, k AS (SELECT day, genre, count(coverage) AS covered FROM c GROUP BY day, genre),
s AS (SELECT *, row_number() OVER (PARTITION BY day, genre ORDER BY ts DESC, id) AS place FROM c WHERE coverage IS NULL),
f AS (SELECT id, day, coverage, ts FROM c WHERE coverage IS NOT NULL UNION ALL SELECT s.id, s.day, s.coverage, s.ts FROM s JOIN k USING (day, genre) WHERE place <= 5 - covered)
SELECT id, day, row_number() OVER (PARTITION BY day ORDER BY coalesce(coverage, 1) DESC, ts DESC, id) AS place FROM f QUALIFY place <= 60""")
def digest_rows(spark, sf_dir):
    return ranking.digest(_covered(spark, sf_dir), 60).select("id", "day", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_TOPICS}, l AS (SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY peak DESC, coverage DESC, id) AS rank FROM t QUALIFY rank <= 15),
b AS (SELECT DISTINCT day, id FROM (SELECT day, id FROM l UNION ALL SELECT CAST(CAST(day AS DATE) + 1 AS VARCHAR), id FROM l))
SELECT t.day, t.id, row_number() OVER (PARTITION BY t.day ORDER BY peak DESC, coverage DESC, t.id) AS rank FROM t JOIN b USING (day, id)""")
def top_with_kept(spark, sf_dir):
    """Each day's list with those of the day before's that are topics again."""
    t = _topics(spark, sf_dir)
    before = ranking.top(t).select(F.date_add(F.col("day").cast("date"), 1).cast("string").alias("day"), "id")
    return ranking.top_with_kept(t, before).select("day", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_A}, n AS (SELECT source AS id, count(*) AS n FROM a GROUP BY source)
SELECT id, n, row_number() OVER (ORDER BY n DESC, id) AS place FROM n""")
def popular_order(spark, sf_dir):
    """Every id with its place by count, by ranges."""
    n = _articles(spark, sf_dir).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return places(n, [F.desc("n"), F.asc("id")])


@query(f"WITH {_A} SELECT source AS id, count(*) AS n FROM a GROUP BY source ORDER BY n DESC, id")
def popular_order_all(spark, sf_dir):
    """Every id in the order of popular_order, by a range sort."""
    return _articles(spark, sf_dir).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id")


# days, bursts and runs


@query(f"""WITH {_A}, d AS (SELECT source, day, count(*) AS added FROM a GROUP BY ALL)
SELECT source, day, added, CAST(sum(added) OVER w AS BIGINT) AS coverage, row_number() OVER w = 1 AS is_first FROM d WINDOW w AS (PARTITION BY source ORDER BY day)""")
def cumulative_coverage(spark, sf_dir):
    return series.coverage(_articles(spark, sf_dir), key="source")


@query(f"""WITH {_A}, d AS (SELECT source, day, count(*) AS added FROM a GROUP BY ALL),
c AS (SELECT source, day, added, CAST(sum(added) OVER w AS BIGINT) AS coverage FROM d WINDOW w AS (PARTITION BY source ORDER BY day))
SELECT source, day, coverage, lag(day) OVER w AS day_before, lag(coverage) OVER w AS coverage_before, coverage = coalesce(lag(coverage) OVER w, 0) + added AS holds
FROM c WINDOW w AS (PARTITION BY source ORDER BY day)""")
def coverage_steps(spark, sf_dir):
    return series.coverage_steps(series.coverage(_articles(spark, sf_dir), key="source"), key="source").select("source", "day", "coverage", "day_before", "coverage_before", "holds")


@query(f"""WITH {_A}, f AS (SELECT genre, source, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM a GROUP BY ALL)
SELECT genre, source, CAST(first_at AS VARCHAR) AS first_at, n, CAST(floor(epoch(last_at) - epoch(first_at)) AS BIGINT) // 86400 AS age_days FROM f""")
def topic_age(spark, sf_dir):
    f = _articles(spark, sf_dir).groupBy("genre", "source").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n"))
    age = F.floor((F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 1_000_000 / 86400)
    return f.select("genre", "source", F.col("first_at").cast("string").alias("first_at"), "n", age.cast("long").alias("age_days"))


@query(f"""WITH {_A}, s AS (SELECT source, day, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM a),
n AS (SELECT source, day, count(*) OVER (PARTITION BY source ORDER BY sec RANGE BETWEEN {BURST_SECONDS - 1} PRECEDING AND CURRENT ROW) AS n FROM s)
SELECT source, day, max(n) AS burst FROM n GROUP BY source, day""")
def burst_max(spark, sf_dir):
    """The length of a burst's window is a choice of this repository: one hour."""
    a = _articles(spark, sf_dir).select("source", "day", _second(F.col("ts")).alias("at"))
    return series.burst(a, BURST_SECONDS, key="source", by=("day",))


@query(f"""WITH {_A}, u AS (SELECT day, max(ts) AS updated, CAST(day AS DATE) + INTERVAL 15 HOUR AS ends FROM a GROUP BY day)
SELECT day, CAST(least(updated, ends) AS VARCHAR) AS until, updated < ends AS is_open FROM u""")
def until_clamp(spark, sf_dir):
    u = _articles(spark, sf_dir).groupBy("day").agg(F.max("ts").alias("updated"))
    day = F.col("day").cast("date")
    return u.select("day", time.until(F.col("updated"), day).cast("string").alias("until"), (F.col("updated") < time.day_end(day)).alias("is_open"))


@query("""WITH l AS (SELECT o_orderkey, l_linenumber, o_orderdate, l_shipdate, l_shipdate <= o_orderdate + INTERVAL 1 DAY + INTERVAL 48 HOUR AS in_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT in_time, count(*) AS n FROM l GROUP BY in_time""")
def late_cutoff(spark, sf_dir):
    """Rows that come within 48 hours of a day's end, and later ones."""
    orders, items = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    in_time = F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 1 DAY") + F.expr("INTERVAL 48 HOURS")
    return rows.groupBy(in_time.alias("in_time")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, island, CAST(sum(bad::INT) AS BIGINT) AS run FROM m GROUP BY ALL)
SELECT user_id, arg_max(run, island) AS failures, max(run) AS longest FROM r GROUP BY user_id""")
def failure_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"), F.to_date("ts").alias("day"))
    return series.failure_runs(e, key="user_id", at="ts", order="event_id")


_HEALTH = """h AS (SELECT user_id, count(*) AS checks, max(ts) FILTER (event_type <> 'error') AS ok_at, max(ts) FILTER (event_type = 'error') AS failed_at FROM events GROUP BY user_id)"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.health(table(spark, sf_dir, "events").select("user_id", "ts", (F.col("event_type") == "error").alias("failed")), key="user_id", at="ts")


@query(f"WITH {_HEALTH} SELECT user_id, checks, CAST(ok_at AS VARCHAR) AS ok_at, CAST(failed_at AS VARCHAR) AS failed_at, coalesce(ok_at > failed_at, failed_at IS NULL) AS healthy FROM h")
def feed_health(spark, sf_dir):
    return _health(spark, sf_dir).select("user_id", "checks", F.col("ok_at").cast("string").alias("ok_at"), F.col("failed_at").cast("string").alias("failed_at"), "healthy")


@query(f"WITH {_HEALTH} SELECT count(*) AS sources, count(*) FILTER (NOT coalesce(ok_at > failed_at, failed_at IS NULL)) AS failing, CAST(sum(checks) AS BIGINT) AS checks FROM h")
def feed_rollup(spark, sf_dir):
    return _health(spark, sf_dir).agg(F.count(F.lit(1)).alias("sources"), F.count_if(~F.col("healthy")).alias("failing"), F.sum("checks").alias("checks"))


@query("""WITH e AS (SELECT user_id, event_type = 'error' AS bad, ts FROM events)
SELECT user_id, CAST(max(ts) AS VARCHAR) AS checked_at, CAST(max(ts) FILTER (NOT bad) AS VARCHAR) AS body_at, max(ts) > max(ts) FILTER (NOT bad) AS check_is_later FROM e GROUP BY user_id""")
def check_and_body_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("event_type") != "error", F.col("ts")).alias("body"))
    g = e.groupBy("user_id").agg(F.max("ts").alias("a"), F.max("body").alias("b"))
    return g.select("user_id", F.col("a").cast("string").alias("checked_at"), F.col("b").cast("string").alias("body_at"), (F.col("a") > F.col("b")).alias("check_is_later"))


@query("""WITH e AS (SELECT user_id AS id, ts FROM events), l AS (SELECT max(ts) AS last FROM events),
w AS (SELECT 'day' AS "window", id FROM e, l WHERE ts > last - INTERVAL 1 DAY UNION ALL SELECT 'week', id FROM e, l WHERE ts > last - INTERVAL 7 DAY)
SELECT "window", id, count(*) AS n FROM w GROUP BY ALL""")
def popular_day_week(spark, sf_dir):
    """One scan: a row counts in every window that holds it; the last instant is a single row."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts")
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("last"))), F.lit(True))
    in_day = F.when(F.col("ts") > F.col("last") - F.expr("INTERVAL 1 DAY"), F.lit("day"))
    in_week = F.when(F.col("ts") > F.col("last") - F.expr("INTERVAL 7 DAYS"), F.lit("week"))
    return e.select("id", F.explode(F.array_compact(F.array(in_day, in_week))).alias("window")).groupBy("window", "id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT user_id AS id, ts FROM events), l AS (SELECT max(ts) AS last FROM events)
SELECT DISTINCT id FROM e, l WHERE ts > last - INTERVAL 7 DAY AND id NOT IN (SELECT id FROM e, l WHERE ts > last - INTERVAL 1 DAY)""")
def week_only(spark, sf_dir):
    """The week's ids without the day's."""
    p = popular_day_week(spark, sf_dir)
    return p.groupBy("id").agg(F.max((F.col("window") == "day").cast("int")).alias("today")).where("today = 0").select("id")


# words and text


@query(f"""WITH v AS (SELECT unnest({WORDS!r}) AS word),
m AS (SELECT word, source FROM documents, v WHERE CASE WHEN regexp_matches(word, '^[A-Za-z]+$') THEN regexp_matches(text, '(^|[^A-Za-z])' || word || '([^A-Za-z]|$)') ELSE contains(text, word) END AND length(word) >= 2)
SELECT word, count(*) AS articles, count(DISTINCT source) AS media FROM m GROUP BY word HAVING count(*) >= 2""")
def word_counts(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return daily.word_counts(daily.match_words(table(spark, sf_dir, "documents").select("text", "source"), words, keep=("source",)))


@query(f"""WITH v AS (SELECT unnest({NESTED_WORDS!r}) AS word)
SELECT doc_id, word FROM documents, v WHERE CASE WHEN regexp_matches(word, '^[A-Za-z]+$') THEN regexp_matches(text, '(^|[^A-Za-z])' || word || '([^A-Za-z]|$)') ELSE contains(text, word) END AND length(word) >= 2""")
def nested_words(spark, sf_dir):
    """Documents with words that stand inside one another; each counts for itself. By one pass of an automaton."""
    words = spark.createDataFrame([(w,) for w in NESTED_WORDS], "word string")
    return daily.match_words(table(spark, sf_dir, "documents").select("doc_id", "text"), words, keep=("doc_id",), literals=0)


@query(r"""WITH w AS (SELECT DISTINCT doc_id, source, unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS word FROM documents),
c AS (SELECT source, word, count(*) AS articles FROM w WHERE word <> '' GROUP BY ALL HAVING count(*) >= 2)
SELECT source, word, articles, row_number() OVER (PARTITION BY source ORDER BY articles DESC, icu_sort_key(word, 'root')) AS place FROM c""")
def collated_words(spark, sf_dir):
    """Place of each word of a source by count and root collation: mixed case, accents and ß. By ranges, so a source's vocabulary is spread."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    w = d.select("source", F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+"))).alias("word")).where("word <> ''")
    c = w.groupBy("source", "word").agg(F.count(F.lit(1)).alias("articles")).where(F.col("articles") >= daily.LEAST)
    return places(c, [F.desc("articles"), F.expr("word COLLATE UNICODE"), F.col("word")], ["source"])


@query("""WITH w AS (SELECT lower(event_type) AS word, count(*) AS articles FROM events GROUP BY 1)
SELECT word, articles, row_number() OVER (ORDER BY articles DESC, word) AS place FROM w""")
def word_order(spark, sf_dir):
    """Place of each word by count and root collation, by ranges."""
    w = table(spark, sf_dir, "events").groupBy(F.lower("event_type").alias("word")).agg(F.count(F.lit(1)).alias("articles"))
    return places(w, [F.desc("articles"), F.expr("word COLLATE UNICODE"), F.col("word")])


@query(f"""WITH {_A}, d AS (SELECT json_extract_string(props, '$.k') AS word, day, count(*) AS n FROM a GROUP BY ALL HAVING count(*) >= 2),
f AS (SELECT word, min(day) AS first_day FROM d WHERE word IS NOT NULL GROUP BY word), n AS (SELECT first_day AS day, count(*) AS added FROM f GROUP BY 1)
SELECT day, added, CAST(sum(added) OVER (ORDER BY day) AS BIGINT) AS words FROM n""")
def vocabulary_growth(spark, sf_dir):
    """Words by the day they came in, and how many there are then; the window is over days."""
    a = _articles(spark, sf_dir).select("day", F.get_json_object("props", "$.k").alias("word")).where("word IS NOT NULL")
    days = daily.new_words(a).groupBy(F.col("first_day").alias("day")).agg(F.count(F.lit(1)).alias("added"))
    return days.withColumn("words", F.sum("added").over(Window.orderBy("day")))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 119) || '…' ELSE text END AS excerpt FROM documents")
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT page_id, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host FROM pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"))


@query("SELECT page_id, substr(sha256(url), 1, 16) AS id FROM pages")
def url_id(spark, sf_dir):
    """An id of 16 hex characters of a URL."""
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.sha2("url", 256), 1, 16).alias("id"))


@query("SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY ALL")
def month_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(time.month_key(F.col("ts")).alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(strptime(strftime(o_orderdate, '%d %b %Y %H:%M:%S'), '%d %b %Y %H:%M:%S') AS VARCHAR) AS at, count(*) AS n FROM orders GROUP BY 1")
def http_dates(spark, sf_dir):
    """Order dates written as HTTP dates and read again."""
    written = F.concat(F.lit("Mon, "), F.date_format(F.col("o_orderdate").cast("timestamp"), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    at = F.date_format(time.parse_rfc1123(written), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'request timed out after 15 s' WHEN '2-HIGH' THEN 'HTTP 404' WHEN '3-MEDIUM' THEN 'Unclosed root tag' WHEN '5-LOW' THEN 'not recognised as a feed' END AS error FROM orders),
c AS (SELECT CASE error WHEN 'request timed out after 15 s' THEN 'timeout' WHEN 'HTTP 404' THEN 'http-404' WHEN 'Unclosed root tag' THEN 'xml' WHEN 'not recognised as a feed' THEN 'feed' END AS class FROM e)
SELECT class, count(*) AS n FROM c GROUP BY class""")
def error_classes(spark, sf_dir):
    p = F.col("o_orderpriority")
    error = F.when(p == "1-URGENT", "request timed out after 15 s").when(p == "2-HIGH", "HTTP 404").when(p == "3-MEDIUM", "Unclosed root tag").when(p == "5-LOW", "not recognised as a feed")
    return table(spark, sf_dir, "orders").groupBy(text.error_class(error).alias("class")).agg(F.count(F.lit(1)).alias("n"))


# nested values


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY ALL")
def map_round_trip(spark, sf_dir):
    """Rows to a map of counts for each type, and back to rows."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").where("props IS NOT NULL").select(F.col("event_type").alias("day"), k.alias("k"))
    return nested.map_rows(daily.count_map(e, "k"), "counts", "k", "n").select(F.col("day").alias("event_type"), "k", "n")


@query("""SELECT conv_id, arg_max(text, turn) AS last_text, count(*) AS turns, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id""")
def last_turn(spark, sf_dir):
    """Conversations by their last turn, how many turns there are and the distinct roles; whole texts are not gathered."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "role", "text")).alias("last_text"), F.count(F.lit(1)).alias("turns"), F.collect_set("role").alias("roles"))
    return c.select("conv_id", "last_text", "turns", F.array_join(F.array_sort("roles"), ",").alias("roles"))


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS claimed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), i AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS items FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(claimed) AS claimed, len(items) AS items, list_has_all(items, claimed) AS subset FROM s JOIN i USING (l_orderkey)""")
def sources_subset(spark, sf_dir):
    """Whether the sources named in part of a note are among all of its items; one aggregation gives both sets."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("c"), F.collect_set("l_suppkey").alias("i"))
    return items.where(F.size("c") > 0).select("l_orderkey", F.size("c").cast("long").alias("claimed"), F.size("i").cast("long").alias("items"), nested.is_subset(F.col("c"), F.col("i")).alias("subset"))


# joins


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def feed_join(spark, sf_dir):
    """A table with its small reference tables; their sizes decide whether they are broadcast."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select("s_suppkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def silent_feeds(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT c_custkey, n, first_at FROM (SELECT c_custkey, count(o_orderkey) AS n, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_at
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-07-01' GROUP BY 1)""")
def feeds_of_a_term(spark, sf_dir):
    """Feeds with their articles of half a year: some have none, some have several."""
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01' AND o_orderdate < TIMESTAMP_NTZ '1995-07-01'")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").cast("date").cast("string").alias("first_at"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "first_at")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01')""")
def silent_of_a_year(spark, sf_dir):
    """Feeds without an article in the year; the filter on the date reaches the scan."""
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01' AND o_orderdate < TIMESTAMP_NTZ '1996-01-01'").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS claimed, list(DISTINCT l_suppkey) FILTER (l_linenumber <= 2) AS items FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(claimed) AS claimed, coalesce(len(items), 0) AS items, list_has_all(coalesce(items, []), claimed) AS subset FROM s WHERE claimed IS NOT NULL""")
def claimed_sources(spark, sf_dir):
    """Whether the sources that a note claims are among its items, where they often are not."""
    pick = lambda when: F.collect_set(F.when(F.expr(when), F.col("l_suppkey")))
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(pick("l_returnflag = 'R'").alias("c"), pick("l_linenumber <= 2").alias("i"))
    return s.where(F.size("c") > 0).select("l_orderkey", F.size("c").cast("long").alias("claimed"), F.size("i").cast("long").alias("items"), nested.is_subset(F.col("c"), F.col("i")).alias("subset"))


@query(f"""WITH {_A}, t AS (SELECT day, count(*) AS trend, count(DISTINCT source) AS media FROM a WHERE genre <> 'error' GROUP BY 1),
d AS (SELECT day, count(*) AS digest FROM a WHERE value > 50 GROUP BY 1 HAVING count(*) % 3 > 0)
SELECT day, coalesce(digest, 0) AS digest, coalesce(trend, 0) AS trend, coalesce(trend, 0) - coalesce(digest, 0) AS missing FROM t FULL JOIN d USING (day)""")
def digest_trend_gap(spark, sf_dir):
    """Totals of a digest that leaves articles and days out, beside the trend's."""
    a = _articles(spark, sf_dir).select("day", "genre", "value", "source")
    t = a.where("genre <> 'error'").groupBy("day").agg(F.count(F.lit(1)).alias("trend"))
    d = a.where("value > 50").groupBy("day").agg(F.count(F.lit(1)).alias("digest")).where("digest % 3 > 0")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return t.join(d, "day", "full_outer").select("day", zero("digest").alias("digest"), zero("trend").alias("trend"), (zero("trend") - zero("digest")).alias("missing"))


@query(f"""WITH {_A}, t AS (SELECT day, genre || '-' || source AS id, count(*) AS coverage FROM a GROUP BY ALL HAVING count(*) >= 2),
d AS (SELECT day, genre || '-' || source AS id, count(*) AS members FROM a WHERE hour(ts) < 12 GROUP BY ALL)
SELECT day, id, coverage, members, coverage - members AS difference FROM t FULL JOIN d USING (day, id)""")
def digest_trend_difference(spark, sf_dir):
    """A day's topics beside the same ids of a digest made at noon: on both sides, with more or fewer members, or on one side alone."""
    a = _articles(spark, sf_dir).select("day", F.concat_ws("-", "genre", F.col("source").cast("string")).alias("id"), "ts")
    t = a.groupBy("day", "id").agg(F.count(F.lit(1)).alias("coverage")).where(F.col("coverage") >= daily.LEAST)
    d = a.where(F.hour("ts") < 12).groupBy("day", "id").agg(F.count(F.lit(1)).alias("members"))
    return t.join(d, ["day", "id"], "full_outer").withColumn("difference", F.col("coverage") - F.col("members"))


@query("""WITH p AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1)
SELECT id, n, c_name AS title, c_custkey IS NOT NULL AS found FROM p LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) ON c_custkey = id""")
def popular_titles(spark, sf_dir):
    """Counted ids with their article's title; articles of other segments are no longer there."""
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", F.col("c_name").alias("title"))
    return p.join(c, F.col("c_custkey") == F.col("id"), "left").select("id", "n", "title", F.col("c_custkey").isNotNull().alias("found"))


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
old AS (SELECT o_custkey AS id, max(o_orderpriority) AS etag, count(*) AS count FROM o WHERE o_orderkey % 2 = 0 GROUP BY 1),
new AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS etag, arg_max(o_orderkey, o_orderkey) AS count FROM o WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(new.id, old.id) AS id, coalesce(new.etag, old.etag) AS etag, coalesce(new.count, old.count) AS count FROM old FULL JOIN new ON old.id = new.id""")
def upsert_state(spark, sf_dir):
    """Feed state with later replies, several of a feed among them; a reply without validator leaves the old one."""
    o = table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP_NTZ '1998-01-01'")
    old = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("etag"), F.count(F.lit(1)).alias("count"))
    new = o.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("etag"), F.col("o_orderkey").alias("count"))
    return documents.upsert(old, new, "id", order="count")


@query("""SELECT c_custkey AS id, o_orderkey AS request, CAST(o_orderdate AS VARCHAR) AS at FROM customer JOIN orders ON c_custkey = o_custkey
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_request(spark, sf_dir):
    """The newest request of each id."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("request"), F.struct("o_orderdate", "o_orderkey").alias("order"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    best = documents.latest(o, "id", "order").join(known, "id", "left_semi")
    return best.select("id", "request", F.date_format("order.o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""WITH n AS (SELECT l_orderkey AS topic, l_returnflag AS text, l_suppkey AS source FROM lineitem)
SELECT topic, count(DISTINCT text) AS claims, count(DISTINCT source) AS sources, string_agg(DISTINCT CAST(source AS VARCHAR), ',' ORDER BY CAST(source AS VARCHAR)) AS named FROM n GROUP BY topic""")
def note_sources(spark, sf_dir):
    """Notes with nested claims, common[].sources[], and all sources that they name."""
    source = F.col("l_suppkey").cast("string").alias("source")
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("topic"), F.col("l_returnflag").alias("text"), source).groupBy("topic", "text").agg(F.collect_set("source").alias("sources"))
    notes = claims.groupBy("topic").agg(F.collect_list(F.struct("text", "sources")).alias("common"))
    named = nested.all_sources(F.col("common"))
    return notes.select("topic", F.size("common").cast("long").alias("claims"), F.size(named).cast("long").alias("sources"), F.array_join(named, ",").alias("named"))


@query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def doc_labels(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query(f"""WITH {_A}, t AS (SELECT genre, source, day, count(*) AS n, min(ts) AS first_at FROM a GROUP BY ALL HAVING count(*) >= 2)
SELECT a.id, t.n, a.ts = t.first_at AS is_first FROM a LEFT JOIN t USING (genre, source, day)""")
def note_join(spark, sf_dir):
    """Articles with the topic they belong to, where there is one."""
    a = _articles(spark, sf_dir).select("id", "genre", "source", "day", "ts")
    t = a.groupBy("genre", "source", "day").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at")).where("n >= 2")
    return a.join(t, ["genre", "source", "day"], "left").select("id", "n", (F.col("ts") == F.col("first_at")).alias("is_first"))


@query(f"""WITH {_TOPICS}, l AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY peak DESC, coverage DESC, id) AS rank FROM t QUALIFY rank <= 15),
d AS (SELECT day, genre || '-' || source AS id, count(*) AS members FROM a GROUP BY ALL)
SELECT l.day, l.id, l.coverage, d.members, l.coverage - d.members AS difference FROM l JOIN d USING (day, id)""")
def digest_trend_same_id(spark, sf_dir):
    """A day's listed topics next to the digest's count of the same topic."""
    members = _articles(spark, sf_dir).groupBy("day", F.concat_ws("-", "genre", F.col("source").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("members"))
    listed = ranking.top(_topics(spark, sf_dir)).select("day", "id", "coverage")
    return listed.join(members, ["day", "id"]).withColumn("difference", F.col("coverage") - F.col("members"))


@query("""WITH p AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1)
SELECT id, n, c_name AS title, c_custkey IS NOT NULL AS found FROM p LEFT JOIN customer ON c_custkey = id + 1000000000""")
def popular_articles(spark, sf_dir):
    """Counted ids with their article, where there is one; the shift makes it a join that matches nothing."""
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("title"))
    return p.join(c, F.col("c_custkey") == F.col("id") + F.lit(1_000_000_000), "left").select("id", "n", "title", F.col("c_custkey").isNotNull().alias("found"))


@query(f"""WITH {_A}, d AS (SELECT source, CAST(day AS DATE) AS day, count(*) AS n FROM a GROUP BY ALL)
SELECT x.source, CAST(x.day AS VARCHAR) AS day, x.n AS n, y.n AS n_before FROM d x JOIN d y ON x.source = y.source AND y.day = x.day - 1""")
def day_self_join(spark, sf_dir):
    """Each day with the day before it, by one window instead of a join of two scans."""
    d = _articles(spark, sf_dir).groupBy("source", F.col("day").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    past = Window.partitionBy("source").orderBy("day")
    d = d.withColumn("n_before", F.lag("n").over(past)).withColumn("before", F.lag("day").over(past))
    return d.where(F.col("before") == F.date_sub("day", 1)).select("source", F.col("day").cast("string").alias("day"), "n", "n_before")


@query("""WITH g AS (SELECT lower(trim(split_part(text, chr(10), 1))) AS title, count(*) AS coverage, min(doc_id) AS topic, count(DISTINCT source) AS media FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT topic, coverage, media FROM g WHERE coverage >= 2 AND title <> ''""")
def title_topics(spark, sf_dir):
    """Documents under one title as topics of two members or more. How the source data groups texts is unknown; this is a choice of this repository."""
    title = F.lower(F.trim(F.split_part("text", F.lit("\n"), F.lit(1))))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", title.alias("title"))
    g = d.where("title <> ''").groupBy("title").agg(F.count(F.lit(1)).alias("coverage"), F.min("doc_id").alias("topic"), F.count_distinct("source").alias("media"))
    return g.where(F.col("coverage") >= daily.LEAST).select("topic", "coverage", "media")


@query(f"WITH {_A} SELECT day, CAST(count(*) AS BIGINT) AS articles, count(DISTINCT source) AS media FROM a GROUP BY day")
def streaming_exact_totals(spark, sf_dir):
    """The exact streaming plan over the table; the stream itself is in the tests."""
    return streaming.exact_daily_totals(table(spark, sf_dir, "events"))


@query()
def streaming_totals(spark, sf_dir):
    """The streaming plan over the table; the stream itself is in the tests."""
    return streaming.daily_totals(table(spark, sf_dir, "events"))
