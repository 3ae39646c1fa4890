"""Operators on small tables whose results are known."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import nested, text, time
from quillspark.operators import daily, ranking, series
from quillspark.sources import documents, schemas
from quillspark.streaming import daily as streaming


def test_civil_day_and_range_agree(spark):
    df = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01 14:59:58', timestamp_ntz'2024-01-02 15:00:01', interval 1 minute)) AS ts UNION ALL SELECT null")
    day = dt.date(2024, 1, 2)
    same = df.select((time.civil_day(F.col("ts")) == F.lit(day)).alias("a"), time.on_civil_day(F.col("ts"), day).alias("b"))
    assert same.where("NOT (a <=> b)").count() == 0
    assert same.where("a").count() == 1440


def test_until_and_month(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-31 15:00:00' AS t, date'2024-01-31' AS d").select(time.until(F.col("t") + F.expr("interval 2 days"), F.col("d")).alias("u"), time.month_key(F.col("t")).alias("m")).first()
    assert row.u == dt.datetime(2024, 1, 31, 15) and row.m == "2024-02"


def test_http_dates(spark):
    df = spark.createDataFrame([("Sat, 21 Nov 2026 18:04:45 GMT",), ("yesterday",), (None,)], "s string")
    assert [r.t for r in df.select(time.parse_rfc1123(F.col("s")).cast("timestamp_ntz").alias("t")).collect()] == [dt.datetime(2026, 11, 21, 18, 4, 45), None, None]


def test_excerpt(spark):
    df = spark.createDataFrame([("a" * 120,), ("b" * 121,), ("",), (None,)], "s string")
    assert [r.e for r in df.select(text.excerpt(F.col("s")).alias("e")).collect()] == ["a" * 120, "b" * 119 + "…", "", None]


@pytest.mark.parametrize(("url", "want"), [("https://u:p@Blog.Example.com:80/a?x=http://b", "blog.example.com"), ("/path", None), (None, None)])
def test_host(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(text.host(F.col("u"))).first()[0] == want


@pytest.mark.parametrize(("error", "want"), [("The operation timed out after 15 s", "timeout"), ("HTTP 503", "http-503"), ("Unclosed root tag", "xml"), ("not a feed", "feed"), ("?", "other"), (None, None)])
def test_error_class(spark, error, want):
    assert spark.createDataFrame([(error,)], "e string").select(text.error_class(F.col("e"))).first()[0] == want


def test_word_matches_respect_latin_borders(spark):
    df = spark.createDataFrame([(1, "MotoGP と GP"), (2, "MotoGP ブラジル戦"), (3, "ブラジル"), (4, None), (5, "")], "id int, text string")
    words = spark.createDataFrame([("GP",), ("ブラジル",), ("ブラジル戦",), ("と",), (None,)], "word string")
    got = {(r.id, r.word) for r in daily.match_words(df, words, keep=("id",)).collect()}
    want = {(1, "GP"), (2, "ブラジル"), (2, "ブラジル戦"), (3, "ブラジル")}
    assert got == want
    for literals, most in ((0, 100), (0, 1), (100, 2), (100, 1)):  # by automata, and in several scans
        found = daily.match_words(df, words, keep=("id",), literals=literals, most=most).collect()
        assert {(r.id, r.word) for r in found} == want and len(found) == len(want)
    assert daily.match_words(df, words.limit(0), keep=("id",)).count() == 0
    assert {(r.id, r.w) for r in df.crossJoin(words.where("length(word) > 1")).select("id", F.col("word").alias("w"), "text").collect() if r.text and (r.w in r.text and (r.id, r.w) != (2, "GP"))} == want


def test_word_order_uses_root_collation(spark):
    df = spark.createDataFrame([("b", 2), ("A", 2), ("a", 2), ("Z", 3), ("ä", 2)], "word string, articles long")
    assert [r.word for r in daily.word_order(df).collect()] == ["Z", "a", "A", "ä", "b"]


def test_rank_ties_go_by_id(spark):
    df = spark.createDataFrame([("d", "b", 5, 2), ("d", "a", 5, 2), ("d", "c", 5, 3), ("d", "z", 9, 1)], "day string, id string, peak int, coverage int")
    assert [r.id for r in ranking.top(df, 3).orderBy("rank").collect()] == ["z", "c", "a"]


def test_digest_places_are_those_of_one_window(spark):
    rows = [(i, f"d{i % 2}" if i % 17 else None, [None, 1, 2, 3][i % 4], f"2024-01-01 0{i % 3}:0{i % 5}:{i % 50:02d}" if i % 11 else None, "x") for i in range(200)]
    df = spark.createDataFrame([*rows, (500, "d0", None, None, "x"), (501, "d0", None, None, "x")], "id int, day string, coverage int, at string, _start string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = {(r.day, r.id): r.place for r in ranking.digest_order(df).collect()}
    want = {}
    for day in ("d0", "d1", None):
        mine = [r for r in df.collect() if r.day == day]
        mine.sort(key=lambda r: (-(r.coverage or 1), r.at is None, -(r.at.timestamp() if r.at else 0), r.id))
        want |= {(day, r.id): k + 1 for k, r in enumerate(mine)}
    assert got == want
    assert ranking.digest_order(df.limit(0)).count() == 0


def test_first_time_of_a_topic_moves_only_back(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), ("a", 2, 6), ("a", 3, 4), ("a", 4, 9), ("b", 2, None), ("b", 3, 1)], "id string, day int, at int")
    got = sorted((r.id, r.day, r.first_at, r.stable) for r in series.first_at(df).collect())
    assert got == [("a", 1, 5, True), ("a", 2, 5, True), ("a", 3, 4, False), ("a", 4, 4, True), ("b", 2, None, True), ("b", 3, 1, True)]


def test_files_are_named_by_day_and_month(spark, tmp_path):
    days = spark.sql("SELECT '2024-01-01' AS name, date'2024-01-01' AS date, 3 AS articles UNION ALL SELECT '2024-01-02', date'2024-01-02', 4")
    documents.write_named(days, str(tmp_path / "days"), "name")
    assert sorted(p.name for p in (tmp_path / "days").glob("*.json")) == ["2024-01-01.json", "2024-01-02.json"]
    assert sorted((str(r.date), r.articles) for r in documents.read_days(spark, str(tmp_path / "days")).collect()) == [("2024-01-01", 3), ("2024-01-02", 4)]
    months = spark.sql("SELECT '2024-01' AS name, array(named_struct('topic', 'a'), named_struct('topic', 'b')) AS notes UNION ALL SELECT '2024-02', array(named_struct('topic', 'c'))")
    documents.write_arrays(months, str(tmp_path / "months"), "name", "notes")
    assert sorted((r.month, r.topic) for r in documents.read_months(spark, str(tmp_path / "months"), schemas.NOTE).collect()) == [("2024-01", "a"), ("2024-01", "b"), ("2024-02", "c")]


def test_floor_fills_up_to_five(spark):
    rows = [("g", i, None, i) for i in range(10)] + [("g", 100, 3, 0)] + [("h", 200 + i, 2, i) for i in range(6)] + [("h", 300, None, 9)]
    df = spark.createDataFrame([("d", *r) for r in rows], "day string, genre string, id int, coverage int, at int")
    got = sorted(r.id for r in ranking.genre_floor(df).collect())
    assert got == [6, 7, 8, 9, 100, 200, 201, 202, 203, 204, 205]


def test_burst_looks_back_over_buckets(spark):
    at = [0, 5, 9, 10, 12, 30, 39, 40]
    df = spark.createDataFrame([("a", t) for t in at] + [("b", 3), ("b", 3)], "id string, at long")
    got = {r.id: r.burst for r in series.burst(df, 10).collect()}
    assert got == {"a": max(sum(1 for u in at if t - 10 < u <= t) for t in at), "b": 2}


def test_failure_runs_cross_days(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for key in range(30):
        bad = [rng.random() < rng.choice([0.2, 0.9]) for _ in range(rng.randint(1, 40))]
        rows += [(key, i, i // 4, b) for i, b in enumerate(bad)]
        runs, run = [0], 0
        for b in bad:
            run = run + 1 if b else 0
            runs.append(run)
        want[key] = (run, max(runs))
    df = spark.createDataFrame([(k, i, d, b, i) for k, i, d, b in rows], "id int, at int, day int, failed boolean, seq int")
    assert {r.id: (r.failures, r.longest) for r in series.failure_runs(df).collect()} == want


def test_upsert_keeps_what_a_reply_leaves_out(spark):
    schema = "sourceId string, etag string, okAt string, failures int"
    old = spark.createDataFrame([("a", "e1", "t1", 0), ("b", "e2", "t1", 3)], schema)
    new = spark.createDataFrame([("b", None, "t2", 0), ("c", "e3", None, 1)], schema)
    assert sorted(map(tuple, documents.upsert(old, new, "sourceId").collect())) == [("a", "e1", "t1", 0), ("b", "e2", "t2", 0), ("c", "e3", None, 1)]


def test_readers_and_invariants(spark, tmp_path):
    topic = {"id": "x1", "title": "t", "url": "u", "sourceId": "s", "category": "tech", "firstAt": "2024-01-02T01:00:00.000Z", "coverage": 2, "added": 2, "peak": 40, "burst": 1}
    day = {"date": "2024-01-02", "updatedAt": "2024-01-03T12:00:00.000Z", "until": "2024-01-02T15:00:00.000Z", "articles": 3, "media": 2, "topics": 1, "genres": {"tech": {"articles": 2, "topics": 1, "heat": 1.5}, "life": {"articles": 1, "topics": 0, "heat": 0}}, "words": {"word": {"articles": 2, "media": 1}}, "top": [topic]}
    (tmp_path / "trends").mkdir()
    (tmp_path / "trends/2024-01-02.json").write_text(json.dumps(day, indent=1))
    (tmp_path / "feeds.json").write_text(json.dumps({"s": {"failures": 0, "okAt": "2024-01-02T00:00:00.000Z", "count": 4}, "r": {"failures": 2, "error": "HTTP 500"}}))
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/2024-01.json").write_text(json.dumps([{"topic": "x1", "items": ["x3", "x1"], "common": [{"text": "c", "sources": ["x1", "x3"]}, {"text": "d", "sources": ["x1"]}]}]))
    trends = documents.read_days(spark, str(tmp_path / "trends"))
    sums = documents.genre_days(trends).groupBy("date").agg(F.sum("articles").alias("a"), F.sum("topics").alias("t"))
    row = trends.join(sums, "date").first()
    assert (row.articles, row.topics) == (row.a, row.t)
    checked = trends.select((F.col("until").cast("timestamp_ntz") == time.until(F.col("updatedAt").cast("timestamp_ntz"), F.col("date"))).alias("x")).first()
    assert checked.x
    assert [(r.rank, r.id, r.peak) for r in documents.topic_days(trends).collect()] == [(1, "x1", 40)]
    assert [(r.word, r.articles) for r in documents.word_days(trends).collect()] == [("word", 2)]
    assert {r.sourceId: r.failures for r in documents.read_map(spark, str(tmp_path / "feeds.json")).collect()} == {"s": 0, "r": 2}
    notes = documents.read_months(spark, str(tmp_path / "notes"), schemas.NOTE)
    note = notes.select("month", nested.last(F.col("items")).alias("last"), nested.all_sources(F.col("common")).alias("s"), nested.is_subset(nested.all_sources(F.col("common")), F.col("items")).alias("ok")).first()
    assert (note.month, note.last, note.s, note.ok) == ("2024-01", "x1", ["x1", "x3"], True)


def test_publish_rewrites_only_its_days(spark, tmp_path):
    path = str(tmp_path / "out")
    documents.publish(spark.createDataFrame([("d1", 1), ("d2", 2)], "date string, n int"), path)
    documents.publish(spark.createDataFrame([("d2", 5)], "date string, n int"), path)
    assert sorted((r.date, r.n) for r in spark.read.parquet(path).collect()) == [("d1", 1), ("d2", 5)]


def test_requests_latest_and_popularity(spark):
    log = spark.sql("SELECT 'a' AS id, 1 AS requestedAt")
    assert [r.id for r in documents.enqueue(log, spark.sql("SELECT 'b' AS id, 2 AS requestedAt")).collect()] == ["b", "a"]
    df = spark.createDataFrame([("k", 1), ("k", 2)], "key string, at int")
    assert documents.latest(df, "key", "at").first().at == 2
    popular = spark.sql("SELECT array(named_struct('id','a','n',1)) AS day, array(named_struct('id','a','n',3), named_struct('id','b','n',2)) AS week")
    assert sorted(map(tuple, documents.popularity(popular).collect())) == [("day", "a", 1), ("week", "a", 3), ("week", "b", 2)]


def test_stream_counts_like_the_table(spark, tmp_path):
    from tests.compare import DATA

    events = spark.read.parquet(f"{DATA}/events.parquet")
    source = tmp_path / "in"
    days = events.withColumn("d", F.dayofmonth("ts") % 3)
    for k in range(3):
        days.where(F.col("d") == k).drop("d").coalesce(1).write.mode("append").parquet(str(source))
    stream = streaming.daily_totals(streaming.event_stream(spark, str(source), events.schema), late="60 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {r.day: r.articles for r in daily.totals(events.select(time.civil_day(F.col("ts")).cast("string").alias("day"), F.col("user_id").alias("source"))).collect()}
    assert {r.day: r.articles for r in spark.table("totals").collect()} == want


def test_stream_writes_closed_days_and_goes_on(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, id, 0, 0, 0) AS ts, id AS user_id FROM range(6)")
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in (rows.where("user_id < 3"), rows.where("user_id >= 3")):
        part.coalesce(1).write.mode("append").parquet(source)
        streaming.write_available(streaming.daily_totals(streaming.event_stream(spark, source, rows.schema)), out, mark).awaitTermination()
    got = sorted((r.day, r.articles) for r in spark.read.schema("day string, articles long, media long").parquet(out).collect())
    assert got == [("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-03", 1)]


def test_exact_stream_counts_sources_of_closed_days(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").select("ts", "user_id")
    parts = [events.where("user_id % 2 = 0"), events.where("user_id % 2 = 1")]
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = streaming.exact_daily_totals(streaming.event_stream(spark, f"{tmp_path}/in/*", events.schema))
    streaming.write_available(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    days = {}
    for r in events.collect():
        day = str((r.ts + dt.timedelta(hours=9)).date())
        days.setdefault(day, []).append(r.user_id)
    want = sorted((d, len(u), len(set(u))) for d, u in days.items())
    assert got == want[: len(got)] and len(got) >= len(want) - 4


def test_upsert_takes_the_last_set_field_of_repeated_keys(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), (None, "n", 3)], "id string, etag string, at int")
    new = spark.createDataFrame([("a", "p", 5), ("a", None, 7), ("c", None, 6), ("c", "q", 4), (None, "z", 9)], "id string, etag string, at int")
    got = sorted(map(tuple, documents.upsert(old, new, "id", order="at").collect()), key=repr)
    assert got == sorted([("a", "p", 7), ("b", "y", 2), ("c", "q", 6), (None, "n", 3), (None, "z", 9)], key=repr)
