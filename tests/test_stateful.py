"""Orders, components, similar titles, and what is kept between runs, against plain Python."""

import datetime as dt
import json
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph, places, rolling, series, similar
from quillspark.plans import published
from quillspark.sources import documents, schemas
from quillspark.streaming import feeds, refresh


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files_of(path):
    """Data files below a local path with the times of their last change."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


# places


def test_places_of_groups_with_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), rng.choice([None, 1, 1, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, n int, id int").repartition(5)
    got = places.places(df, [F.desc("n"), F.asc("id")], ["g"])
    assert got.columns == ["g", "n", "id", "place"] and got.schema["place"].dataType.typeName() == "long"
    want = []
    for g in (None, "a", "b"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[1] or -1), r[2]))
        want += [(*r, k) for k, r in enumerate(mine, 1)]
    assert rows_of(got) == sorted(want, key=repr)
    assert places.places(df.limit(0), [F.col("id")]).count() == 0


def test_places_of_one_group_of_equal_rows_are_spread(spark):
    df = spark.range(20_000).select(F.lit("x").alias("g"), F.lit(1).alias("n"))
    got = places.places(df, [F.desc("n")], ["g"])
    assert sorted(r.place for r in got.select("place").collect()) == list(range(1, 20_001))
    ranged = df.withColumn("t", F.monotonically_increasing_id()).repartitionByRange(8, "g", F.desc("n"), "t")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 20_000 / 4


# components


def _components(links):
    least = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            least.setdefault(a, a), least.setdefault(b, b)
    while True:
        low = dict(least)
        for a, b in links:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
        if low == least:
            return sorted(least.items())
        least = low


@pytest.mark.parametrize("kind", ["chain", "hub", "random", "odd"])
def test_components(spark, kind):
    rng = random.Random(3)
    links = {
        "chain": [(i, i + 1) for i in range(150)],
        "hub": [(10**6, i) for i in range(2000)] + [(2000 + i, 2001 + i) for i in range(0, 40, 2)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
        "odd": [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (5, 4), (7, 6)],
    }[kind]
    df = spark.createDataFrame(links, "a long, b long")
    assert rows_of(graph.components(df)) == sorted(_components(links), key=repr)
    assert graph.components(df.limit(0)).count() == 0


def test_joined_components_walk_no_known_chain_again(spark, monkeypatch):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(400)]
    more = [(rng.randrange(600), rng.randrange(600)) for _ in range(60)] + [(7, 7), (None, 3), (900, 900)]
    known = graph.components(spark.createDataFrame(chain, "a long, b long")).persist()
    assert known.count() == 401
    writes, before = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: writes.append(before(df, name)) or writes[-1])
    got = graph.joined_components(known, spark.createDataFrame(more, "a long, b long"))
    assert rows_of(got) == sorted(_components(chain + more), key=repr)
    assert max(w.count() for w in writes) < 400  # links of the chain are in none
    writes.clear()
    assert rows_of(graph.joined_components(known, spark.createDataFrame(chain, "a long, b long"))) == rows_of(known)
    known.unpersist()


# similar titles


def _topics(rows, percent, life):
    links = []
    for x, (i, s, a) in enumerate(rows):
        for j, t, b in rows[:x]:
            if a and b and s is not None and t is not None and abs(s - t) <= life and (100 + percent) * len(set(a) & set(b)) >= percent * (len(a) + len(b)):
                links.append((i, j))
    groups = defaultdict(list)
    for node, low in _components(links):
        groups[low].append(node)
    return sorted(((i, low, len(g)) for low, g in groups.items() for i in g), key=repr)


@pytest.mark.parametrize(("percent", "life"), [(60, 100), (80, 1000), (34, 37)])
def test_similar_topics_against_all_pairs(spark, percent, life):
    rng = random.Random(percent)
    rows = []
    for i in range(260):
        base = rng.randrange(12)
        words = {f"w{base}x{k}" for k in range(6)} if rng.random() < 0.7 else {f"c{rng.randrange(9)}" for _ in range(rng.randint(0, 4))}
        words = {w for w in words if rng.random() < 0.9} | {f"c{rng.randrange(4)}" for _ in range(rng.randrange(3))}
        rows.append((i, None if rng.random() < 0.03 else rng.randrange(-500, 3000), sorted(words)))
    got = similar.similar_topics(spark.createDataFrame(rows, "id long, at long, words array<string>"), percent, life)
    assert rows_of(got) == _topics(rows, percent, life)


def test_similar_topics_odd_rows(spark):
    rows = [(1, 0, ["a", "b"]), (1, 0, ["a", "b"]), (2, 5, ["x"]), (3, 10**9, ["a", "b"]), (4, 0, []), (5, None, ["a", "b"]), (6, 0, None), (None, 1, ["a", "b"])]
    df = spark.createDataFrame(rows, "id long, at long, words array<string>").withColumn("cell", F.lit("clash")).withColumn("block", F.lit(1)).withColumn("topic", F.lit(None).cast("string"))
    assert rows_of(similar.similar_topics(df, 60, 100)) == sorted([(1, 1, 3), (1, 1, 3), (None, 1, 3)], key=repr)
    assert similar.similar_topics(df.limit(0)).count() == 0
    titles = spark.createDataFrame([("Über den  Über-Fluss: 3 x!",), ("",), (None,)], "t string").select(similar.title_words(F.col("t")).alias("w"))
    assert [r.w for r in titles.collect()] == [["den", "fluss", "x", "über"], [], None]


def test_a_common_word_meets_no_one_and_copies_meet_once(spark):
    """Titles with one word in common give no pairs to look at, and copies of a title are one cell of a block."""
    rows = [(i, i % 50, sorted(["the", *(f"own{i}x{k}" for k in range(5))])) for i in range(2000)] + [(10_000 + i, i % 50, ["a", "copy"]) for i in range(3000)]
    marked = similar.cells(spark.createDataFrame(rows, "id long, at long, words array<string>"), 100)
    found = marked.groupBy("cell", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.first("words").alias("words"))
    assert found.count() == 2001
    sets = similar.ordered_words(found)
    prefix = sets.select(F.explode(F.expr("slice(words, 1, n - (n * 60 + 99) div 100 + 1)")).alias("word"))
    assert prefix.groupBy("word").count().where("count > 1").count() == 0
    got = similar.similar_topics(spark.createDataFrame(rows, "id long, at long, words array<string>"), 60, 100)
    assert got.count() == 3000 and got.where("topic = 10000 AND coverage = 3000").count() == 3000


# totals kept up to date


def test_rolling_totals_read_and_write_touched_days_alone(spark, tmp_path):
    path = str(tmp_path / "state")
    rng = random.Random(4)
    rows = [(f"2024-01-0{rng.randrange(1, 7)}", rng.choice([None, -5, 3, 3, 40_000, 2**40 + rng.randrange(50)]), rng.randrange(3)) for _ in range(3000)]
    rows = [r for r in rows if not (r[2] == 1 and r[0] in ("2024-01-02", "2024-01-05")) and not (r[2] == 2 and r[0] < "2024-01-04")]
    df = spark.createDataFrame(rows, "day string, source long, run int")
    seen = {}
    for run in range(3):
        before = files_of(path)
        rolling.update_totals(spark, path, df.where(F.col("run") == run), run)
        touched = {d for d, _, r in rows if r == run}
        for f, t in before.items():
            if f.split("day=")[1][:10] not in touched:
                assert files_of(path)[f] == t
        seen |= {d: run for d in touched}
    want = [(d, sum(r[0] == d for r in rows), len({r[1] for r in rows if r[0] == d} - {None}), seen[d]) for d in seen]
    assert rows_of(rolling.read_totals(spark, path).select("day", "articles", "media", "run")) == sorted(want, key=repr)


def test_sliding_against_counting(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(-5, 90) * 1800) for _ in range(200)]
    got = {(r.id, r.hour): (r.short, r.long) for r in rolling.sliding(spark.createDataFrame(rows, "id string, at long"), {"short": 3, "long": 20}).collect()}
    assert {h + k for i, t in rows for h in [t // 3600] for k in (0, 3, 20) if i == "a"} == {h for i, h in got if i == "a"}
    for (i, h), n in got.items():
        assert n == tuple(sum(j == i and h - k < t // 3600 <= h for j, t in rows) for k in (3, 20))


def test_lives_against_gaps(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abc"), rng.randrange(40 * 86400)) for _ in range(120)] + [("often", k * 60) for k in range(4000)]
    want = []
    for key in ("a", "b", "c", "often"):
        at = sorted(t for k, t in rows if k == key)
        lives = [[at[0]]]
        for a, b in zip(at, at[1:], strict=False):
            lives.append([b]) if b - a > 90_000 else lives[-1].append(b)
        want += [(key, n, x[0], x[-1], len({t // 86400 for t in x}), len(x), max(t for _, t in rows) - x[-1] > 90_000) for n, x in enumerate(lives, 1)]
    got = series.lives(spark.createDataFrame(rows, "id string, at long"), 90_000).select("id", "life", "first", "last", "days", "rows", "expired")
    assert rows_of(got) == sorted(want, key=repr)
    with pytest.raises(ValueError, match="a day or more"):
        series.lives(spark.createDataFrame(rows, "id string, at long"), 3600)


# streams


def _events(rng, n):
    return [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(12 * 1440)), rng.choice([None, 1, 2, 2, 3, 70_000])) for i in range(n)]


def _refreshed(batches):
    """Totals of the rows that count, batch by batch."""
    high, kept, last = None, defaultdict(list), {}
    marks = []
    for n, batch in enumerate(batches):
        for _, t, s in batch:
            day = (t + dt.timedelta(hours=9)).date()
            if high is None or dt.datetime.combine(day, dt.time()) + dt.timedelta(hours=15 + 48) >= high:
                kept[day].append(s)
                last[day] = n
        high = max([t for _, t, _ in batch] + ([high] if high else []))
        marks.append(high)
    return sorted((str(d), len(s), len(set(s) - {None}), last[d], marks[last[d]]) for d, s in kept.items())


def test_day_refresh_with_late_rows_and_batches_that_come_again(spark, tmp_path):
    rng = random.Random(7)
    rows = sorted(_events(rng, 600), key=lambda r: r[1] + dt.timedelta(hours=rng.choice([0, 0, 0, 20, 130])))
    batches = [rows[:200], rows[200:350], rows[350:]]
    frames = [spark.createDataFrame(b, "event_id long, ts timestamp_ntz, user_id long") for b in batches]
    days = refresh.DayRefresh(str(tmp_path / "days"))
    shown = lambda: rows_of(days.days(spark).select("day", "articles", "media", "batch", "updated"))
    for n, f in enumerate(frames):
        days.apply(f, n)
        assert shown() == _refreshed(batches[: n + 1])
        before = files_of(tmp_path / "days/days")
        days.apply(f, n)  # again: the same days, the same rows
        assert shown() == _refreshed(batches[: n + 1])
        touched = {f.split("day=")[1][:10] for f, t in files_of(tmp_path / "days/days").items() if before.get(f) != t}
        assert touched == {d for d, *_, b, _ in _refreshed(batches[: n + 1]) if b == n}
    for n in (1, 0, 2):  # and in another order, after all
        days.apply(frames[n], n)
    assert shown() == _refreshed(batches) and sum(r[1] for r in shown()) < len(rows)


def test_after_checks_in_any_pieces():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        failed, error = rng.random(n) < 0.6, [str(k) for k in range(n)]
        whole = feeds.after_checks((0, 0, 0, None, None, None, None), np.arange(n), failed, error)
        state, cuts = (0, 0, 0, None, None, None, None), sorted({0, n, *rng.integers(0, n, 3).tolist()})
        for a, b in zip(cuts, cuts[1:], strict=False):
            state = feeds.after_checks(state, np.arange(a, b), failed[a:b], error[a:b])
        assert state == whole
        runs = "".join("x" if f else " " for f in failed)
        assert whole[:3] == (n, len(runs) - len(runs.rstrip("x")), max(map(len, runs.split(" "))))


def test_feed_states_of_a_stream_cut_anywhere(spark, tmp_path):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = sorted((start + dt.timedelta(minutes=i * 30 + k), i * 10 + k, k, rng.random() < 0.5, f"e{i}") for i in range(300) for k in range(4) if not (k == 3 and i > 40))
    schema = "at timestamp_ntz, seq long, id long, failed boolean, error string"
    results = []
    for m, cuts in enumerate(([0, 1200], [0, 17, 500, 1200], [0, 300, 301, 302, 1200])):
        source, path = str(tmp_path / f"in{m}"), str(tmp_path / f"out{m}")
        for a, b in zip(cuts, cuts[1:], strict=False):
            spark.createDataFrame(rows[a:b], schema).write.mode("append").parquet(source)
            feeds.keep_states(spark.readStream.schema(schema).parquet(source), path).awaitTermination()
        results.append(rows_of(feeds.latest_states(spark, path)))
    assert results[0] == results[1] == results[2]
    assert {r[0]: r[-1] for r in results[0]} == {0: False, 1: False, 2: False, 3: True}  # the last fell silent
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    for i, checks, failures, longest, ok_at, failed_at, checked_at, error, _ in results[0]:
        mine = [r for r in rows if r[2] == i]
        assert (checks, checked_at) == (len(mine), us(mine[-1][0]))
        assert ok_at == max(us(r[0]) for r in mine if not r[3]) and failed_at == max(us(r[0]) for r in mine if r[3])
        assert error == max((r for r in mine if r[3]))[4] and failures <= longest


# tables and documents


def test_upsert_table_leaves_other_buckets_alone(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id string, etag string, n long"
    first = [(f"k{i}", f"e{i}", i) for i in range(300)]
    documents.upsert_table(spark, path, spark.createDataFrame(first, schema), "id", buckets=32)
    before = files_of(path)
    replies = [("k7", None, 1000), ("k7", "new", 999), ("k8", None, 1001), ("fresh", "x", 1), (None, "no key", 5)]
    documents.upsert_table(spark, path, spark.createDataFrame(replies, schema), "id", order="n", buckets=32)
    after = files_of(path)
    same = [f for f in before if after.get(f) == before[f]]
    assert len(before) - 4 <= len(same) < len(before)
    want = {k: (e, n) for k, e, n in first} | {"k7": ("new", 1000), "k8": ("e8", 1001), "fresh": ("x", 1), None: ("no key", 5)}
    got = spark.read.schema(f"{schema}, bucket int").parquet(path)
    assert {r.id: (r.etag, r.n) for r in got.collect()} == want and got.count() == len(want)


def test_versions_in_both_orders_and_after_a_failed_write(spark, tmp_path):
    old, new = (spark.createDataFrame([(k,)], "k int") for k in (1, 2))
    at = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]
    for name, order in (("a", (0, 1)), ("b", (1, 0))):
        for k in order:
            documents.publish_version((old, new)[k], str(tmp_path / name), at[k])
        assert rows_of(documents.read_version(spark, str(tmp_path / name))) == [(2, at[1])]
    bad = new.select((F.col("k") / F.raise_error(F.lit("broken"))).alias("k"))
    with pytest.raises(Exception, match="broken"):
        documents.publish_version(bad, str(tmp_path / "a"), dt.datetime(2024, 1, 3))
    assert rows_of(documents.read_version(spark, str(tmp_path / "a"))) == [(2, at[1])]
    for k in range(4, 8):
        documents.publish_version(old, str(tmp_path / "a"), dt.datetime(2024, 1, k))
    assert len(os.listdir(tmp_path / "a/manifests")) <= 4 and documents.read_version(spark, str(tmp_path / "a")).first().updated == dt.datetime(2024, 1, 7)


def test_read_between_lists_names_and_reports_broken_documents(spark, tmp_path):
    for d in range(1, 10):
        (tmp_path / f"2024-01-0{d}.json").write_text(json.dumps({"date": f"2024-01-0{d}", "articles": d})[: 20 if d == 4 else None])
    (tmp_path / "notes.txt").write_text("no document")
    path = "file://" + str(tmp_path)
    assert [f[-15:] for f in documents.files_between(spark, path, "2024-01-03", "2024-01-05")] == [f"2024-01-0{d}.json" for d in (3, 4, 5)]
    got = documents.read_between(spark, path, "2024-01-03", "2024-01-05")
    assert len(got.inputFiles()) == 3
    assert rows_of(got.select("file", "articles", F.col("broken").isNull())) == [("2024-01-03.json", 3, True), ("2024-01-04.json", None, False), ("2024-01-05.json", 5, True)]
    assert documents.read_between(spark, path, "2025-01-01", "2025-01-09").count() == 0


def test_two_documents_of_one_name_are_refused(spark, tmp_path):
    two = spark.createDataFrame([("a", 1), ("a", 2)], "file string, n int").repartition(2, "n")
    with pytest.raises(ValueError, match="2 documents"):
        documents.write_named(two, "file://" + str(tmp_path / "d"), "file")


def test_documents_in_their_published_form(spark, tmp_path):
    """Small documents in the forms of the survey: maps by word, genre and feed, arrays by month, optional keys."""
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value, ensure_ascii=False))
        return "file://" + str(tmp_path / name)

    topic = {"id": "24ddab87a6eacea6", "title": "見出し", "url": "https://example.org/a", "sourceId": "s", "category": "news", "firstAt": "2026-10-26T01:00:00.000Z", "coverage": 7, "added": 7, "peak": 60, "burst": 3}
    genre = {"articles": 3, "topics": 1, "heat": 1.07}
    trend = put("2026-10-26.json", {"date": "2026-10-26", "updatedAt": "2026-10-28T14:00:00.000Z", "until": "2026-10-26T15:00:00.000Z", "articles": 5, "media": 2, "topics": 1, "genres": {"news": genre, "tech": {"articles": 2, "topics": 0, "heat": 0}}, "words": {"ブラジル": {"articles": 3, "media": 2}, "ブラジル戦": {"articles": 2, "media": 1}}, "top": [topic]})
    days = documents.read_days(spark, trend)
    assert rows_of(documents.word_days(days).select("word", "articles", "media")) == [("ブラジル", 3, 2), ("ブラジル戦", 2, 1)]
    assert rows_of(documents.genre_days(days).groupBy().agg(F.sum("articles"), F.sum("topics"))) == [(5, 1)]
    assert documents.topic_days(days).select("rank", "id", "firstAt").first() == (1, topic["id"], dt.datetime(2026, 10, 26, 1))
    feed = put("feeds.json", {"a": {"failures": 2, "okAt": "2026-11-01T00:00:00Z", "fetchedAt": "2026-10-31T00:00:00Z", "count": 5, "failedAt": "2026-11-02T00:00:00Z", "error": "HTTP 503"}, "b": {"failures": 0, "okAt": "2026-11-03T00:00:00Z", "fetchedAt": "2026-11-03T00:00:00Z", "count": 9, "etag": "x"}})
    assert rows_of(documents.read_map(spark, feed).select("sourceId", "failures", "etag", "error")) == [("a", 2, None, "HTTP 503"), ("b", 0, "x", None)]
    note = put("2026-10.json", [{"topic": "i3", "items": ["i1", "i3"], "title": "t", "firstAt": "2026-10-27T02:50:00Z", "common": [{"text": "c", "sources": ["i1", "i3"]}], "emphasis": [{"source": "i1", "text": "e"}], "differences": [], "background": "b", "interpretation": "i", "notedAt": "2026-10-27T05:57:00Z"}])
    notes = documents.read_months(spark, note, schemas.NOTE)
    assert notes.select("month", F.element_at("items", -1) == F.col("topic"), F.size("differences"), "emphasis.text").first() == ("2026-10", True, 0, ["e"])
    popular = put("popular.json", {"updatedAt": "2026-11-01T00:00:00Z", "day": [{"id": "x", "n": 3}], "week": [{"id": "x", "n": 4}, {"id": "y", "n": 1}]})
    counts = documents.popularity(spark.read.schema(schemas.POPULAR).option("multiLine", True).json(popular))
    assert Counter(r.window for r in counts.collect()) == {"day": 1, "week": 2}


def test_notes_of_one_second_keep_their_order(spark, tmp_path):
    at = lambda us: dt.datetime(2024, 1, 1, 0, 0, 5, us)
    rows = [(1, at(10), "late"), (2, at(30), "even"), (3, at(30), "also"), (4, at(20), "zero"), (5, dt.datetime(2024, 1, 9), "zero")]
    spark.createDataFrame([(i, t, i, k) for i, t, k in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = published.QUERIES["note_documents"](spark, str(tmp_path)).select("month", "topic", "place").distinct()
    assert rows_of(got) == [("2024-01", "also", 1), ("2024-01", "even", 2), ("2024-01", "late", 4), ("2024-01", "zero", 3)]


def test_a_batch_of_many_feeds_makes_no_call_for_each(spark, tmp_path):
    rng, start = random.Random(10), dt.datetime(2024, 1, 1)
    rows = sorted((start + dt.timedelta(minutes=rng.randrange(9000)), i, rng.randrange(400), rng.random() < 0.6, rng.choice([None, f"e{i}"])) for i in range(6000))
    rows.insert(4000, (start, 9999, 5, True, "late"))  # beyond the watermark of the batches before
    source, path, schema = str(tmp_path / "in"), str(tmp_path / "out"), "at timestamp_ntz, seq long, id long, failed boolean, error string"
    seen = []
    for a, b in ((0, 2500), (2500, 4000), (4000, 6001)):
        spark.createDataFrame(rows[a:b], schema).write.mode("append").parquet(source)
        query = feeds.keep_states(spark.readStream.schema(schema).parquet(source), path)
        query.awaitTermination()
        seen += [p.stateOperators for p in query.recentProgress]
    assert seen and not any(seen)  # no state store, so no call for a feed
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    high, want = us(rows[-1][0]), []
    for i in sorted({r[2] for r in rows}):
        mine = [r for r in rows if r[2] == i and r[1] != 9999]
        state = feeds.after_checks((0, 0, 0, None, None, None, None), np.array([us(r[0]) for r in mine]), np.array([r[3] for r in mine]), [r[4] for r in mine])
        want.append((i, *state, state[5] // 1000 + feeds.SILENT_SECONDS * 1000 < (high - 3600 * 10**6) // 1000))
    assert rows_of(feeds.latest_states(spark, path)) == sorted(want, key=repr)
    assert {w[-1] for w in want} == {True, False}
