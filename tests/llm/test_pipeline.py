import random

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import toxicity
from quillspark.llm._common import cannot_match, may_match, without
from tests.compare import DATA

from .cases import near_components, odd_rows, shuffled_bytes, without_repeats, words


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in pipeline.STAGES:
        out = pipeline.materialize(stage(spark, docs, DATA), name)
        before, after = _rows(docs), out
        if name == "toxicity":
            model = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
            want = {i: t for i, t in before if i not in bad}
            assert bad and len(want) > 0.85 * len(before)
        elif name == "exact_dedup":
            groups = {}
            for i, t in before:
                groups.setdefault("".join(words(t)), []).append((-len(t), i, t))
            want = {i: t for _, i, t in map(min, groups.values())}
        elif name == "minhash_near_dedup":
            component, _ = near_components(before, 5)
            want = {i: t for i, t in before if component[i] == i}
        elif name == "substring_dedup":
            want = {i: " ".join(k) if gone else dict(before)[i] for i, _, gone, k in without_repeats(before, 50) if k or not gone}
        else:
            parts = out.toPandas()
            assert set(parts["doc_id"]) == {i for i, _ in before}
            fill = parts.groupby("sequence_id")["length"].sum()
            assert fill.max() <= 2048 and len(fill) <= np.ceil(parts["length"].sum() / 2048) + 2
            break
        assert after.columns == columns
        assert dict(_rows(after)) == want and after.count() == len(want)
        kept[name] = len(want)
        docs = after
    assert list(kept) == [n for n, _ in pipeline.STAGES[:-1]]


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, DATA), name)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, docs.select(*key).collect())) == sorted(map(tuple, pipeline.run(spark, DATA).select(*key).collect()))


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).withColumn("kept", F.lit(1))
    for start in (docs, docs.limit(0)):
        out = start
        for name, stage in pipeline.STAGES:
            out = pipeline.materialize(stage(spark, out, DATA), name)
            if name == "exact_dedup":
                assert out.count() == (9 if start is docs else 0)
        assert (out.count() > 0) == (start is docs)


def test_exact_stage_keeps_one_row_of_each_text_whatever_the_ids(spark):
    rows = [(None, "one"), (None, "two"), (None, "three"), (None, "t wo"), (None, "three"), (5, "A"), (5, "B"), (5, "C"), (6, "C"), (4, "B "), (4, "D"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, None, s, len(t or "")) for s in "ba" for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(None, "one", "a"), (None, "t wo", "a"), (None, "three", "a"), (4, "B ", "a"), (4, "D", "a"), (5, "A", "a"), (5, "C", "a"), (7, None, "a")], key=repr)
    out = dict(pipeline.STAGES)["exact_dedup"](spark, docs.repartition(3), DATA)
    assert sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=repr) == want
    for name in ("minhash_near_dedup", "substring_dedup"):  # they find nothing to do and lose nothing
        out = pipeline.materialize(dict(pipeline.STAGES)[name](spark, out, DATA), name)
        assert sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=repr) == want


@pytest.mark.parametrize("stage", [pipeline.exact_stage, pipeline.near_stage])
def test_texts_that_stay_are_not_shuffled(spark, stage):
    """Also where the rows that go are too many to broadcast."""
    rng = random.Random(7)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(250)) for _ in range(2200)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, *texts[:30]])], "doc_id long, text string, lang string, source string, n_chars long")
    docs = pipeline.materialize(docs.repartition(4), "docs")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        out = sorted(r.doc_id for r in stage(spark, docs, DATA).collect())
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert out == list(range(2200))
    assert moved < 0.6 * sum(map(len, texts))


def test_without_is_an_anti_join(spark):
    rows = [(i % 700 if i % 9 else None, i % 3, f"t{i}") for i in range(2000)]
    gone = [(i, 1) for i in range(0, 700, 5)] + [(None, 2), (5, 1), (-1, 0)]
    df = spark.createDataFrame(rows, "id int, k long, _bits string").repartition(3)
    keys = spark.createDataFrame(gone, "id long, k int")
    got = without(df, keys, "id", "k")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r for r in rows if (r[0], r[1]) not in set(gone)), key=repr) and got.columns == df.columns
    assert {(r.id, r.k) for r in may_match(df, keys, "id", "k").collect()} >= {(r[0], r[1]) for r in rows} & set(gone)
    assert may_match(df, keys, "id", "k").count() + cannot_match(df, keys, "id", "k").count() == 2000
    assert may_match(df, keys.limit(0), "id", "k").count() == 0 and without(df, keys.limit(0), "id", "k").count() == 2000
