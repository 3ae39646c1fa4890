import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import divergence, filter_audit, quality
from tests.compare import DATA, same

from .cases import by_id, frame, odd_rows, words

SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows):
    """Rows of SCHEMA with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    for i, c in enumerate("part mask digest least n good toxic y shard label t term p q total groups kept w x i j rank value cells quality words".split()):
        df = df.withColumn(c, F.lit(None).cast("string") if i % 2 else F.lit(i))
    return df


def odd_documents():
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, t, ["en", None, "", "de"][k % 4], [None, "a", "", "b", "日本"][k % 5]) for k, (i, t) in enumerate(odd_rows())]
    rows += [(20 + i, good + (" #" if i % 3 == 0 else "") + (" AB" * 40 if i % 4 == 0 else ""), "en", "ab"[i % 2]) for i in range(14)]
    return rows + [(40, "same same " * 40, "en", "c"), (41, "same same " * 40, "en", "c"), (39, "same same " * 40, "de", "a")]


# filter audit


def _fails(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _, s in rows:
        w, text = words(t), t or ""
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i}
        out.append((i, s or "", {f for f in "ABCDE" if fails[f]}))
    return out


def _audited(rows, labels):
    """Every order applied to every document, one by one."""
    label = defaultdict(lambda: [0, 0])
    for i, q, x in labels:
        if i is not None:
            label[i] = [max(label[i][0], q == 1), max(label[i][1], x == 1)]
    found, docs = {}, _fails(rows)
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                removed_by[f] += len(gone)
                fails = [x for _, x in mine if f in x]
                lost = [sum(label[i][k] for i, _ in gone if i is not None) for k in (0, 1)]
                found[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(x == {f} for x in fails), *lost]
        for (p, order, step), v in found.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return sorted((*k, *v) for k, v in found.items())


def test_audit_matches_sql(spark):
    same(filter_audit.op11_filter_audit(spark, DATA), filter_audit.ORACLE_SQL)


def test_audit_odd_rows_against_every_order(spark):
    rows = odd_documents()
    labels = [(20, 1, 0), (20, 0, 1), (24, 1, None), (None, 1, 1), (41, None, 1), (9, 1, 1), (3, 1, 1), (999, 1, 1)]
    got = filter_audit.audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == [c.split()[0] for c in filter_audit.STEP.split(", ")]
    assert sorted(map(tuple, got.collect())) == _audited(rows, labels)


def test_audit_of_many_parts_and_none(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, []), labels).count() == 0
    rows = [(i, "x #" if i % 2 else "y", "en", f"s{i % 600}") for i in range(1800)]
    got = filter_audit.audit(documents(spark, rows), labels)
    assert got.count() == 600 * 600
    assert got.where("filter_order = 'ABCDE' AND step = 1 AND removed = 3 AND kept = 0").count() == 600


@pytest.mark.parametrize("n", range(1, 7))
def test_plain_changes_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in filter_audit.plain_changes(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n)


def test_shapley_shares_add_up():
    counts = np.random.default_rng(3).integers(0, 50, (3, 4, 32))
    orders, steps, _, shapley = filter_audit.walk(counts, 5)
    assert len(set(orders)) == 120
    assert (shapley.sum(0) == 120 * counts[0, :, 1:].sum(-1)).all()  # every order removes the same documents
    assert (steps[:, -1, 0] == counts[0, :, 0]).all()


# divergence


def _diverged(rows, least=10, listed=10):
    occurs, docs, groups = Counter(), Counter(), set()
    for _, t, lang, s in rows:
        lang, s = lang or "", s or ""
        groups.add((lang, s))
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        occurs.update((lang, s, w) for w in found)
        docs.update((lang, w) for w in set(found))
    out = []
    for lang, s in groups:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        sources = [b for a, b in groups if a == lang]
        total = {b: sum(occurs[lang, b, w] for w in kept) for b in sources}
        share = lambda c, n, v=len(kept): 1 + 10**9 * (c + 2) // (n + 2 * v)
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        p = {b: {w: share(occurs[lang, b, w], total[b]) for w in kept} for b in sources}
        q = {w: share(sum(occurs[lang, b, w] for b in sources), sum(total.values())) for w in kept}
        parts = {"pair": [(-sum(apart(p[s][w], p[b][w]) for w in kept), b.encode()) for b in sources if b != s]}
        parts["term"] = [(-apart(p[s][w], q[w]), w.encode()) for w in kept if occurs[lang, s, w] and p[s][w] > q[w]]
        for part, found in parts.items():
            out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found), 1) if part == "pair" or k <= listed]
    return sorted(out)


def test_divergence_matches_sql(spark):
    same(divergence.op12_source_divergence(spark, DATA), divergence.ORACLE_SQL)


@pytest.mark.parametrize("least", [1, 2, 10])
def test_divergence_odd_rows_against_plain_counts(spark, least):
    rows = odd_documents() + [(100 + i, f"É été ÉTÉ Zz_zz zz{i % 3}\x7fzz Ünder x@y", "fr", f"s{i % 3}") for i in range(12)] + [(200, "1 2 3", "it", "s0"), (201, None, "it", "s1"), (202, "alone " * 12, "pt", "s0")]
    got = divergence.divergence(documents(spark, rows), least=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == _diverged(rows, least)


def test_divergence_of_nothing_and_of_large_counts(spark):
    assert divergence.divergence(documents(spark, [])).count() == 0
    big = 7 * 10**15
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(3 * big), F.lit(5)).alias("s")).first()
    assert row.s == 1 + 10**9 * (big + 2) // (3 * big + 10)


def test_divergence_sums_before_it_shuffles(spark):
    """Contributions of terms to pairs are summed in the tasks that make them."""
    df = divergence.divergence(spark.read.parquet(f"{DATA}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# quality


@pytest.fixture(scope="module")
def quality_rows(spark):
    data = f"{DATA}/../sf0.1"
    out = quality.op13_quality(spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    return out.join(labels, F.col("doc_id") == F.col("id")).select("doc_id", "held_out", "score", "predicted", "quality").toPandas()


def test_quality_held_out_accuracy(quality_rows):
    held = quality_rows[quality_rows.held_out]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert len(bad) > 100 and len(good) > 600
    assert (bad.predicted == 0).mean() >= 0.95 and (good.predicted == 1).mean() >= 0.99
    assert ((quality_rows.score >= 0.3) == (quality_rows.predicted == 1)).all()
    assert (np.subtract.outer(good.score.to_numpy(), bad.score.to_numpy()) > 0).mean() >= 0.995


def test_quality_learns_from_no_held_out_row(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    plain = quality.training_rows(docs, labels)
    assert plain.count() > 20 and plain.where(quality.held_out("doc_id")).count() == 0
    assert quality.training_rows(docs, labels, train_rows=10).count() == 10
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    small = {"rounds": 1, "passes": 1, "bits": 10}
    a, b = quality.learn(docs, labels, **small), quality.learn(other.repartition(5), turned.repartition(3), **small)
    assert all(x == y for x, y in zip(a.parts(), b.parts(), strict=True))


def test_quality_odd_rows(spark):
    rows = odd_rows()
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (9, 0), (12, 1), (13, 0), (None, 1), (11, None), (7, 3)], "doc_id long, quality int")
    model = quality.learn(frame(spark, rows), labels, rounds=1, passes=2, shards=2)
    got = by_id(quality.score(frame(spark, rows), model))
    assert len(got) == len(rows) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= quality.ACCEPT) for r in got)
    empty = {r[2] for r in got if r[0] in (4, 5, 6)}
    assert len(empty) == 1
    for i, _, s, _ in got:
        text = {r[0]: r[1] for r in rows}[i]
        if i is not None:
            bucket, weight = quality.counted(text, quality.BITS, quality.GRAMS)
            e = np.exp(model.layer.astype(float) @ (weight.astype(float) @ model.vectors[bucket]) + model.bias)
            assert abs(e[1] / e.sum() - s) < 1e-4
    assert quality.score(frame(spark, []), model).count() == 0
    nothing = quality.learn(frame(spark, []), labels)
    assert {r[2] for r in by_id(quality.score(frame(spark, rows), nothing))} == {0.5}


def _plain_features(text, grams):
    """The kinds of features by plain strings: words, pairs, n-grams that hold a space at their ends alone."""
    w = words(text)
    said = re.sub("[\t\n\x0b\x0c\r]", " ", f" {text} ")
    kinds = [w, list(zip(w, w[1:], strict=False))]
    return kinds + [[g for i in range(len(said) - n + 1) if " " not in (g := said[i : i + n])[1:-1]] for n in grams]


def test_quality_features_against_plain_strings():
    texts = ["ab ab  ab\tcd", None, "", "日本 é\x00x", " lead", "a", "same word word same word word " * 50]
    found = list(quality.features(pa.array(texts, pa.string()), 30))
    for i, t in enumerate(texts):
        for (bucket, first), plain in zip(found, _plain_features(t or "", quality.GRAMS) if t else [[]] * 5, strict=True):
            mine = bucket[first[i] : first[i + 1]]
            assert len(mine) == len(plain)
            if plain and not isinstance(plain[0], tuple):
                assert len({*zip(mine.tolist(), plain, strict=True)}) == len(set(plain)) == len(set(mine.tolist()))
    pairs, first = found[1]
    assert len(set(pairs[first[0] : first[1]].tolist())) == 2  # ab ab, twice, and ab cd


def test_quality_step_goes_down_the_slope():
    rng = np.random.default_rng(5)
    model = quality.Model.start(6, 4)
    model.layer[:] = rng.normal(size=(2, 4))
    bucket, weight = np.arange(10), np.full(10, 0.1, np.float32)
    loss = lambda: -math.log(quality.softmax(model.layer @ (weight @ model.vectors[bucket]) + model.bias)[1])
    losses = [loss()]
    for _ in range(20):
        model.learn(bucket, weight, 1, rate=0.05)
        losses.append(loss())
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False))
