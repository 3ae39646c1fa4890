import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, minhash_dedup, substring_dedup
from quillspark.llm.components import connected_components
from tests.compare import DATA, same

from .cases import by_id, components, frame, near_components, odd_rows, shingles, without_repeats, words


# exact


def test_exact_matches_sql(spark):
    same(exact_dedup.op8_exact_dedup(spark, DATA), exact_dedup.ORACLE_SQL)


def test_exact_odd_rows(spark):
    rows = odd_rows()
    got = exact_dedup.exact_dedup(frame(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    want = []
    for i, t in rows:
        group = [(j, u) for j, u in rows if norm(u) == norm(t)]
        longest = max(len(u or "") for _, u in group)
        ids = [j for j, u in group if len(u or "") == longest and j is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(group), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert by_id(got) == sorted(want, key=repr)


def test_exact_hot_group_and_empty_table(spark):
    rows = [(i, "hot text") for i in range(3000)] + [(10_000 + i, f"text {i // 2}") for i in range(2000)]
    df = frame(spark, rows, clash=False).repartition(7)
    for counters in (2, 1024):
        got = exact_dedup.exact_dedup(df, counters=counters)
        assert got.where("kept").count() == 1001 and got.where("group_size = 3000 AND keep_id = 0").count() == 3000
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("counters", [1, 3, 20])
def test_misra_gries_finds_all_frequent(spark, counters):
    rng = random.Random(counters)
    values = [str(int(rng.paretovariate(0.7))) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    got = {r.v for r in exact_dedup.frequent(df, "v", counters).collect()}
    assert len(got) <= counters
    assert {v for v, n in Counter(values).items() if n > 2 * len(values) / (counters + 1)} <= got


# near


def _near_rows(rng, n=60):
    vocabulary = [f"Wort{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 6, 20, 80, 300]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 20, len(base) // 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            base = copy if rng.random() < 0.4 else base  # chains: copies of copies
            rows.append((i, rng.choice([" ", "\n "]).join(w.upper() if rng.random() < 0.1 else w for w in copy)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_near_matches_all_pairs(spark, size):
    rows = _near_rows(random.Random(size))
    want, sets = near_components(rows, size)
    got = minhash_dedup.near_duplicates(frame(spark, rows), size=size)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


@pytest.mark.parametrize("turned", [False, True])
def test_near_texts_of_one_id_are_all_linked(spark, turned):
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=60)) for _ in range(12)]
    near = lambda t: t.rsplit(" ", 2)[0] + " other end"
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1].replace(" ", "\n")), (9, near(texts[0])), (7, near(texts[1])), (7, None), (6, texts[2]), (6, texts[2])]
    rows += [(20, texts[3]), (21, near(texts[3])), (21, texts[4]), (3, near(texts[4])), (30, texts[5]), (30, texts[6]), (None, texts[5]), (None, texts[0])]
    got = by_id(minhash_dedup.near_duplicates(frame(spark, rows[::-1] if turned else rows), size=2))
    component = {5: 5, 9: 5, 7: 5, 6: 6, 20: 3, 21: 3, 3: 3, 30: 30}
    # a row without words is linked with nothing, whatever its id
    want = [(i, len(shingles(t, 2)), component[i] if i is not None and t else i, i is None or t is None or component[i] == i) for i, t in rows]
    assert got == sorted(want, key=repr)


def test_near_odd_rows(spark):
    rows = odd_rows()
    got = by_id(minhash_dedup.near_duplicates(frame(spark, rows), size=2))
    want, sets = near_components(rows, 2)
    expected = [(i, len(sets[i]), want[i], want[i] == i) for i, _ in rows if i is not None] + [(None, 3, None, True), (None, 0, None, True)]
    assert got == sorted(expected, key=repr)
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert minhash_dedup.near_duplicates(frame(spark, [(1, "only one")])).count() == 1


def test_near_matches_all_pairs_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want, sets = near_components(rows, 2)
    got = minhash_dedup.op10_minhash_near_dedup(spark, DATA)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


def test_near_candidates_of_a_group_grow_as_the_group(spark, monkeypatch):
    counted = []

    def counting(groups, percent):
        pairs = minhash_dedup.materialize(candidates(groups, percent), "counted")
        counted.append(pairs.count())
        return pairs

    candidates = minhash_dedup.candidate_pairs
    monkeypatch.setattr(minhash_dedup, "candidate_pairs", counting)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 401):  # two of these have about 0.55 in common, and none has 0.8 with the base
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([11, 13, 20])):
            copy[at] = f"v{rng.randrange(400)}"
        if i % 3 == 0:
            del copy[rng.randrange(100) : 104]
        rows.append((i, " ".join(copy)))
    for n in (201, 401):
        want, _ = near_components(rows[:n], 2)
        got = minhash_dedup.near_duplicates(frame(spark, rows[:n], clash=False), size=2)
        assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert len(set(want.values())) > 100
    assert counted[1] < 2.5 * max(counted[0], 20), counted


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2000 + i) for i in range(50)]
    df = spark.createDataFrame([*links, (None, 1)], "a long, b long")
    ends = {x for link in links if link[0] != link[1] for x in link}
    assert {r.node: r.component for r in connected_components(df).collect()} == components([k for k in links if k[0] != k[1]], ends)
    assert connected_components(df.limit(0)).count() == 0


# passages


@pytest.mark.parametrize(("window", "phrase"), [(6, 2), (10, 4), (5, 5)])
def test_substring_matches_brute_force(spark, window, phrase):
    rng = random.Random(window)
    passages = [[f"p{k}{j}" for j in range(rng.randint(window - 2, 3 * window))] for k in range(12)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            cut = rng.randint(0, 3)
            text += rng.choices("abcdefgh", k=rng.randint(0, 8)) + p[cut:] + (["z"] if rng.random() < 0.3 else [])
        rows.append((i, " ".join(text)))
    got = substring_dedup.substring_dedup(frame(spark, rows).repartition(4), window=window, phrase=phrase)
    want = [(i, n, gone, " ".join(kept)) for i, n, gone, kept in without_repeats(rows, window)]
    assert sum(w[2] for w in want) > 100
    assert by_id(got) == sorted(want, key=repr)


def test_substring_odd_rows(spark):
    rows = odd_rows()
    want = [(i, n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, n, gone, kept in without_repeats(rows, 50)]
    assert by_id(substring_dedup.digest_columns(frame(spark, rows))) == sorted(want, key=repr)
    assert substring_dedup.digest_columns(frame(spark, [])).count() == 0


def test_substring_matches_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, n, gone, kept in without_repeats(rows, 50)]
    assert by_id(substring_dedup.op3_substring_dedup(spark, DATA)) == sorted(want, key=repr)


def test_rewrite_keeps_columns_and_untouched_texts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a  b\n{passage}"), (2, f"{passage} tail"), (3, passage), (4, " spaced  out "), (5, None), (None, passage)]
    df = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    out = substring_dedup.rewrite(df)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (f"a  b\n{passage}", 5 + len(passage)), 2: ("tail", 4), 4: (" spaced  out ", 13), 5: (None, None), None: (passage, len(passage))}
    assert words(" a b\x1cc ") == ["a b\x1cc"]


def test_substring_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    own = " ".join(f"o{i}" for i in range(90))
    rows = [(1, a), (1, f"{b} end"), (2, f"{own} {a}"), (2, f"{b} {own}"), (2, "a few words"), (2, "x"), (2, None), (3, f"{own} tail"), (3, f"{own} tail"), (3, None), (None, a), (None, None)]
    want = [(i, n, gone, " ".join(kept)) for i, n, gone, kept in without_repeats(rows, 50)]
    assert sum(w[2] for w in want) == 60 + 60 + 90 + 90
    assert by_id(substring_dedup.substring_dedup(frame(spark, rows).coalesce(1))) == sorted(want, key=repr)
    df = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    left = [(i, " ".join(k) if gone else t) for (i, t), (_, _, gone, k) in zip(rows, without_repeats(rows, 50), strict=True)]
    assert by_id(substring_dedup.rewrite(df).select("doc_id", "text")) == sorted(left, key=repr)
