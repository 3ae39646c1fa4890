"""Words mined from texts, against plain Python."""

import datetime as dt
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quillspark.operators import dictionary


def plain_words(texts, least, longest, entropy, cohesion):
    """mine_words() by counting every string of every run."""
    count, sides = Counter(), defaultdict(Counter)
    for text in texts:
        for run in re.findall(r"[^\W\d_]+", text or ""):
            for a in range(len(run)):
                for b in range(a + 1, min(len(run), a + longest) + 1):
                    count[run[a:b]] += 1
                    sides[run[a:b], 0][run[a - 1] if a else None] += 1
                    sides[run[a:b], 1][run[b] if b < len(run) else None] += 1
    size, out = sum(n for g, n in count.items() if len(g) == 1), {}
    for gram, n in count.items():
        ends = [math.log(n) - sum(m * math.log(m) for c, m in sides[gram, k].items() if c) / n for k in (0, 1)]
        if len(gram) > 1 and n >= least and round(min(ends), 6) >= entropy:
            if min(n / count[gram[:k]] / count[gram[k:]] * size for k in range(1, len(gram))) >= cohesion:
                out[gram] = n
    return out


def sentences(seed, rows, words, longest_row):
    rng = random.Random(seed)
    return ["".join(rng.choice(words) for _ in range(rng.randint(1, longest_row))) for _ in range(rows)]


CASES = {
    "no separators": sentences(1, 60, ["津波", "東京都", "地震", "は", "が", "に", "避難所", "強い", "出た"], 12),
    "long runs": sentences(2, 3, ["津波", "東京都", "地震", "は", "が", "に"], 900),
    "separators": [" ".join(sentences(3, 40, ["ab", "cad", "e", "ba"], 3)), "ab cad. AB? 12ab ab", "é́ab"],
    "odd": [None, "", " 12 !", "a", "aaaaaaaaaaaaaaaaaaaa", "aaaa", "aaaa"],
}


@pytest.mark.parametrize("case", sorted(CASES))
@pytest.mark.parametrize(("least", "entropy", "cohesion"), [(2, 0.0, 0.0), (4, 0.8, 1.2)])
def test_words_equal_plain_counts(spark, case, least, entropy, cohesion):
    df = spark.createDataFrame([(t, "w") for t in CASES[case]], "text string, word string")
    got = {r.word: r.n for r in dictionary.mine_words(df, least=least, longest=4, entropy=entropy, cohesion=cohesion).collect()}
    assert got == plain_words(CASES[case], least, 4, entropy, cohesion)
    assert got or case == "odd" and entropy > 0


def test_words_without_separators_are_found(spark):
    df = spark.createDataFrame([(t,) for t in CASES["no separators"]], "text string")
    got = {r.word for r in dictionary.mine_words(df, least=8, cohesion=3.0).collect()}
    assert {"津波", "東京都", "地震", "避難所"} <= got and not got & {"波は", "京都", "東京", "難所"}


def test_dictionary_grows_and_keeps_what_it_has(spark):
    days = [dt.date(2026, 1, 1 + k // 20) for k in range(60)]
    rows = [(d, t + ("台風" + "はがに"[k % 3] if d.day > 2 else "")) for k, (d, t) in enumerate(zip(days, CASES["no separators"], strict=True))]
    df = spark.createDataFrame([*rows, (None, "津波"), (days[0], None)], "day date, text string")
    first = dictionary.grow(df.where("day <= '2026-01-02'"), least=8, cohesion=3.0).collect()
    have = {r.word: (r.n, r.first_day) for r in first}
    assert have["津波"][1] == days[0] and "台風" not in have
    known = spark.createDataFrame(first, "word string, n long, first_day date")
    more = {r.word: (r.n, r.first_day) for r in dictionary.grow(df, known=known, least=8, cohesion=3.0).collect()}
    assert all(more[w] == x for w, x in have.items()) and more["台風"][1] == dt.date(2026, 1, 3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "day date, text string, word string, n long, id long")
    assert dictionary.grow(df).collect() == [] and dictionary.grow(df).columns == ["word", "n", "first_day"]


def test_what_is_written_does_not_grow_with_the_places(spark, monkeypatch):
    """Distinct runs that have the same few windows of letters: each level has those, not the places of the runs."""
    texts = ["津波の" * k for k in range(1, 201)]
    rows, keep = [], dictionary.written

    def counted(df, name):
        out = keep(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(dictionary, "written", counted)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: r.n for r in dictionary.mine_words(df, entropy=0.0, cohesion=0.0).collect()}
    assert got == plain_words(texts, dictionary.LEAST, dictionary.LONGEST, 0.0, 0.0) and got
    assert sum(rows) < 500 < sum(map(len, texts))
