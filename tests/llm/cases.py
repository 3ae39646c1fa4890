"""Documents with every odd case, and plain re-implementations to hold results against."""

import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside.
CLASHING = "phrase rep key spans digest component kept score a b rank parts doc part folded label n windows value place".split()


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows, clash=True):
    """rows of (doc_id, text) with columns whose names clash, holding nulls."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for i, c in enumerate(CLASHING if clash else []):
        df = df.withColumn(c, F.lit(None).cast("string") if i % 2 else F.lit(i))
    return df


def odd_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    return [
        (1, "The Same text\nhere"), (2, "TheSame texthere"), (3, "  The Same text here "), (3, "  The Same text here "),
        (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (None, "The Same text here"), (None, None), (7, "x"), (8, "x"), (9, long), (10, long), (11, long + " end"),
        (12, "日本語 テスト \U0001f642 é é ß"), (13, "a\x00b\x1cc\x85d e　f"), (-5, "negative id"), (2**62, "large id"),
    ]


def by_id(df):
    return sorted(map(tuple, df.collect()), key=repr)


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def near_components(rows, size, percent=80):
    """Component of each id by comparing all pairs."""
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    ids = sorted(i for i in sets if sets[i])
    links = []
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return components(links, sets), sets


def without_repeats(rows, window):
    """(doc_id, words, removed, kept words) by looking up each window in a table of all."""
    first = {}
    for i, t in rows:
        if i is None:
            continue
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


def shuffled_bytes(spark):
    """Bytes that all stages of the session so far have written for a shuffle."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
