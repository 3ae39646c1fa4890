"""Source divergence audit: how far the sources of a language stand apart, and by which terms.

Each term is one row with its counts in all sources of the language, in the order of
the sources (a wide vector). Higher-order functions turn a vector into shares and emit
what the term adds to every pair of sources; partial sums on the map side leave one
row for each pair and task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, table

#: Terms in fewer documents of their language are left out.
LEAST_DOCUMENTS = 10
#: Terms that are listed for a group.
LISTED = 10
#: Shares are parts of this.
SCALE = 1_000_000_000
SMOOTHING = 2
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Runs of letters A-Z, a-z and characters beyond ASCII, in order; only A-Z are lower-cased."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, _BETWEEN), "")


def counts(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents) of rows (lang, source, text): occurrences, and documents that have the term.

    A document's terms are sorted and zipped with themselves, one place further on, so an
    occurrence that differs from the one before it is the document's first.
    """
    found = rows.select("lang", "source", F.sort_array(terms(F.col("text"))).alias("t"))
    before = F.slice(F.concat(F.array(F.lit("")), "t"), F.lit(1), F.size("t"))
    found = found.select("lang", "source", F.inline(F.arrays_zip(F.col("t").alias("term"), before.alias("before"))))
    return found.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("term") != F.col("before")).alias("documents"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact beyond 64 bits; with kept = 0 there is no term to ask for."""
    wide = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + SMOOTHING), wide(total + SMOOTHING * kept))
    return whole.cast("long") + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def vectors(counted: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total, by_source) of the terms in `least` documents of the language: a map of counts for the sources that have it."""
    entries = F.collect_list(F.struct("source", "n"))
    grouped = counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("total"), entries.alias("entries"))
    return grouped.where(F.col("documents") >= least).select("lang", "term", "total", F.map_from_entries("entries").alias("by_source"))


def sizes(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """(lang, groups, kept, total): a language's sources in order with their counts over kept terms, how many terms it keeps, and their count."""
    found = wide.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    everyone = rows.select("lang", "source").distinct()
    known = everyone.join(found, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    groups = known.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"), F.sum("n").alias("total"))
    kept = wide.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    return groups.join(kept, "lang", "left").select("lang", "groups", F.coalesce("kept", F.lit(0)).alias("kept"), "total")


def _pairs(of: Column, make) -> Column:
    """make(i, j, of[i], of[j]) for all i < j."""
    inner = lambda x, i: F.transform(F.slice(of, i + 2, F.size(of)), lambda y, k: make(i, i + 1 + k, x, y))
    return F.flatten(F.transform(of, inner))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, listed: int = LISTED, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source).

    Part 'pair': the other sources of the language by how far their shares of the kept
    terms stand apart, all of them. Part 'term': the terms that the group has more often
    than its language, by the same measure, at most `listed`. Ranks count from 1, value
    descending, then item.

    Null text, lang and source are ''. Repeated rows are documents of their own. A
    language without kept terms has pairs of value 0 and no terms; a group alone in its
    language has no pairs. An empty table gives no rows.

    Rows of a language's sizes are few and wide (as many entries as it has sources);
    the joins with them carry no hint, so Spark broadcasts them only by their size and
    else splits the hot languages.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    wide = materialize(vectors(counts(rows), least), "vectors")
    langs = materialize(sizes(rows, wide), "sizes")

    n = F.transform("groups", lambda g: F.coalesce(F.try_element_at("by_source", g["source"]), F.lit(0)))
    p = F.zip_with("n", "groups", lambda c, g: share(c, g["n"], F.col("kept")))
    dense = wide.join(langs.withColumnRenamed("total", "whole"), "lang").withColumn("n", n)
    shares = materialize(dense.select("lang", "term", "n", p.alias("p"), share(F.col("total"), F.col("whole"), F.col("kept")).alias("q")), "shares")

    added = _pairs(F.col("p"), lambda i, j, x, y: F.struct(i.alias("i"), j.alias("j"), apart(x, y).alias("f")))
    sums = shares.select("lang", F.explode(added).alias("a")).groupBy("lang", "a.i", "a.j").agg(F.sum("a.f").alias("value"))
    names = _pairs(F.col("groups"), lambda i, j, x, y: F.struct(i.alias("i"), j.alias("j"), x["source"].alias("x"), y["source"].alias("y")))
    every = langs.select("lang", F.explode(names).alias("a")).select("lang", "a.*").join(sums, ["lang", "i", "j"], "left")
    ways = F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))
    pairs = every.select("lang", F.explode(ways).alias("w"), F.coalesce("value", F.lit(0)).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(by_value))

    here = F.transform(F.arrays_zip("n", "p"), lambda s, i: F.struct(i.alias("i"), s["n"].alias("n"), s["p"].alias("p")))
    here = F.filter(here, lambda s: (s["n"] > 0) & (s["p"] > F.col("q")))
    above = shares.select("lang", "term", "q", F.explode(here).alias("s")).select("lang", "s.i", "term", apart(F.col("s.p"), F.col("q")).alias("value"))
    in_group = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "term")
    top = above.withColumn("rank", F.row_number().over(in_group)).where(F.col("rank") <= listed)
    places = langs.select("lang", F.posexplode("groups").alias("i", "g")).select("lang", "i", "g.source")
    said = top.join(places, ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(said)


def op12_source_divergence(spark, sf_dir):
    """divergence() over documents; null, repeated and empty rows as there."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, sum(coalesce(n, 0)) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTHING})) // (total::HUGEINT + {SMOOTHING} * v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + {SMOOTHING})) // (sum(n) OVER (PARTITION BY lang) + {SMOOTHING} * v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {LISTED}
"""
