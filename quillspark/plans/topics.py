"""Queries over orders and similar titles: places, topics and their lives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary, similar
from .catalog import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Documents come in by their ids, one in so many seconds.
APART = 900


def query(sql: str):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, doc_id * {APART} AS at, list_distinct(list_filter(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^\p{{L}}]+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM d x JOIN d y ON x.doc_id <> y.doc_id AND abs(x.at - y.at) <= {similar.LIFE} AND len(x.w) > 0 AND len(y.w) > 0
  WHERE 100 * least(len(x.w), len(y.w)) >= {similar.PERCENT} * greatest(len(x.w), len(y.w)) AND {100 + similar.PERCENT} * len(list_intersect(x.w, y.w)) >= {similar.PERCENT} * (len(x.w) + len(y.w))),
r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
t AS (SELECT a AS doc_id, min(b) AS topic FROM r GROUP BY a)
SELECT doc_id, topic, count(*) OVER (PARTITION BY topic) AS coverage FROM t""")
def similar_titles(spark, sf_dir):
    """Documents as topics by the words of their first lines, within a topic's life. The measure and its limit are choices of this repository."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = d.select(F.col("doc_id").alias("id"), (F.col("doc_id") * APART).alias("at"), similar.title_words(title).alias("words"))
    return similar.similar_topics(rows).withColumnRenamed("id", "doc_id")


@query(rf"""WITH d AS (SELECT text, DATE '1970-01-01' + CAST(doc_id * {APART} // 86400 AS INTEGER) AS day FROM documents),
runs AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{{L}}+')) AS run FROM d) GROUP BY run),
g AS (SELECT substr(run, CAST(p AS INTEGER), CAST(k AS INTEGER)) AS gram, k, n, CASE WHEN p > 1 THEN substr(run, CAST(p AS INTEGER) - 1, 1) ELSE ' ' END AS before,
    CASE WHEN p + k <= length(run) THEN substr(run, CAST(p + k AS INTEGER), 1) ELSE ' ' END AS after
  FROM (SELECT run, n, unnest(range(1, length(run) + 1)) AS p FROM runs), range(1, {dictionary.LONGEST + 1}) t(k) WHERE p + k - 1 <= length(run)),
c AS (SELECT gram, k, sum(n) AS total FROM g GROUP BY gram, k HAVING k = 1 OR sum(n) >= {dictionary.LEAST}),
e AS (SELECT gram, total, min(entropy) AS entropy FROM (
    SELECT gram, side, any_value(total) AS total, ln(sum(m)) - sum(CASE WHEN letter = ' ' THEN 0 ELSE m * ln(m) END) / sum(m) AS entropy FROM (
      SELECT gram, side, letter, any_value(total) AS total, sum(n) AS m FROM (
        SELECT gram, total, n, 'b' AS side, before AS letter FROM g JOIN c USING (gram) WHERE c.k > 1 UNION ALL SELECT gram, total, n, 'a', after FROM g JOIN c USING (gram) WHERE c.k > 1)
      GROUP BY gram, side, letter) GROUP BY gram, side) GROUP BY gram, total),
s AS (SELECT gram, total, unnest(range(1, length(gram))) AS cut FROM e WHERE round(entropy, 6) >= {dictionary.ENTROPY}),
w AS (SELECT s.gram AS word, s.total AS n FROM s JOIN c x ON x.gram = substr(s.gram, 1, CAST(cut AS INTEGER)) JOIN c y ON y.gram = substr(s.gram, CAST(cut AS INTEGER) + 1) GROUP BY s.gram, s.total
  HAVING min(CAST(s.total AS DOUBLE) / x.total / y.total * (SELECT CAST(sum(total) AS DOUBLE) FROM c WHERE k = 1)) >= {dictionary.COHESION}),
m AS (SELECT word, day FROM (SELECT day, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM d) JOIN w USING (word)
  UNION ALL SELECT word, day FROM d JOIN w ON NOT regexp_full_match(word, '[A-Za-z]+') AND contains(text, word)),
f AS (SELECT word, min(day) AS first_day FROM (SELECT word, day FROM m GROUP BY word, day HAVING count(*) >= 2) GROUP BY word)
SELECT word, CAST(n AS BIGINT) AS n, first_day FROM w JOIN f USING (word)""")
def grown_dictionary(spark, sf_dir):
    """Words mined from whole texts, by the day on which they came in. How words are told from other strings is a choice of this repository."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.expr(f"int(doc_id * {APART} div 86400)")).alias("day")
    return dictionary.grow(table(spark, sf_dir, "documents").select("text", day))
