"""Filter interaction audit: what each filter removes, at each place, in every order of the filters.

A document's outcome in any order follows from the set of filters that it fails, its
mask. Documents are counted once, as cells (part, mask); the orders are then walked by
single swaps of neighbours, and a swap changes only the two steps that it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, table

WORD_ENDS = r"[\x20\x09-\x0D]+"
#: Parts that one step of a task walks together.
PARTS = 256


def words(text: Column) -> Column:
    """The words of a text, runs of characters other than space and 0x09-0x0D."""
    return F.filter(F.split(text, WORD_ENDS), lambda w: w != "")


def too_short(text: Column, words: Column) -> Column:
    return F.size(words) < 50


def too_repetitive(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long")


def too_many_capitals(text: Column, words: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.char_length(text).cast("long")


def has_marks(text: Column, words: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Filters by letter, each the condition under which a text fails it.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": too_short, "B": too_repetitive, "C": too_many_capitals, "D": has_marks}
#: The filter that a copy of a document with a smaller id fails.
COPIES = "E"

STEP = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def masks(docs: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, digest): bit k of mask is set where the text fails the k-th filter; null text and part are ''."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    return rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def cells(rows: DataFrame, labels: DataFrame, bit: int) -> DataFrame:
    """(part, mask, n, good, toxic) of masks(), with `bit` set for copies of a smaller id.

    Digests that several rows have are found first, by a map-side minimum; rows meet
    them, and their labels, in left joins whose larger side AQE can split at a hot key.
    """
    rows = materialize(rows, "masks")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 AND least IS NOT NULL").select("digest", "least")
    copies = materialize(copies, "copies")
    one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality"), one("toxic"))
    known = materialize(known, "labels")
    copy = F.when(F.col("least") < F.col("doc_id"), 1 << bit).otherwise(0)
    marked = rows.join(copies, "digest", "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask")).join(known, "doc_id", "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    return marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """Places k whose swaps with k + 1, one after another, visit all orders of n items, the first one given."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1)  # the last item goes to the front,
        if (k := next(inner, None)) is None:
            return
        yield k + 1
        yield from range(n - 1)  # and back
        if (k := next(inner, None)) is None:
            return
        yield k


def walk(counts: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """All orders of n filters over counts (3, parts, 2**n): documents, good and toxic ones of each mask.

    Gives the orders, the steps (orders, n, 5, parts) as kept, removed, redundant, good and
    toxic lost, each filter's documents that fail it alone (n, parts), and its removals
    over all orders (n, parts).
    """
    mask = np.arange(1 << n)
    fails = [(mask >> f & 1).astype(bool) for f in range(n)]
    documents = counts[0]

    def step(before: int, f: int) -> np.ndarray:
        first = fails[f] & (mask & before == 0)
        removed = counts[:, :, first].sum(-1)
        return np.stack([documents[:, mask & (before | 1 << f) == 0].sum(-1), removed[0], documents[:, fails[f] & ~first].sum(-1), removed[1], removed[2]])

    order, before = list(range(n)), [(1 << k) - 1 for k in range(n)]  # before: the filters ahead of each place, as bits
    now = np.stack([step(before[k], order[k]) for k in range(n)]) if n else np.zeros((0, 5, counts.shape[1]), np.int64)
    shapley = now[:, 1].copy()  # by filter: the first order is that of the filters
    orders, steps = [tuple(order)], [now.copy()]
    for k in plain_changes(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        before[k + 1] = before[k] | 1 << order[k]
        for place in (k, k + 1):
            now[place] = step(before[place], order[place])
        shapley[order] += now[:, 1]
        orders.append(tuple(order))
        steps.append(now.copy())
    alone = np.stack([documents[:, 1 << f] for f in range(n)]) if n else np.zeros((0, counts.shape[1]), np.int64)
    return orders, np.stack(steps), alone, shapley


def steps(counted: DataFrame, letters: str) -> DataFrame:
    """The rows of STEP for each part of cells(); a part has at most 2**len(letters) cells, so a row holds them."""
    n = len(letters)

    def run(batches):
        for whole in batches:
            for some in batched(whole.to_pylist(), PARTS):
                counts = np.zeros((3, len(some), 1 << n), np.int64)
                for at, row in enumerate(some):
                    for c in row["cells"]:
                        counts[:, at, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, found, alone, shapley = walk(counts, n)
                names = ["".join(letters[f] for f in order) for order in orders]
                by = np.array(orders)  # filter at each place
                by_part = lambda x: pa.array(np.moveaxis(x, -1, 0).ravel())
                m = len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([r["part"] for r in some], len(orders) * n).tolist(), pa.string()),
                        pa.array(np.tile(np.repeat(names, n), m).tolist(), pa.string()),
                        pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), m * len(orders))),
                        *(by_part(found[:, :, k]) for k in range(3)),
                        by_part(alone[by]),
                        *(by_part(found[:, :, k]) for k in (3, 4)),
                        by_part(shapley[by]),
                    ],
                    names=[c.split()[0] for c in STEP.split(", ")],
                )

    grouped = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return grouped.mapInArrow(run, STEP)


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters (and of the copy filter, the last letter) and step.

    kept are the documents left after the step, removed those that go in it, redundant
    those that fail its filter and went earlier, unique_fails those that fail no other
    filter, good_lost and toxic_lost those removed with such a label, shapley the
    filter's removals over all orders.

    Null texts and parts are ''. A row without id is never a copy and has no label;
    rows of one id are no copies of each other, and a label that any of an id's label
    rows has holds. Repeated rows count as often as they are there. An empty table
    gives no rows.
    """
    counted = cells(masks(docs, filters, id_col, text_col, part_col), labels, len(filters))
    return steps(counted, "".join(filters) + COPIES)


def op11_filter_audit(spark, sf_dir):
    """audit() over documents by source; null, repeated and empty rows as there."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE)::INT AS mask
  FROM d),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS before FROM o, range(1, 6) t(step)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""
