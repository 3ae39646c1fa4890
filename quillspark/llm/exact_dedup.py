"""Exact deduplication with a split for heavy hitters."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cannot_match, keyed, materialize, may_match, table

#: Deleted before texts are compared: space and 0x09-0x0D.
WHITE = " \t\n\x0b\x0c\r"
#: Counters of a Misra-Gries summary. At most this many digests are broadcast.
COUNTERS = 1024


def _digest(text: Column) -> list[Column]:
    """text_sha256 of the text without white space, and n_chars with it; null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.sha2(F.translate(text, WHITE, ""), 256).alias("text_sha256"), F.char_length(text).cast("long").alias("n_chars")]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, n_chars) of each row; null text counts as empty."""
    return keyed(docs, id_col, text_col).select("doc_id", *_digest(F.col("text")))


def frequent(df: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Every value of column in more than 2/(counters+1) of the rows, and at most `counters` values.

    Each partition keeps a Misra-Gries summary. A summary undercounts by at most
    rows/(counters+1), so the summed counter of such a value is above
    rows/(counters+1), which at most `counters` values can reach.
    """

    def summarize(batches):
        kept: dict[str, int] = {}
        for b in batches:
            for value, n in zip(*(x.to_pylist() for x in pc.value_counts(b.column(0)).flatten()), strict=True):
                if value in kept:
                    kept[value] += n
                elif len(kept) < counters:
                    kept[value] = n
                else:
                    while n > 0 and len(kept) >= counters:
                        cut = min(n, min(kept.values()))
                        n -= cut
                        kept = {k: v - cut for k, v in kept.items() if v > cut}
                    if n > 0:
                        kept[value] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], [column, "n"])

    rows = df.count()
    summed = df.select(column).where(F.col(column).isNotNull()).mapInArrow(summarize, f"{column} string, n long").groupBy(column).agg(F.sum("n").alias("n"))
    return summed.where(F.col("n") > F.lit(rows / (counters + 1))).select(column)


def _winner() -> list:
    """Most code points in the original text, then the smallest doc_id."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus")))
    return [(-best["minus"]).alias("keep_id"), best["n_chars"].alias("most"), F.count(F.lit(1)).alias("group_size")]


def _split(rows: DataFrame, counters: int) -> tuple[DataFrame, DataFrame]:
    """Winners of the frequent digests of rows (doc_id, text_sha256, n_chars), at most `counters`, and the rows of the others."""
    hot = materialize(frequent(rows, "text_sha256", counters), "frequent")
    winners = materialize(rows.join(F.broadcast(hot), "text_sha256").groupBy("text_sha256").agg(*_winner()), "winners")
    return winners, rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space (space, 0x09-0x0D) is
    deleted; null is empty. Of a group, the row with the most code points, then
    the smallest id, stays. Repeated rows count in group_size and all share the
    outcome of their id; a row without id loses to any row of its length with
    one, and is kept only if its group has no ids. An empty table gives none.

    The frequent digests' winners (at most `counters` rows) are verified by an
    exact count and broadcast; their rows need no shuffle. The rest is grouped
    by digest and joined back.
    """
    rows = materialize(digests(docs, id_col, text_col), "digests")
    winners, light = _split(rows, counters)
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    light = light.join(light.groupBy("text_sha256").agg(*_winner()), "text_sha256")
    return heavy.unionByName(light).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row of docs, with all its columns, for each different text, whatever ids the rows have.

    The row with the most code points, then the smallest id, stays, as in
    exact_dedup(); a row without id only where no row of that length has one. Of
    rows that share text, length and id, the least by all columns stays. Null text
    is empty; an empty table gives an empty table.

    Frequent digests are decided map-side by their broadcast winners. Of the rest,
    the rows that go are found by digest alone and taken out by an anti join. Rows that
    share id and length with none of them are told by a bitmap and stay where they are,
    so whole texts are shuffled only of rows that go and of a few others.
    """
    names = docs.columns
    rows = materialize(digests(docs, id_col, text_col), "digests")
    winners, light = _split(rows, counters)
    where = {"text_sha256": "_sha", "n_chars": "_length", "doc_id": "_id"}
    most = light.groupBy("text_sha256").agg(*_winner())
    same = (F.col("n_chars") == F.col("most")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = light.join(most, "text_sha256").where(~same).select(*where).distinct()
    gone = materialize(gone.withColumnsRenamed(where), "gone")
    # the rows that stay of one text, one length and one id
    stays = rows.join(F.broadcast(winners), "text_sha256").where(same).select(*where).unionByName(light.join(most, "text_sha256").where(same).select(*where))
    ties = materialize(stays.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*where).withColumnsRenamed(where), "ties")

    digest, length = _digest(F.col(f"`{text_col}`"))
    at = lambda a, b: (a["_sha"] == b["_sha"]) & (a["_length"] == b["_length"]) & a["_id"].eqNullSafe(b["_id"])
    won = winners.select(F.col("text_sha256").alias("_hot"), F.col("most").alias("_most"), F.col("keep_id").alias("_keep"))
    by_length = docs.withColumns({"_length": length, "_id": F.col(f"`{id_col}`").cast("long")})

    def standing(some: DataFrame) -> DataFrame:
        """Those of some that no frequent digest's winner takes out, with their digest."""
        marked = some.withColumn("_sha", digest)
        return marked.join(F.broadcast(won), marked["_sha"] == won["_hot"], "left").where("_hot IS NULL OR _length = _most AND _id <=> _keep").select(*marked.columns)

    rest = standing(may_match(by_length, gone, "_id", "_length"))
    rest = rest.join(gone.hint("merge"), at(rest, gone), "left_anti")
    kept = standing(cannot_match(by_length, gone, "_id", "_length")).unionByName(rest)
    if not ties.limit(1).count():
        return kept.select(*names)
    single = kept.join(ties, at(kept, ties), "left_anti").select(*names)
    several = kept.join(ties, at(kept, ties), "left_semi").groupBy("_sha").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return single.unionByName(several)


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
