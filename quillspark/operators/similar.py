"""Topics of texts with similar titles that come close to one another in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .graph import components, joined_components

#: Titles are linked with so many hundredths of their words in common, and within so many seconds: a topic's life.
PERCENT, LIFE = 60, 72 * 3600


def title_words(title: Column) -> Column:
    """The distinct words of a title in lower case, sorted; a word is a run of letters."""
    return F.sort_array(F.array_distinct(F.array_remove(F.split(F.lower(title), r"[^\p{L}]+"), "")))


def cells(rows: DataFrame, life: int = LIFE) -> DataFrame:
    """rows (id, at, words) with block and cell: the rows of one set of words in one block of `life` seconds.

    All rows of a cell are within `life` of each other, so however many copies a title
    has, it enters the comparison once for each block. A cell is named by 128 bits.
    """
    rows = rows.where(F.col("at").isNotNull() & (F.size("words") > 0)).withColumn("block", F.floor(F.col("at") / life).cast("long"))
    name = F.sha2(F.concat_ws("\n", F.col("block").cast("string"), F.array_join("words", " ")), 256)
    return rows.withColumn("cell", F.unhex(F.substring(name, 1, 32)))


def ordered_words(found: DataFrame) -> DataFrame:
    """(cell, n, words) of cells (cell, words): the words of each, those of the fewest cells first."""
    said = found.select("cell", F.explode("words").alias("word"))
    among = written(said.groupBy("word").agg(F.count(F.lit(1)).alias("among")), "among")
    entries = F.sort_array(F.collect_list(F.struct("among", "word")))
    ordered = said.join(among, "word").groupBy("cell").agg(entries.alias("w"))
    return ordered.select("cell", F.size("w").alias("n"), F.col("w.word").alias("words"))


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) of cells whose whole sets of words are similar."""
    whole = lambda c: sets.select(F.col("cell").alias(c), F.col("words").alias(f"{c}_words"))
    both = F.size(F.array_intersect("a_words", "b_words"))
    return pairs.join(whole("a"), "a").join(whole("b"), "b").where((100 + percent) * both >= percent * (F.size("a_words") + F.size("b_words"))).select("a", "b")


def similar_cells(found: DataFrame, percent: int = PERCENT, life: int = LIFE) -> DataFrame:
    """(node, component) of cells (cell, block, first, last, words) that are linked: similar words, in one block or in two in a row that are near enough.

    Two sets with `percent` of their union in common share one of the first words of
    each, n - ceil(n * percent / 100) + 1 of them, when both have their words in one
    order. Rare words come first, so a common word is looked up only for titles that have
    few others. A pair must also fit in size, and by the places of the word that they
    share; what is left is compared whole.

    Cells that share a block and a word are first compared with one of them, the hub.
    Only pairs that this leaves in different components are then made, so a group of
    near copies costs as many comparisons as it has cells.
    """
    sets = written(ordered_words(found.select("cell", "words")), "ordered")
    prefix = F.slice("words", F.lit(1), F.expr(f"n - (n * {percent} + 99) div 100 + 1").cast("int"))
    said = sets.select("cell", "n", F.posexplode(prefix).alias("place", "word"))
    said = written(said.join(found.drop("words"), "cell").select("block", "word", "cell", "n", (F.col("place") + 1).alias("place"), "first", "last"), "prefixes")
    near = f"(home = block AND cell < b OR home > block AND b_first - last <= {life})"
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m) AND {100 + percent} * (1 + least(n - place, m - b_place)) >= {percent} * (n + m)"

    def other(rows: DataFrame, *more: str) -> DataFrame:
        """The second of a pair: each cell in its own block and in the one before."""
        rows = rows.select("word", F.col("block").alias("home"), F.col("cell").alias("b"), F.col("n").alias("m"), F.col("place").alias("b_place"), F.col("first").alias("b_first"), *more)
        return rows.withColumn("block", F.explode(F.array(F.col("home"), F.col("home") - 1)))

    hub = said.groupBy("block", "word").agg(F.min(F.struct("cell", "n", "place", "first", "last")).alias("hub")).select("block", "word", "hub.*")
    star = written(hub.join(other(said), ["block", "word"]).where(f"{near} AND {fits}").select(F.col("cell").alias("a"), "b").distinct(), "star")
    links = written(_alike(star, sets, percent), "links")
    known = written(components(links), "known")
    label = lambda rows: rows.join(known.withColumnRenamed("node", "cell"), "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    said = written(label(said), "labelled")
    apart = said.join(other(said, F.col("component").alias("b_component")), ["block", "word"]).where(f"component <> b_component AND {near} AND {fits}")
    pairs = written(apart.select(F.col("cell").alias("a"), "b").distinct().join(star, ["a", "b"], "left_anti"), "pairs")
    return joined_components(known, written(_alike(pairs, sets, percent), "more_links"))


def similar_topics(rows: DataFrame, percent: int = PERCENT, life: int = LIFE) -> DataFrame:
    """(id, topic, coverage) of rows (id, at, words): the rows that are linked with another, directly or through others.

    Rows are linked where 100 * common words >= percent * words of either, and at most
    `life` seconds apart; topic is the least id that links reach, coverage its rows. Rows
    without a time or without words have no topic. Rows of one id count for themselves.
    An empty table gives no rows.
    """
    marked = written(cells(rows, life), "cells")
    found = marked.groupBy("cell", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.first("words").alias("words"))
    linked = similar_cells(written(found, "found"), percent, life)
    member = marked.select("id", "cell").join(linked.withColumnRenamed("node", "cell"), "cell", "left").select("id", F.coalesce("component", "cell").alias("component"))
    member = written(member, "members")
    topics = written(member.groupBy("component").agg(F.min("id").alias("topic"), F.count(F.lit(1)).alias("coverage")).where("coverage > 1"), "topics")
    return member.join(topics, "component").select("id", "topic", "coverage")
