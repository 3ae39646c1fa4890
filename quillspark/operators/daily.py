"""Daily totals, genre counts, topics and words."""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nested import sorted_map
from ..functions.text import is_latin

#: A topic needs so many members, and a word so many articles.
LEAST = 2
#: Up to so many words stand in the plan as literals.
LITERALS = 64
#: Words of one automaton; a larger vocabulary is looked up in several scans.
AUTOMATON_WORDS = 100_000


def totals(df: DataFrame, day: str = "day", source: str = "source") -> DataFrame:
    """(day, articles, media): rows and distinct sources of each day."""
    return df.groupBy(day).agg(F.count(F.lit(1)).alias("articles"), F.count_distinct(source).alias("media"))


def genre_rollup(df: DataFrame, day: str = "day", genre: str = "genre") -> DataFrame:
    """Counts for (day, genre) and, where genre is null, for the day."""
    return df.groupingSets([[F.col(day), F.col(genre)], [F.col(day)]], day, genre).agg(F.count(F.lit(1)).alias("articles"))


def topics(df: DataFrame, keys: list[str], member: str = "id") -> DataFrame:
    """(keys, coverage) of groups with LEAST members or more."""
    return df.groupBy(*keys).agg(F.count(member).alias("coverage")).where(F.col("coverage") >= LEAST)


def genre_topics(df: DataFrame, day: str = "day", genre: str = "genre", topic: str = "topic") -> DataFrame:
    """(day, genre, articles, topics): rows, and topics that have LEAST rows or more in that genre."""
    parts = df.groupBy(day, genre, topic).agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy(day, genre).agg(F.sum("n").alias("articles"), F.count_if(F.col("n") >= LEAST).alias("topics"))


def heat(df: DataFrame, day: str = "day", genre: str = "genre", score: str = "score") -> DataFrame:
    """(day, genre, heat): two-decimal sum of the topics' scores, summed in whole cents so that order does not matter."""
    cents = F.sum(F.round(F.col(score) * 100).cast("long"))
    return df.groupBy(day, genre).agg((F.coalesce(cents, F.lit(0)) / 100).alias("heat"))


def count_map(df: DataFrame, key: str, by: str = "day") -> DataFrame:
    """(by, counts): a map of counts with its keys in order."""
    return df.groupBy(by, key).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(sorted_map(F.col(key), F.col("n")).alias("counts"))


def _by_literals(df: DataFrame, words: list[str], text: str, keep: tuple[str, ...]) -> DataFrame:
    """match_words() by built-in expressions: whole runs of letters by set, other words one by one."""
    latin, other = ([w for w in words if is_latin(w) == flag] for flag in (True, False))
    array = lambda items: F.array(*[F.lit(w) for w in items]).cast("array<string>")
    runs = F.array_intersect(F.split(F.col(text), "[^A-Za-z]+"), array(latin))
    inside = F.array_compact(F.array(*[F.when(F.col(text).contains(w), F.lit(w)) for w in other])) if other else array([])
    found = df.where(F.col(text).isNotNull()).select(*keep, F.concat(runs, inside).alias("found"))
    return found.select(*keep, F.explode("found").alias("word"))


def _by_automaton(df: DataFrame, words: list[str], text: str, keep: tuple[str, ...]) -> DataFrame:
    """match_words() by one pass of an Aho-Corasick automaton over each text."""
    shared = df.sparkSession.sparkContext.broadcast(words)
    letters = frozenset(string.ascii_letters)

    def found(machine: ahocorasick.Automaton, said: str) -> list[str]:
        out = set()
        for end, (word, whole) in machine.iter(said):
            inside = whole and (said[end + 1 : end + 2] in letters or (end >= len(word) and said[end - len(word)] in letters))
            if not inside:
                out.add(word)
        return list(out)

    @F.pandas_udf("array<string>")
    def match(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = ahocorasick.Automaton()
        for word in shared.value:
            machine.add_word(word, (word, is_latin(word)))
        machine.make_automaton()
        for part in texts:
            yield pd.Series([found(machine, t) for t in part.fillna("")])

    return df.select(*keep, F.explode(match(F.col(text))).alias("word"))


def match_words(df: DataFrame, words: DataFrame, text: str = "text", keep: tuple[str, ...] = (), literals: int = LITERALS, most: int = AUTOMATON_WORDS) -> DataFrame:
    """(keep, word) for each row and word of words (word) that stands in its text, once.

    Words of Latin letters match whole runs of letters, others anywhere. Words of
    one character match nothing; a word inside another matches too. Null texts and
    null words match nothing.

    Each text is read once for each `most` words or so: by built-in expressions where the
    vocabulary has no more than `literals` words, else by an automaton. Only the words
    of one scan are on the driver and broadcast, and texts are never shuffled.
    """
    words = words.select("word").where(F.length("word") >= 2).distinct()
    parts = max(1, -(-words.count() // most))
    found = None
    for k in range(parts):
        mine = words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == k) if parts > 1 else words
        some = sorted(w for (w,) in mine.collect())
        scan = (_by_literals if len(some) <= literals else _by_automaton)(df, some, text, keep)
        found = scan if found is None else found.unionByName(scan)
    return found


def word_counts(matched: DataFrame, source: str = "source", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, word, articles, media) of words in LEAST rows or more."""
    counted = matched.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("articles"), F.count_distinct(source).alias("media"))
    return counted.where(F.col("articles") >= LEAST)


def word_order(counted: DataFrame) -> DataFrame:
    """Most articles first, then by the root collation."""
    return counted.orderBy(F.desc("articles"), F.expr("word COLLATE UNICODE"))


def new_words(df: DataFrame, day: str = "day", word: str = "word") -> DataFrame:
    """(word, first_day): the first day on which a word has LEAST rows or more."""
    return df.groupBy(word, day).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).groupBy(word).agg(F.min(day).alias("first_day"))


__all__ = ["LEAST", "count_map", "genre_rollup", "genre_topics", "heat", "is_latin", "match_words", "new_words", "topics", "totals", "word_counts", "word_order"]
