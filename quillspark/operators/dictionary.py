"""A dictionary that grows from texts, whose words need no separators between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .daily import match_words, new_words

#: A word occurs so often, and has so many letters at most.
LEAST, LONGEST = 20, 6
#: Of the letters at either end of a word, the entropy in nats; and how much oftener its two parts stand together than by chance, however it is cut.
ENTROPY, COHESION = 0.8, 10.0
#: Places of a run of letters that one row has.
STEP = 256


def letter_pieces(df: DataFrame, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(n, own, piece): distinct runs of letters with their counts, cut to rows of STEP places.

    A piece has the letter before its first place, or a space, then its `own` places
    and what words that begin there can reach. Equal runs are one row, so a common
    word is cut and counted once.
    """
    runs = df.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1)).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    parts = runs.select("n", "run", F.posexplode(F.expr(f"sequence(0, length(run) - 1, {STEP})")).alias("part", "at"))
    return parts.select("n", F.expr(f"least({STEP}, length(run) - at)").alias("own"), F.expr(f"substring(concat(' ', run, ' '), at + 1, {STEP + longest + 1})").alias("piece"))


def _windows(pieces: DataFrame, longest: int) -> DataFrame:
    """(window, n): the letter before a place, or a space, then the `longest` letters from there and the next one, less where the run ends."""
    places = pieces.select("n", "piece", F.explode(F.expr("sequence(1, own)")).alias("p"))
    return places.groupBy(F.substring("piece", F.col("p"), F.lit(longest + 2)).alias("window")).agg(F.sum("n").alias("n"))


def _grams(windows: DataFrame, length: int, least: int) -> DataFrame:
    """(gram, total, entropy) of the grams of this length that occur at least `least` times.

    Of the letters before and after a gram the lesser entropy; each border of a run counts
    as a letter of its own.
    """
    rows = windows.select(F.substring("window", 2, length).alias("gram"), F.substring("window", 1, 1).alias("before"), F.substring("window", length + 2, 1).alias("after"), "n")
    rows = rows.where(~F.contains("gram", F.lit(" ")) & (F.length("gram") == length))
    sides = rows.select("gram", "n", F.posexplode(F.array("before", "after")).alias("side", "letter"))
    counted = sides.groupBy("gram", "side", "letter").agg(F.sum("n").alias("n"))
    part = F.when(F.col("letter") == " ", 0.0).otherwise(F.col("n") * F.log("n"))
    by_side = counted.groupBy("gram", "side").agg(F.sum("n").alias("total"), (F.log(F.sum("n")) - F.sum(part) / F.sum("n")).alias("entropy"))
    return by_side.where(F.col("total") >= least).groupBy("gram").agg(F.min("total").alias("total"), F.min("entropy").alias("entropy"))


def mine_words(df: DataFrame, text: str = "text", least: int = LEAST, longest: int = LONGEST, entropy: float = ENTROPY, cohesion: float = COHESION) -> DataFrame:
    """(word, n): strings of 2 to `longest` letters that behave as words, with how often they occur.

    A word occurs at least `least` times; the letters before and after it have at least
    `entropy` (to six places); and however it is cut in two, it is at least `cohesion`
    times as frequent as its parts are together by chance. Texts are read once: equal
    windows of letters are counted, and those of each length come from the counts of
    the next longer ones, so nothing is joined to places of the texts. Null and empty texts
    and texts without letters have no words; overlapping occurrences count; case is kept.
    """
    windows = written(_windows(letter_pieces(df, text, longest), longest), "windows")
    grams = []
    for length in range(longest, 0, -1):
        if length < longest:
            windows = written(windows.groupBy(F.substring("window", 1, length + 2).alias("window")).agg(F.sum("n").alias("n")), "windows")
        grams.append(written(_grams(windows, length, least if length > 1 else 1), "grams"))
    size = grams[-1].agg(F.sum("total")).first()[0] or 0
    counted = reduce(DataFrame.unionByName, grams).select("gram", "total")
    free = reduce(DataFrame.unionByName, grams[:-1]).where(F.round("entropy", 6) >= entropy)
    cuts = free.select("gram", "total", F.explode(F.expr("sequence(1, length(gram) - 1)")).alias("cut"))
    cuts = cuts.select("gram", "total", F.expr("substring(gram, 1, cut)").alias("head"), F.expr("substring(gram, cut + 1)").alias("tail"))
    cuts = cuts.join(counted.select(F.col("gram").alias("head"), F.col("total").alias("heads")), "head").join(counted.select(F.col("gram").alias("tail"), F.col("total").alias("tails")), "tail")
    bound = F.min(F.col("total").cast("double") / F.col("heads") / F.col("tails") * float(size)).alias("bound")
    return cuts.groupBy("gram", "total").agg(bound).where(F.col("bound") >= cohesion).select(F.col("gram").alias("word"), F.col("total").alias("n"))


def grow(df: DataFrame, text: str = "text", day: str = "day", known: DataFrame | None = None, **limits) -> DataFrame:
    """(word, n, first_day): the words of mine_words() by the day on which they came in.

    That is the first day with two texts or more that have the word, in the sense of
    match_words(). Words of known (word, n, first_day) stay as they are; a word never leaves.
    """
    mined = mine_words(df, text, **limits)
    if known is not None:
        mined = mined.join(known.select("word"), "word", "left_anti")
    mined = written(mined, "mined")
    days = written(new_words(match_words(df, mined, text, (day,)), day), "first_days")
    fresh = mined.join(days, "word").select("word", "n", "first_day")
    return fresh if known is None else known.select("word", "n", "first_day").unionByName(fresh)
