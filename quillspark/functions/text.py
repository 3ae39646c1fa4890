"""Text functions, all of them built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCERPT = 120


def excerpt(text: Column, most: int = EXCERPT) -> Column:
    """Text of at most `most` characters; a longer one ends in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def host(url: Column) -> Column:
    """Host of a URL without port, lower case; null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.when(found != "", found))


def is_latin(word: str) -> bool:
    return re.fullmatch(r"[A-Za-z]+", word) is not None


def contains_word(text: Column, word: str) -> Column:
    """Substring match; a word of Latin letters must not stand inside a longer one."""
    if is_latin(word):
        return text.rlike(rf"(^|[^A-Za-z]){word}([^A-Za-z]|$)")
    return text.contains(word)


def error_class(error: Column) -> Column:
    """timeout, http-NNN, xml, feed or other; null for null."""
    low = F.lower(error)
    status = F.regexp_extract(low, r"http[^0-9]{0,8}([1-5][0-9][0-9])", 1)
    return (
        F.when(error.isNull(), F.lit(None).cast("string"))
        .when(low.rlike("timed? ?out|timeout"), "timeout")
        .when(status != "", F.concat(F.lit("http-"), status))
        .when(low.rlike("xml|entity|unclosed|tag"), "xml")
        .when(low.rlike("feed"), "feed")
        .otherwise("other")
    )
