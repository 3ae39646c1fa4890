"""A corpus pipeline over the training-data operators.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, and all but the last keep the columns of documents. Every
stage works on all that the one before it kept.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if str(Path(__file__).resolve().parent) not in sys.path:
    sys.path.insert(0, str(Path(__file__).resolve().parent))

from quillspark.llm import exact_dedup, minhash_dedup, packing, substring_dedup, toxicity
from quillspark.llm._common import materialize, table, without
from quillspark.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go. Null and empty texts are scored like any other; repeated rows share their text's outcome."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, whatever ids the rows have. Null and empty texts are equal; an empty table stays empty."""
    ship(spark)
    return exact_dedup.one_of_each(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more.

    Rows without id, and texts without words, stay; rows that share an id stay or go together.
    """
    ship(spark)
    decided = minhash_dedup.near_duplicates(docs, size=5, percent=80)
    return without(docs.select(*COLUMNS), materialize(decided.where("NOT kept AND doc_id IS NOT NULL").select("doc_id"), "gone"), "doc_id")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go; the other words stay as they are.

    n_chars becomes the new text's. A document of which nothing stays goes; null and
    empty texts and rows without id stay as they are.
    """
    ship(spark)
    return substring_dedup.rewrite(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens; a null or empty text is a piece of one token, the end."""
    ship(spark)
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: Learned scores, MinHash and packing have no SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
