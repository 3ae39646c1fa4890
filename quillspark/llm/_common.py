"""Shared pieces of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: Bytes of text that one step inside a task looks at together.
SLICE_BYTES = 1 << 20
#: Bits of a filter of keys, 8 MB at most whatever the keys; of 2 million keys it lets 3 in 100 others through.
FILTER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text), so that other columns of df cannot clash; null text stays null."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batch: pa.RecordBatch, *columns: str, most: int = SLICE_BYTES):
    """Cut an Arrow batch so that each part has about `most` bytes in the columns (text), one row at least."""
    if not batch.num_rows:
        return
    found = [batch.column(batch.schema.get_field_index(c)) for c in columns or ("text",)]
    lengths = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in found)
    if lengths.sum() <= most:
        yield batch
        return
    start, size = 0, 0
    for i, x in enumerate(lengths):
        if size and size + x > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(x)
    yield batch.slice(start)


def _joined_to_bits(df: DataFrame, keys: DataFrame, columns: tuple[str, ...], how: str) -> DataFrame:
    place = F.pmod(F.xxhash64(*[F.col(c).cast("long") for c in columns]), F.lit(FILTER_BITS)) + 1
    places = keys.select(place.alias("_place")).select("_place", F.bitmap_bucket_number("_place").alias("_bucket")).repartition("_bucket")
    bits = places.groupBy("_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring(bits["_bits"], (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = (F.bitmap_bucket_number("_place") == bits["_bucket"]) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return df.withColumn("_place", place).join(F.broadcast(bits), hit, how).drop("_place")


def may_match(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of df whose columns (numbers) may be in keys, the others left out before they are shuffled.

    All that are in keys stay, and a few others: a bitmap of hashes is broadcast, which
    has FILTER_BITS bits for any number of keys.
    """
    return _joined_to_bits(df, keys, columns, "left_semi")


def cannot_match(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows of df that may_match() leaves out."""
    return _joined_to_bits(df, keys, columns, "left_anti")


def without(df: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Rows of df whose columns (numbers) are not in gone, nulls being equal; rows that cannot be in gone are not shuffled."""
    other = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in columns]).distinct().hint("merge")
    rest = may_match(df, gone, *columns)
    rest = rest.join(other, [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in columns], "left_anti")
    return cannot_match(df, gone, *columns).unionByName(rest)


_HELD: dict[tuple, object] = {}


def held(key: tuple, make):
    """What make() gives, kept in this worker until it is asked for something else: one model at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Free the model that this worker keeps; for steps that need the memory themselves."""
    _HELD.clear()
