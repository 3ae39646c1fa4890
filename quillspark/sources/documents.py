"""Readers and writers of the JSON documents and their table forms."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas
from .scratch import exists, file_system, written

#: A document that does not parse keeps its text here; its other columns are null.
BROKEN = "_corrupt_record"


def read_days(spark: SparkSession, path: str, schema: str = schemas.TREND) -> DataFrame:
    """One JSON object a file and day."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_months(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array a file and month, with the month of the file's name as a column."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("month", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2})", 1))


def read_listed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_months() with place, from 1 on in each file's array: times in a file are whole seconds, so only its order tells what is newer."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2})", 1).alias("month"), F.from_json("value", f"array<struct<{schema}>>").alias("rows"))
    return files.select("month", F.posexplode("rows").alias("at", "row")).select("row.*", "month", (F.col("at") + 1).alias("place"))


def files_between(spark: SparkSession, path: str, first: str, last: str) -> list[str]:
    """Paths of the files <name>.json below path whose names, days or months, lie between two others; from one listing, without opening any."""
    fs, root = file_system(spark, path)
    names = sorted(f.getPath().getName() for f in fs.listStatus(root))
    return [f"{path}/{n}" for n in names if n.endswith(".json") and first <= n.removesuffix(".json") <= last]


def read_between(spark: SparkSession, path: str, first: str, last: str, schema: str = schemas.TREND) -> DataFrame:
    """The day or month documents of a range, only their files read, with `file` and `broken`.

    A document that is cut off or no JSON is one row: its file's name, and its text in
    broken; of others broken is null. A range without files gives no rows.
    """
    files = files_between(spark, path, first, last)
    if not files:
        return spark.createDataFrame([], schema).withColumns({"file": F.lit(None).cast("string"), "broken": F.lit(None).cast("string")})
    rows = spark.read.schema(f"{schema}, {BROKEN} string").option("multiLine", True).option("columnNameOfCorruptRecord", BROKEN).json(files)
    return rows.withColumn("file", F.col("_metadata.file_name")).withColumnRenamed(BROKEN, "broken")


def read_map(spark: SparkSession, path: str, schema: str = schemas.FEED, key: str = "sourceId") -> DataFrame:
    """An object keyed by id as rows with the key as a column."""
    root = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{schema}>>").alias("m"))
    return root.select(F.explode("m").alias(key, "v")).select(key, "v.*")


def _name_files(spark: SparkSession, path: str) -> None:
    """path/<column>=<value>/part-* becomes path/<value>.json."""
    fs, root = file_system(spark, path)
    for status in fs.listStatus(root):
        if status.isDirectory():
            folder = status.getPath()
            parts = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen()]
            if len(parts) != 1:
                raise ValueError(f"{folder.getName()} has {len(parts)} documents")
            fs.rename(parts[0], root.suffix("/" + folder.getName().split("=", 1)[1] + ".json"))
            fs.delete(folder, True)


def write_named(df: DataFrame, path: str, name: str) -> None:
    """One JSON file, path/<value of name>.json, for each row of df; no two rows may have one name.

    Executors write the files; the driver only renames them, one for each day or month.
    """
    df.write.mode("overwrite").partitionBy(name).json(path)
    _name_files(df.sparkSession, path)


def write_arrays(df: DataFrame, path: str, name: str, rows: str) -> None:
    """write_named() for files whose root is an array: the column rows holds the objects of the file."""
    df.select(name, F.to_json(rows)).write.mode("overwrite").partitionBy(name).text(path)
    _name_files(df.sparkSession, path)


def genre_days(trends: DataFrame) -> DataFrame:
    return trends.select("date", F.explode("genres").alias("genre", "v")).select("date", "genre", "v.*")


def word_days(trends: DataFrame) -> DataFrame:
    return trends.select("date", F.explode("words").alias("word", "v")).select("date", "word", "v.*")


def topic_days(trends: DataFrame) -> DataFrame:
    """Topics with their rank, the place in the day's list from 1 on."""
    return trends.select("date", F.posexplode("top").alias("place", "v")).select("date", (F.col("place") + 1).alias("rank"), "v.*")


def popularity(popular: DataFrame) -> DataFrame:
    """(window, id, n) of both windows."""
    part = lambda w: popular.select(F.lit(w).alias("window"), F.explode(w).alias("v")).select("window", "v.*")
    return part("day").unionByName(part("week"))


def publish(df: DataFrame, path: str, by: str = "date") -> None:
    """Rewrite the partitions that df has rows of; the others stay. One exchange keeps files few; a large day is split over tasks."""
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old with what is set in new's row of the same key; rows of new keys are added.

    Validators and times that a reply leaves out (null in new) stay as they were. new
    may have several rows of a key if order names one of its columns: then each field
    is the one set last. Rows without key are added as they are.
    """
    if order:
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
        new = new.where(F.col(key).isNotNull()).groupBy(key).agg(*[last(c) for c in new.columns if c != key]).select(*new.columns).unionByName(new.where(F.col(key).isNull()))
    fresh = new.select(*[F.col(c).alias(f"new_{c}") for c in new.columns])
    joined = old.join(fresh, F.col(key) == F.col(f"new_{key}"), "full_outer")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns])


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str, order: str | None = None, buckets: int = 256) -> None:
    """upsert() into the table below path, which is partitioned by a hash of the key; made where it is not there yet.

    Only buckets that new has keys of are read and written; the files of the others are
    left as they are. `buckets` is the same in every run.
    """
    names = new.columns
    in_bucket = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    new = written(in_bucket(new), "replies")
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).join(new.select("bucket").distinct(), "bucket", "left_semi")
    else:
        old = new.limit(0)
    publish(written(in_bucket(upsert(old.select(*names), new.select(*names), key, order)), "upserted"), path, "bucket")


def publish_version(df: DataFrame, path: str, updated: dt.datetime, keep: int = 2) -> str:
    """Write df as a version of the table below path; readers see it whole or not at all.

    Files go to versions/<name>. One rename then puts manifests/<name> in place, and the
    greatest name is the current one: names begin with the time of update, so a run with
    an older one never takes the place of a newer, whichever ends first. A write that
    fails leaves no manifest. Of older versions all but `keep` in all are removed.
    """
    spark = df.sparkSession
    name = f"{updated:%Y%m%dT%H%M%S.%fZ}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/versions/{name}")
    fs, started = file_system(spark, f"{path}/manifests/.{name}")
    fs.create(started).close()
    if not fs.rename(started, started.getParent().suffix(f"/{name}")):
        raise OSError(f"the manifest {name} could not be put in place")
    for old in _manifests(spark, path)[:-keep]:
        for folder in ("manifests", "versions"):  # first what readers look for
            fs.delete(file_system(spark, f"{path}/{folder}/{old}")[1], True)
    return name


def _manifests(spark: SparkSession, path: str) -> list[str]:
    fs, root = file_system(spark, f"{path}/manifests")
    return sorted(n for f in (fs.listStatus(root) if fs.exists(root) else []) if not (n := f.getPath().getName()).startswith("."))


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The current version of publish_version(), with its time as `updated`."""
    name = _manifests(spark, path)[-1]
    updated = dt.datetime.strptime(name.split("-")[0], "%Y%m%dT%H%M%S.%fZ")
    return spark.read.parquet(f"{path}/versions/{name}").withColumn("updated", F.lit(updated.isoformat(sep=" ")).cast("timestamp_ntz"))


def enqueue(log: DataFrame, request: DataFrame) -> DataFrame:
    """A request log with more requests, newest first."""
    return log.unionByName(request).orderBy(F.desc("requestedAt"), "id")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    best = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")
