"""Keyed tables under a path, kept in buckets of their key: a pass rewrites only buckets it changes.

``rows/batch=<id>/bucket=<b>`` holds Spark's own bucketed Parquet files and ``versions/number=<n>`` names,
for each bucket, the batches that make it up. Scans of the rows are placed by key already, so a pass shuffles
what comes in and never what is stored. Batches are never changed: a pass writes new ones and then a version,
so one that was cut short left nothing that is read and can be run again. What a version replaced goes with
the pass after the next, so a reader has a pass's time. One writer at a time. Keys are not null: such rows fail the pass.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import cut_lineage
from tidemark.sources.sinks import changed_rows

#: A bucket made of more batches than this is written as one by the next pass that adds to it.
MOST_BATCHES = 16

Version = dict[int, list[str]]


@dataclass(frozen=True)
class Stored:
    """Where a table is, its columns, its key and how many buckets it has; none of them changes later."""

    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 64

    @property
    def bucket(self) -> Column:
        """The bucket that Spark places a key in."""
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _drop(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)


def _number(spark: SparkSession, table: Stored) -> int:
    """The newest complete version, -1 before the first pass."""
    files, place = _files(spark, f"{table.path}/versions")
    if not files.exists(place):
        return -1
    return max((int(f.getPath().getName().split("=")[1]) for f in files.listStatus(place)
                if files.exists(_files(spark, f"{f.getPath()}/_SUCCESS")[1])), default=-1)


def _version(spark: SparkSession, table: Stored, number: int) -> Version:
    if number < 0:
        return {}
    rows = spark.read.schema("bucket int, batches array<string>").parquet(f"{table.path}/versions/number={number}")
    return {r["bucket"]: r["batches"] for r in rows.collect()}  # one row a bucket


def _attached(spark: SparkSession, table: Stored) -> str:
    """The session's name for the rows, declared as a table so that Spark knows how they are placed."""
    name = f"stored_{hashlib.sha256(table.path.encode()).hexdigest()[:16]}"
    if spark.catalog.tableExists(name):
        spark.catalog.refreshTable(name)
        return name
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    keys = ", ".join(f"`{k}`" for k in table.keys)
    # Folders are found by listing: a catalog would have to be told of each.
    setting = "spark.sql.hive.manageFilesourcePartitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        spark.sql(f"CREATE TABLE {name} ({columns}, batch string, bucket int) USING parquet "
                  f"PARTITIONED BY (batch, bucket) CLUSTERED BY ({keys}) INTO {table.buckets} BUCKETS "
                  f"LOCATION '{table.path}/rows'")
    finally:
        spark.conf.set(setting, before)
    return name


def _rows(spark: SparkSession, table: Stored, version: Version) -> DataFrame:
    """The rows of a version, or of those of its buckets that are given."""
    of_batch: dict[str, list[int]] = {}
    for bucket, batches in version.items():
        for batch in batches:
            of_batch.setdefault(batch, []).append(bucket)
    wanted = reduce(lambda a, b: a | b, [(F.col("batch") == batch) & F.col("bucket").isin(buckets)
                                         for batch, buckets in of_batch.items()], F.lit(False))
    return spark.table(_attached(spark, table)).where(wanted).drop("batch", "bucket")


def read(spark: SparkSession, table: Stored) -> DataFrame:
    """The table as its last pass left it; empty before the first."""
    return _rows(spark, table, _version(spark, table, _number(spark, table)))


def _arrived(table: Stored, incoming: DataFrame) -> DataFrame:
    """Incoming rows with the table's types, written once; columns the table lacks are left out."""
    have = set(incoming.columns)
    checked = [F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"null key: {f.name}"))).otherwise(F.col(f.name))
               if f.name in table.keys else F.col(f.name) for f in table.schema.fields if f.name in have]
    types = [f for f in table.schema.fields if f.name in have]
    return cut_lineage(incoming.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(checked, types)]))


def _touched(table: Stored, rows: DataFrame) -> list[int]:
    """The buckets that rows fall in: at most as many as the table has."""
    return sorted(r["bucket"] for r in rows.select(table.bucket.alias("bucket")).distinct().collect())


def _write(spark: SparkSession, table: Stored, rows: DataFrame) -> str:
    batch = uuid.uuid4().hex
    name = _attached(spark, table)
    rows.select(*table.schema.names, F.lit(batch).alias("batch"), table.bucket.alias("bucket")).write.insertInto(name)
    return batch


def _commit(spark: SparkSession, table: Stored, number: int, version: Version) -> None:
    """Make a version the newest one and drop what only versions before the last one needed."""
    spark.createDataFrame(list(version.items()), "bucket int, batches array<string>").coalesce(1).write.mode(
        "overwrite").parquet(f"{table.path}/versions/number={number}")
    last = _version(spark, table, number - 1)
    for bucket, batches in _version(spark, table, number - 2).items():
        for batch in set(batches) - set(last.get(bucket, [])) - set(version.get(bucket, [])):
            _drop(spark, f"{table.path}/rows/batch={batch}/bucket={bucket}")
    if number > 2:
        _drop(spark, f"{table.path}/versions/number={number - 3}")


def upsert(table: Stored, incoming: DataFrame, tracked: list[str] | None = None) -> list[int]:
    """Replace or extend stored rows by incoming ones, one row for a key (SNK-1); the rewritten buckets.

    Columns that ``incoming`` lacks keep their stored value. With ``tracked``, rows that equal the stored
    one on these columns are left alone, and so are buckets in which no row differs (SNK-3). Of several
    incoming rows with one key any may win.
    """
    spark = incoming.sparkSession
    number = _number(spark, table)
    before = _version(spark, table, number)
    fresh = _arrived(table, incoming.dropDuplicates(list(table.keys)))
    if tracked is not None:
        stored = _rows(spark, table, before).select(*table.keys, *[c for c in tracked if c not in table.keys])
        fresh = cut_lineage(changed_rows(stored, fresh, list(table.keys), tracked))
    touched = _touched(table, fresh)
    if touched:
        old = _rows(spark, table, {b: before[b] for b in touched if b in before}).alias("old")
        new = fresh.withColumn("_new", F.lit(True)).alias("new")
        same = reduce(lambda a, b: a & b, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in table.keys])
        now = old.join(new, same, "full_outer").select(*[
            (F.when(F.col("_new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in fresh.columns
             else F.col(f"old.{c}")).alias(c) for c in table.schema.names])
        batch = _write(spark, table, now)
        _commit(spark, table, number + 1, before | {b: [batch] for b in touched})
    return touched


def insert_ignore(table: Stored, incoming: DataFrame) -> list[int]:
    """Add incoming rows whose key is new, one for a key (SNK-2); the buckets that grew.

    Rows are added as a batch beside those a bucket has. A bucket of ``MOST_BATCHES`` is rewritten as one.
    """
    spark = incoming.sparkSession
    number = _number(spark, table)
    before = _version(spark, table, number)
    arrived = _arrived(table, incoming.dropDuplicates(list(table.keys)))
    known = _rows(spark, table, before).select(*table.keys)
    fresh = cut_lineage(arrived.join(known, list(table.keys), "left_anti"))
    touched = _touched(table, fresh)
    if touched:
        full = {b: before[b] for b in touched if len(before.get(b, [])) >= MOST_BATCHES}
        added = fresh.unionByName(_rows(spark, table, full), allowMissingColumns=True) if full else fresh
        missing = {f.name: F.lit(None).cast(f.dataType) for f in table.schema.fields if f.name not in added.columns}
        batch = _write(spark, table, added.withColumns(missing) if missing else added)
        _commit(spark, table, number + 1,
                before | {b: [batch] if b in full else [*before.get(b, []), batch] for b in touched})
    return touched


def retain(table: Stored, produced: DataFrame) -> list[int]:
    """Drop stored rows whose key this pass didn't produce again (SET-3); the rewritten buckets."""
    spark = produced.sparkSession
    number = _number(spark, table)
    before = _version(spark, table, number)
    keys = list(table.keys)
    again = cut_lineage(produced.select(*[F.col(k).cast(table.schema[k].dataType).alias(k) for k in keys]).distinct())
    touched = _touched(table, _rows(spark, table, before).select(*keys).join(again, keys, "left_anti"))
    if touched:
        kept = _rows(spark, table, {b: before[b] for b in touched}).join(again, keys, "left_semi")
        batch = _write(spark, table, kept)
        _commit(spark, table, number + 1, before | {b: [batch] for b in touched})
    return touched


def close_vanished(table: Stored, current: DataFrame) -> list[int]:
    """Stored open rows that are gone from ``current`` become closed ones of size zero (SNK-7)."""
    keys = list(table.keys)
    gone = read(current.sparkSession, table).where("is_open").select(*keys).join(
        current.select(*keys), keys, "left_anti")
    return upsert(table, gone.withColumns({"size": F.lit(0.0), "is_open": F.lit(False)}))
