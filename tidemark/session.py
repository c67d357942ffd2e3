"""Session settings every job in this package expects."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Day, hour and month buckets are UTC buckets. Skewed keys are left to AQE wherever the plan is a
# plain fact-to-dimension join; the operators split hot groups themselves everywhere else.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "tidemark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the package settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable part of the settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def without_constraint_inference(spark: SparkSession):
    """Plan what is written inside this block without inferring constraints; restored afterwards.

    The score plans chain some hundred conditional columns. Inference over them costs the optimizer
    minutes and finds nothing that the operators do not filter for. Everywhere else it stays on.
    """
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Spark's switch for removing the shuffle files of an execution when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def with_settings(spark: SparkSession, settings: dict[str, str]):
    """Run what is inside this block under ``settings``; what was set before is restored afterwards."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def without_leftovers(spark: SparkSession):
    """Shuffle files of what is written inside this block go when the write has ended.

    Otherwise they stay on the executors' disks until the driver happens to collect its garbage. Only for
    writes: each has a plan of its own, which nothing runs again.
    """
    return with_settings(spark, {DROP_SHUFFLES: "true"})


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else beside the warehouse.

    Off a local master a path without a scheme is refused unless it was named, because every executor
    would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and (
            "://" not in warehouse and not warehouse.startswith(("hdfs:", "viewfs:"))):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/_shared"


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate data; it can go when the application has ended."""
    return f"{shared_folder(spark).rstrip('/')}/tidemark/{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several later steps need the same derived rows: they are computed once, each reader
    prunes to its own columns, real file sizes drive the join choices, and a lost executor only
    costs the step at hand. What was shuffled for them is dropped as soon as they are written.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    with without_leftovers(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*written: DataFrame) -> None:
    """Remove what ``cut_lineage`` wrote; nothing that is still to run may read it."""
    for df in written:
        path = df.__dict__.get("_written_to")
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of keys that are sent to all tasks.
MOST_SENT = 16 << 20


def among(rows: DataFrame, few: DataFrame, key: str, width: int = 16) -> DataFrame:
    """``rows`` joined with ``few``, which was written before and has one row of ``width`` bytes a key.

    Up to ``MOST_SENT`` bytes of keys are sent to all tasks, so rows of other keys go no further than the
    scan; with more keys both sides are shuffled.
    """
    return rows.join(F.broadcast(few) if few.count() * width <= MOST_SENT else few, key)
