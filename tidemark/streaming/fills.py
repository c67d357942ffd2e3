"""Streaming counterparts of the fill ingest, the tape windows and the position replay."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.replay import replay_positions
from tidemark.session import cut_lineage, release, with_settings, without_leftovers

HOLDING = ["trader_id", "market_id", "outcome_index"]


def landed_fills(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Fill files as they land, with an event-time column."""
    rows = (spark.readStream.schema(schemas.FILLS).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))
    return rows.withColumn("occurred_at", F.timestamp_seconds("ts"))


def deduped(fills: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Each fill once, whatever pages it arrived on (STR-1). State is bounded by the lateness."""
    return fills.withWatermark("occurred_at", lateness).dropDuplicatesWithinWatermark(["dedupe_key"])


def tape_windows(fills: DataFrame, length: str = "1 hour", slide: str | None = "5 minutes",
                 lateness: str | None = "10 minutes") -> DataFrame:
    """Fills and USD per side in sliding windows; rows later than the watermark are dropped (STR-2).

    ``lateness`` is None for fills that carry a watermark already, as deduplicated ones do.
    """
    window = F.window("occurred_at", length, slide) if slide else F.window("occurred_at", length)
    timed = fills if lateness is None else fills.withWatermark("occurred_at", lateness)
    return (timed
            .groupBy(window.alias("_w"), "market_id", "outcome_index")
            .agg(F.count(F.lit(1)).alias("fills"), F.sum(F.col("size") * F.col("price")).alias("usd"),
                 F.sum("size").alias("shares"))
            .select("market_id", "outcome_index", F.unix_seconds("_w.start").alias("window_start"),
                    F.unix_seconds("_w.end").alias("window_end"), "fills", "usd",
                    F.try_divide("usd", "shares").alias("vwap")))


# --- state that a trigger rewrites ------------------------------------------------------------------
def _drop(spark: SparkSession, path: str) -> None:
    """Remove a folder that no trigger needs any more, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _mark(spark: SparkSession, path: str, number: int, newest: int | None, versions: dict[int, int]) -> None:
    """What a trigger leaves: the newest time so far, and for each bucket the trigger that wrote it."""
    spark.createDataFrame([(newest, versions)], "newest long, versions map<int,int>").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/mark/batch={number}")


def _marked(spark: SparkSession, path: str, number: int) -> tuple[int | None, dict[int, int]]:
    if number < 0:
        return None, {}
    row = spark.read.parquet(f"{path}/mark/batch={number}").first()
    return row["newest"], row["versions"]


def _last(spark: SparkSession, path: str) -> int:
    """The number of the last trigger, -1 before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/mark")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return -1
    return max((int(f.getPath().getName().split("=")[1]) for f in files.listStatus(folder)
                if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))), default=-1)


def _once(fills: DataFrame, lateness: str) -> DataFrame:
    """Dated fills once each; those without a time pass as they are, to be kept aside."""
    dated = fills.where(F.col("ts").isNotNull())
    return deduped(dated, lateness).unionByName(fills.where(F.col("ts").isNull()))


#: A trigger starts from the keys that the one before it left; older ones are of no use.
RETAINED = {"spark.sql.streaming.minBatchesToRetain": "2", "spark.sql.streaming.stateStore.maintenanceInterval": "10s"}


def _start(fills: DataFrame, path: str, checkpoint: str, lateness: int, advance):
    """Run ``advance(batch, number)`` for what is available. Fills without a time go to ``path``/undated."""
    def step(batch: DataFrame, number: int) -> None:
        arrived = cut_lineage(batch.drop("occurred_at"))
        arrived.where("ts is null").write.mode("overwrite").parquet(f"{path}/undated/batch={number}")
        with without_leftovers(arrived.sparkSession):
            advance(arrived.where("ts is not null"), number)
        release(arrived)
        arrived.sparkSession._jvm.System.gc()  # the stream's own shuffle files go when its last trigger is collected

    with with_settings(fills.sparkSession, RETAINED):
        return (_once(fills, f"{lateness} seconds").writeStream.foreachBatch(step)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def undated(spark: SparkSession, path: str) -> DataFrame:
    """The fills without a time that were kept aside, each key once."""
    return spark.read.schema(schemas.FILLS).parquet(f"{path}/undated").dropDuplicates(["dedupe_key"])


def _tidy(spark: SparkSession, path: str, kind: str, number: int) -> None:
    """Remove what only triggers before the last one needed."""
    _drop(spark, f"{path}/{kind}/batch={number - 2}")
    _drop(spark, f"{path}/mark/batch={number - 3}")


def _latest(*times: int | None) -> int | None:
    return max((t for t in times if t is not None), default=None)


WINDOW = "market_id long, outcome_index int, window_start long, window_end long, fills long, usd double, shares double"


#: Window lengths that one task takes of a side.
SPANS = 24


def _seconds(spark: SparkSession, length: str) -> float:
    micros = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {length.strip().lower().removeprefix('interval')}"))
    return spark.range(1).select(micros).first()[0] / 1e6


def _window_sums(batch: DataFrame, before: DataFrame | None, length: str, slide: str | None) -> DataFrame:
    """Sums per side and window of a batch of fills and of the open windows ``before``, in order of side and window.

    Fills are summed per pane first, the stretch in which all fills have the same windows. Panes, not the
    windows they belong to, are shuffled: each to the task that has the side's windows of ``SPANS`` lengths.
    """
    spark = batch.sparkSession
    long, step = _seconds(spark, length), _seconds(spark, slide or length)
    whole = long == int(long) and step == int(step)
    pane = math.gcd(int(long), int(step)) if whole else 1  # fills have whole seconds
    span = F.lit(SPANS * math.ceil(long))
    side, sums = ["market_id", "outcome_index"], ("fills", "usd", "shares")
    panes = batch.groupBy(*side, (F.floor(F.col("ts") / F.lit(pane)) * pane).alias("_pane")).agg(
        F.count(F.lit(1)).alias("fills"), F.sum(F.col("size") * F.col("price")).alias("usd"), F.sum("size").alias("shares"))
    at = F.col("_pane")
    parts = panes.withColumn("_part", F.explode(F.array_distinct(F.array(
        F.floor((at - math.ceil(long)) / span), F.floor(at / span))))).repartition(*side, "_part")
    if whole and step <= long:  # rows stay where they were dealt; Spark's window() doesn't keep track of that
        first = F.floor((at - int(long)) / F.lit(int(step))) + 1
        starts = F.explode(F.transform(F.sequence(first, F.floor(at / F.lit(int(step)))), lambda k: k * int(step)))
        placed = parts.select(*side, "_part", starts.alias("window_start"), *sums).withColumn("window_end", F.col("window_start") + int(long))
    else:
        time = F.timestamp_seconds("_pane")
        placed = parts.withColumn("_w", F.window(time, length, slide) if slide else F.window(time, length)).select(
            *side, "_part", F.unix_seconds("_w.start").alias("window_start"), *sums, F.unix_seconds("_w.end").alias("window_end"))
    of = F.floor(F.col("window_start") / span)
    placed = placed.where(of == F.col("_part"))
    if before is not None:
        placed = placed.unionByName(before.withColumn("_part", of).repartition(*side, "_part"))
    added = placed.groupBy(*side, "_part", "window_start", "window_end").agg(*[F.sum(c).alias(c) for c in sums]).drop("_part")
    return added.sortWithinPartitions(*side, "window_start")


def store_windows(fills: DataFrame, path: str, checkpoint: str, lateness: int, length: str = "1 hour",
                  slide: str | None = "5 minutes"):
    """Sums per side and window, kept under ``path``, one row for each window (STR-2).

    Fills are taken once each if copies come within ``lateness`` seconds. A trigger adds its sums to the
    open windows of the trigger before; those that no fill can reach any more are written out once, the
    others are the open windows of the next trigger. So a trigger reads what is open and no more, and
    may be run again. Fills without a time are in ``undated``.
    """
    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _marked(spark, path, number - 1)[0]
        newest = _latest(before, batch.agg(F.max("ts")).first()[0])
        open_ = spark.read.schema(WINDOW).parquet(f"{path}/open/batch={number - 1}") if number else None
        sums = cut_lineage(_window_sums(batch, open_, length, slide))
        over = F.col("window_end") <= F.lit((newest or 0) - lateness)
        packed = {"compression": "zstd"}
        sums.where(over).write.options(**packed).mode("overwrite").parquet(f"{path}/closed/batch={number}")
        sums.where(~over).write.options(**packed).mode("overwrite").parquet(f"{path}/open/batch={number}")
        release(sums)
        _mark(spark, path, number, newest, {})
        _tidy(spark, path, "open", number)

    return _start(fills, path, checkpoint, lateness, advance)


def windows(spark: SparkSession, path: str) -> DataFrame:
    """Every window as of the last trigger, the open ones included; the columns of ``tape_windows``."""
    last = _last(spark, path)
    if last < 0:
        stored = spark.createDataFrame([], WINDOW)
    else:
        # A trigger that was cut short may have written folders beyond the last mark.
        stored = spark.read.schema(f"{WINDOW}, batch int").parquet(f"{path}/closed").where(F.col("batch") <= last).drop(
            "batch").unionByName(spark.read.schema(WINDOW).parquet(f"{path}/open/batch={last}"))
    return stored.select("market_id", "outcome_index", "window_start", "window_end", "fills", "usd",
                         F.try_divide("usd", "shares").alias("vwap"))


POSITION = "trader_id long, market_id long, outcome_index int, shares double, cost_usd double, first_buy_ts long"
EARLIEST = -(1 << 60)


def _replayed(before: DataFrame, fills: DataFrame) -> DataFrame:
    """The holdings that ``fills`` touch, from what was held before. A holding stands in as one buy."""
    touched = fills.select(*HOLDING).distinct()
    kept = before.join(touched, HOLDING, "left_semi")
    stood = kept.where(F.col("shares") > 0).select(
        *HOLDING, F.lit("BUY").alias("side"), F.col("shares").alias("size"), F.col("cost_usd").alias("usd"),
        F.lit(EARLIEST).alias("ts"), F.lit("").alias("dedupe_key"))
    every = stood.unionByName(fills.select(stood.columns))
    ends = every.groupBy("market_id").agg(F.max("ts").alias("signal_ts"))
    known = kept.select(*HOLDING, F.col("first_buy_ts").alias("_known"))
    now = replay_positions(every, ends, min_shares=-1.0, min_cost=-1.0)
    first = F.when(F.col("first_buy_ts") > EARLIEST, F.col("first_buy_ts"))
    return now.join(known, HOLDING, "left").select(
        *HOLDING, "shares", "cost_usd", F.coalesce("_known", first).alias("first_buy_ts"))


def _held(spark: SparkSession, path: str, versions: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
    """The holdings of some buckets, or of all, as the trigger that ``versions`` belongs to left them."""
    folders = [f"{path}/held/batch={v}/bucket={b}" for b, v in versions.items() if buckets is None or b in buckets]
    return spark.read.schema(POSITION).parquet(*folders) if folders else spark.createDataFrame([], POSITION)


def store_positions(fills: DataFrame, path: str, checkpoint: str, lateness: int, buckets: int = 64):
    """Shares and remaining cost per holding, kept under ``path`` in hash buckets (STR-3).

    Fills are taken once each. Those within ``lateness`` seconds of the newest wait, since earlier ones
    may still arrive; the others are applied in time order to what was held. A trigger reads and rewrites
    the buckets that its due fills fall into and no others, and may be run again: what it replaces stays
    until the next trigger is through. Fills without a time are in ``undated``.
    """
    bucket = F.pmod(F.xxhash64(*HOLDING), F.lit(buckets)).cast("int")

    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before, versions = _marked(spark, path, number - 1)
        arrived = batch
        if number:
            arrived = cut_lineage(batch.unionByName(
                spark.read.schema(batch.schema).parquet(f"{path}/waiting/batch={number - 1}")))
        newest = _latest(before, batch.agg(F.max("ts")).first()[0])
        due = F.col("ts") <= F.lit((newest or 0) - lateness)
        arrived.where(~due).write.mode("overwrite").parquet(f"{path}/waiting/batch={number}")
        ready = cut_lineage(arrived.where(due).withColumn("bucket", bucket))
        touched = sorted(r["bucket"] for r in ready.select("bucket").distinct().collect())
        after = dict(versions)
        if touched:
            held = _held(spark, path, versions, touched)
            moved = cut_lineage(_replayed(held, ready.drop("bucket")))
            now = held.join(moved, HOLDING, "left_anti").unionByName(moved).withColumn("bucket", bucket)
            now.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/held/batch={number}")
            written = spark.read.parquet(f"{path}/held/batch={number}").select("bucket").distinct()
            after |= {r["bucket"]: number for r in written.collect()}
            release(moved)
        release(ready, *([arrived] if number else []))
        _mark(spark, path, number, newest, after)
        _tidy(spark, path, "waiting", number)
        if number > 1:  # what the trigger before this one replaced
            for b, v in _marked(spark, path, number - 2)[1].items():
                if versions.get(b) != v:
                    _drop(spark, f"{path}/held/batch={v}/bucket={b}")

    return _start(fills, path, checkpoint, lateness, advance)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Every holding as of the last trigger, fills that still wait included."""
    last = _last(spark, path)
    if last < 0:
        return spark.createDataFrame([], POSITION)
    held = _held(spark, path, _marked(spark, path, last)[1])
    moved = cut_lineage(_replayed(held, spark.read.schema(schemas.FILLS).parquet(f"{path}/waiting/batch={last}")))
    return held.join(moved, HOLDING, "left_anti").unionByName(moved)


def append_to(df: DataFrame, path: str, checkpoint: str):
    """Run what is available into Parquet files and stop."""
    return (df.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())
