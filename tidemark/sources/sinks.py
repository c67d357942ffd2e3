"""Keyed writes as DataFrame functions: what to store, given what is stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.functions.numeric import total

MARKET_TRACKED = ["prices", "liquidity", "volume", "volume_24h", "spread", "best_bid", "best_ask",
                  "closed", "resolved", "accepting_orders", "question", "end_ts", "kickoff_ts",
                  "sports_market_type", "league"]
SETTLED_TRACKED = ["realized_pnl", "won"]


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows replaced or extended by the incoming ones (SNK-1)."""
    kept = stored.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is new, one per key (SNK-2)."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def changed_rows(stored: DataFrame, incoming: DataFrame, keys: list[str],
                 tracked: list[str]) -> DataFrame:
    """Incoming rows that are new or differ on a tracked column (SNK-3)."""
    before = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in tracked],
                           F.lit(True).alias("_known"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in tracked])
    joined = incoming.join(before, keys, "left")
    return joined.where(F.col("_known").isNull() | ~same).drop("_known", *[f"_{c}" for c in tracked])


def replace_all(stored: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that this pass produced again; the others are dropped (SET-3)."""
    return stored.join(produced.select(*keys), keys, "left_semi")


def market_snapshots(stored: DataFrame, incoming: DataFrame, last_snapshot: DataFrame, as_of: int,
                     cfg=None) -> DataFrame:
    """Markets worth a new snapshot: first, old, moved, or newly resolved (SNK-4)."""
    s = merge_config(cfg)["snapshot"]
    before = stored.select("market_id", F.col("prices").alias("_prices"),
                           F.col("liquidity").alias("_liquidity"), F.col("resolved").alias("_resolved"))
    joined = (incoming.join(before, "market_id", "left")
              .join(last_snapshot.select("market_id", F.col("captured_ts").alias("_last")),
                    "market_id", "left"))
    moves = F.zip_with("prices", "_prices", lambda a, b: F.abs(a - b) >= s["price_move"])
    price_moved = F.exists(F.filter(moves, lambda m: m.isNotNull()), lambda m: m)
    liquidity_moved = (F.col("_liquidity") > 0) & (
        F.abs(F.col("liquidity") - F.col("_liquidity")) / F.col("_liquidity") >= s["liquidity_move"])
    reason = (F.when(F.col("_resolved").isNull() | F.col("_last").isNull(), "FIRST")
              .when(as_of - F.col("_last") > s["max_age_seconds"], "AGE")
              .when(price_moved, "PRICE").when(liquidity_moved, "LIQUIDITY")
              .when(F.col("resolved") & ~F.col("_resolved"), "RESOLVED"))
    return joined.withColumn("snapshot_reason", reason).where(F.col("snapshot_reason").isNotNull()) \
        .withColumn("captured_ts", F.lit(as_of).cast("long")).drop("_prices", "_liquidity", "_resolved", "_last")


def position_snapshots(incoming: DataFrame, last_snapshot: DataFrame, keys: list[str], as_of: int,
                       cfg=None) -> DataFrame:
    """Positions worth a new snapshot: first, old, or resized (SNK-5)."""
    s = merge_config(cfg)["snapshot"]
    before = last_snapshot.select(*keys, F.col("size").alias("_size"), F.col("captured_ts").alias("_last"))
    joined = incoming.join(before, keys, "left")
    usable = F.col("_size") > 0
    moved = F.abs(F.col("size") - F.col("_size")) / F.col("_size") >= s["position_move"]
    wanted = (F.col("_last").isNull() | (as_of - F.col("_last") > s["max_age_seconds"])
              | ~F.coalesce(usable, F.lit(False)) | F.when(usable, moved))
    return joined.where(wanted).drop("_size", "_last").withColumn("captured_ts", F.lit(as_of).cast("long"))


def trader_snapshots(positions: DataFrame, closed: DataFrame, portfolio: DataFrame, as_of: int) -> DataFrame:
    """Open count, unrealized and realized sums per trader (SNK-6)."""
    live = positions.groupBy("trader_id").agg(F.count(F.lit(1)).alias("open_positions"),
                                              total("cash_pnl").alias("unrealized_pnl"))
    done = closed.groupBy("trader_id").agg(total("realized_pnl").alias("realized_pnl"))
    return (live.join(done, "trader_id", "full_outer").join(portfolio, "trader_id", "left")
            .fillna({"open_positions": 0}).withColumn("captured_ts", F.lit(as_of).cast("long")))


def close_vanished(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Previously open positions that are gone, as closed rows of size zero (SNK-7)."""
    return previous.join(current.select(*keys), keys, "left_anti").withColumns(
        {"size": F.lit(0.0), "is_open": F.lit(False)})


def resolution_stamp(markets: DataFrame, was_resolved: DataFrame, as_of: int) -> DataFrame:
    """Settlement time on the pass that first sees a market resolved: its end, but not ahead (FN-18)."""
    before = was_resolved.select("market_id", F.col("resolved_ts").alias("_stamp"),
                                 F.col("resolved").alias("_was"))
    joined = markets.drop("resolved_ts").join(before, "market_id", "left")
    fresh = F.col("resolved") & ~F.coalesce("_was", F.lit(False))
    stamp = F.when(fresh, F.least(F.coalesce("end_ts", F.lit(as_of)), F.lit(as_of))).otherwise(F.col("_stamp"))
    return joined.withColumn("resolved_ts", stamp).drop("_stamp", "_was")


def store_run(signals: DataFrame, run_id: str, kind: str, created_ts: int, path: str) -> None:
    """Append a backtest run's signals as its own partition (SNK-8)."""
    (signals.withColumns({"kind": F.lit(kind), "created_ts": F.lit(created_ts).cast("long"),
                          "run_id": F.lit(run_id)})
     .write.mode("append").partitionBy("run_id").parquet(path))


def list_runs(signals: DataFrame) -> DataFrame:
    """Stored runs, newest first (SNK-8)."""
    return signals.groupBy("run_id", "kind", "created_ts").agg(
        F.count(F.lit(1)).alias("signals")).orderBy(F.desc("created_ts"), "run_id")


def latest_runs(signals: DataFrame) -> DataFrame:
    """The newest run of each kind (SNK-8)."""
    return signals.groupBy("kind").agg(F.max_by("run_id", F.struct("created_ts", "run_id")).alias("run_id"))


def delete_run(spark: SparkSession, path: str, run_id: str) -> None:
    """Drop a stored run: its partition is its folder, so no other run is rewritten (SNK-8)."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run_id}")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
