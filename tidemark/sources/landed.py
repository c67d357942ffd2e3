"""Scans of landed JSON files, nested arrays exploded, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.numeric import finite
from tidemark.operators.prefix import latest_n
from tidemark.session import cut_lineage


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def events(spark: SparkSession, path: str) -> DataFrame:
    """Events with nested markets and tags, and when they arrived (SRC-1).

    Files arrive in the order of their names, and lines in the order of the file.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start",
                     F.monotonically_increasing_id().alias("line"))
    return _json(spark, path, schemas.EVENTS).select("*", place.alias("arrival"))


def event_markets(events_df: DataFrame) -> DataFrame:
    """One row per market of an event, with the event's context (SRC-2)."""
    tags = F.filter(F.transform("tags", lambda t: F.coalesce(F.nullif(t["slug"], F.lit("")), t["label"])),
                    lambda t: F.length(t) > 0)
    return events_df.select(
        F.col("id").alias("event_id"), F.col("slug").alias("event_slug"),
        F.col("title").alias("event_title"), F.col("openInterest").alias("event_open_interest"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        F.col("arrival") if "arrival" in events_df.columns else F.lit(None).alias("arrival"),
        F.posexplode("markets").alias("at", "market")).withColumn(
        "arrival", F.struct("arrival", "at")).select("*", "market.*").drop("market", "at")


def markets_by_ids(open_markets: DataFrame, closed_markets: DataFrame, ids: DataFrame) -> DataFrame:
    """Markets of a set of condition ids, the open copy before the closed one (SRC-3)."""
    open_ = open_markets.join(ids.select("conditionId"), "conditionId", "left_semi")
    missing = closed_markets.join(ids.select("conditionId"), "conditionId", "left_semi")
    return open_.unionByName(missing.join(open_.select("conditionId"), "conditionId", "left_anti"))


def closed_markets(markets: DataFrame, from_ts: int, to_ts: int, limit: int | None = None) -> DataFrame:
    """Closed markets ending in a range, largest volume first (SRC-4)."""
    kept = markets.where(F.col("closed") & F.col("end_ts").between(from_ts, to_ts))
    ordered = kept.orderBy(F.desc_nulls_last("volume"), "market_id")
    return ordered if limit is None else ordered.limit(limit)


def positions(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.POSITIONS)  # SRC-5


def closed_positions(spark: SparkSession, path: str, per_wallet: int | None = None) -> DataFrame:
    """Settled positions, newest first, at most ``per_wallet`` each (SRC-6)."""
    rows = _json(spark, path, schemas.CLOSED_POSITIONS)
    if per_wallet is None:
        return rows
    return latest_n(rows, ["proxyWallet"], [F.desc_nulls_last("timestamp"), F.asc("asset")],
                    per_wallet, ["asset"])


def activity(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.ACTIVITY)


def new_activity(landed: DataFrame, stored: DataFrame, key: str, ts: str) -> DataFrame:
    """Landed rows at or past each key's newest stored time (SRC-7).

    The mark itself is kept: rows of its second may be missing, and storing skips duplicates.
    """
    marks = stored.groupBy(key).agg(F.max(ts).alias("_mark"))
    fresh = F.col("_mark").isNull() | (F.col(ts) >= F.col("_mark"))
    return landed.join(marks, key, "left").where(fresh).drop("_mark")


def store_activity(landed: DataFrame, path: str, key: str, ts: str, buckets: int = 64, days: int = 1) -> None:
    """Append landed rows by hash bucket of their key and span of ``days``, for ``activity_since`` to skip what is old.

    A folder is one bucket and one span, named by its first day: choose both so that it holds a file's
    worth of rows. Crowded ones are cut by size; rows without a time or a key have folders of their own.
    """
    span = F.floor(F.col(ts) / F.lit(days * 86400)) * F.lit(days)
    placed = landed.withColumns({"landed_bucket": _bucket(key, buckets), "landed_day": span})
    (placed.hint("rebalance", "landed_bucket", "landed_day").write.mode("append")
     .partitionBy("landed_bucket", "landed_day").parquet(path))


def _bucket(key: str, buckets: int):
    return F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets))).cast("int")


def high_water(asked: DataFrame, stored: DataFrame, key: str, ts: str) -> DataFrame:
    """The newest stored time of each asked key as ``mark``, null where nothing is stored."""
    marks = stored.groupBy(key).agg(F.max(ts).alias("mark"))
    return asked.select(key).distinct().join(marks, key, "left")


def activity_since(spark: SparkSession, path: str, marks: DataFrame, key: str, ts: str, buckets: int = 64,
                   days: int = 1) -> DataFrame:
    """Rows of ``store_activity`` at or past the mark of their key; a key without a mark gets all its rows (SRC-7).

    ``buckets`` and ``days`` are those the rows were stored with. Keys that ``marks`` lacks are not asked
    for. The lowest mark of each bucket bounds the days that are read, as a filter on folders, so a bucket
    is read back to its farthest key; then each key's own mark decides.
    """
    marks = cut_lineage(marks.select(key, "mark", _bucket(key, buckets).alias("_bucket")).where(F.col(key).isNotNull()))
    rows = spark.read.parquet(path)
    lows = marks.groupBy("_bucket").agg(F.min("mark").alias("low"), F.max(F.col("mark").isNull()).alias("all"))
    wanted = F.lit(False)
    for b in lows.collect():  # one row a bucket
        near = F.col("landed_bucket") == b["_bucket"]
        wanted = wanted | (near if b["all"] else near & (F.col("landed_day") >= b["low"] // (days * 86400) * days))
    fresh = F.col("mark").isNull() | (F.col(ts) >= F.col("mark"))
    return (rows.where(wanted).join(marks.select(key, "mark"), key).where(fresh)
            .drop("mark", "landed_bucket", "landed_day"))


def trades(spark: SparkSession, path: str, market: str | None = None, user: str | None = None,
           taker_only: bool = False) -> DataFrame:
    """The public fill tape, optionally of one market, one user or takers only (SRC-8)."""
    rows = _json(spark, path, schemas.TRADES)
    if market is not None:
        rows = rows.where(F.col("conditionId") == market)
    if user is not None:
        rows = rows.where(F.lower("proxyWallet") == user.lower())
    return rows.where("taker") if taker_only else rows


def holders(spark: SparkSession, path: str) -> DataFrame:
    """Top holders, one row per holder (SRC-9)."""
    rows = _json(spark, path, schemas.HOLDERS)
    return rows.select("conditionId", "token", F.explode("holders").alias("_h")).select(
        "conditionId", "token", F.col("_h.proxyWallet").alias("wallet"),
        F.coalesce(finite("_h.amount"), F.lit(0.0)).alias("shares"),
        F.when(F.col("_h.displayUsernamePublic"), F.nullif(F.col("_h.name"), F.lit(""))).alias("name"))


def leaderboard(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, schemas.LEADERBOARD)  # SRC-10
    return rows.select(F.col("proxyWallet").alias("wallet"), "rank", "userName", "vol", "pnl")


def price_history(spark: SparkSession, path: str) -> DataFrame:
    """Price samples in long form, incomplete points dropped (SRC-11)."""
    rows = _json(spark, path, schemas.PRICE_HISTORY)
    points = rows.select("token", F.explode("history").alias("_p"))
    return points.select(F.col("token").alias("token_id"), finite("_p.t").cast("long").alias("t"),
                         finite("_p.p").alias("p")).where("t is not null and p is not null")


def books(spark: SparkSession, path: str) -> DataFrame:
    """Book levels in long form; prices and sizes arrive as strings (SRC-12)."""
    rows = _json(spark, path, schemas.BOOKS)
    sides = [rows.select(F.col("asset_id").alias("token_id"), F.lit(kind).alias("kind"),
                         F.explode(column).alias("_l"))
             for kind, column in (("BID", "bids"), ("ASK", "asks"))]
    both = sides[0].unionByName(sides[1])
    return both.select("token_id", "kind", finite("_l.price").alias("price"),
                       finite("_l.size").alias("size"))


def portfolios(spark: SparkSession, path: str) -> DataFrame:
    """Portfolio value and traded-market count per wallet (SRC-13)."""
    rows = _json(spark, path, schemas.PORTFOLIO)
    return rows.select(F.lower("user").alias("wallet"),
                       F.get("value", F.lit(0))["value"].alias("portfolio_value"),
                       F.col("traded").alias("traded_markets"))
