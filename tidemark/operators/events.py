"""Feed events from changes of positions and sides, and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.functions.numeric import day_text, hour_text, hours_between, total

SIDE = ["market_id", "outcome_index"]


def _importance(usd):
    return F.when(usd >= 50000, 3).when(usd >= 10000, 2).otherwise(1)


def position_events(previous: DataFrame, current: DataFrame, markets: DataFrame, as_of: int,
                    cfg=None) -> DataFrame:
    """Opened, increased, reduced and closed positions between two passes (JOIN-15, EVT-1)."""
    f = merge_config(cfg)["feed"]
    cols = ["size", "current_value", *SIDE]

    def named(df, prefix):
        return df.select("trader_id", "asset", *[F.col(c).alias(f"{prefix}_{c}") for c in cols],
                         F.lit(True).alias(prefix))

    joined = named(previous, "was").join(named(current, "now"), ["trader_id", "asset"], "full_outer")
    known = markets.select(F.col("market_id").alias("now_market_id"), F.lit(True).alias("_known"))
    joined = joined.join(known, "now_market_id", "left")
    value = F.coalesce("now_current_value", F.lit(0.0))
    before = F.coalesce("was_current_value", F.lit(0.0))
    change = F.when(F.col("was_size") > 0,
                    (F.col("now_size") - F.col("was_size")) / F.col("was_size"))
    moved = F.abs(value - before)
    known_now = F.col("now").isNotNull() & F.col("_known").isNotNull()
    big = (F.abs(change) >= f["min_change"]) & (moved >= f["min_usd"])
    kind = (F.when(F.col("now").isNull() & (before >= f["min_usd"]), "POSITION_CLOSED")
            .when(known_now & F.col("was").isNull() & (value >= f["min_usd"]), "POSITION_OPENED")
            .when(known_now & big & (change > 0), "POSITION_INCREASED")
            .when(known_now & big, "POSITION_REDUCED"))
    opened, closed = F.col("type") == "POSITION_OPENED", F.col("type") == "POSITION_CLOSED"
    usd = F.when(opened, value).when(closed, before).otherwise(moved)
    day = day_text(F.lit(as_of))
    prefix = (F.when(opened, "open").when(closed, "close")
              .when(F.col("type") == "POSITION_INCREASED", "inc").otherwise("dec"))
    key = F.concat_ws(":", prefix, "trader_id", "asset", F.when(~opened, day))
    return joined.withColumn("type", kind).where(F.col("type").isNotNull()).select(
        "type", key.alias("dedupe_key"), "trader_id", "asset",
        F.coalesce("now_market_id", "was_market_id").alias("market_id"),
        F.coalesce("now_outcome_index", "was_outcome_index").alias("outcome_index"),
        usd.alias("magnitude_usd"),
        F.when(closed, 2).otherwise(_importance(usd)).alias("importance"))


def recent_entrants(holders: DataFrame, as_of: int) -> DataFrame:
    """Holders of a side that opened within the last 24 hours."""
    fresh = holders.where(F.col("opened_ts") >= as_of - 86400)
    return fresh.groupBy(*SIDE).agg(F.count(F.lit(1)).alias("entrants"))


def side_events(board: DataFrame, previous: DataFrame, entrants: DataFrame, as_of: int,
                cfg=None) -> DataFrame:
    """Clustered entry, consensus shift and price past the tracked entry (WIN-8, EVT-2)."""
    f = merge_config(cfg)["feed"]
    joined = (board.select(*SIDE, "consensus", "current_price", "weighted_entry_price")
              .join(previous.select(*SIDE, F.col("consensus").alias("previous")), SIDE, "left")
              .join(entrants, SIDE, "left"))
    c = F.col
    gap = c("current_price") - c("weighted_entry_price")
    day, hour = day_text(F.lit(as_of)), hour_text(F.lit(as_of))
    rules = [("CLUSTER_ENTRY", "cluster", day, 3, c("entrants") >= f["cluster_entrants"]),
             ("CONSENSUS_SHIFT", "consensus", hour, 2,
              F.abs(c("consensus") - c("previous")) >= f["shift"]),
             ("PRICE_CROSSED_ELITE_ENTRY", "crossed", day, 2, gap >= f["crossed_gap"])]
    events = F.array_compact(F.array(*[
        F.when(hit, F.struct(F.lit(kind).alias("type"),
                             F.concat_ws(":", F.lit(prefix), "market_id", "outcome_index", stamp)
                             .alias("dedupe_key"), F.lit(weight).alias("importance")))
        for kind, prefix, stamp, weight, hit in rules]))
    return joined.select(*SIDE, F.explode(events).alias("_e")).select(*SIDE, "_e.*")


def resolved_events(markets: DataFrame, was_resolved: DataFrame, positions: DataFrame) -> DataFrame:
    """Markets resolved since the last pass with the tracked exposure they settle (EVT-3)."""
    fresh = markets.where("resolved").join(was_resolved.select("market_id"), "market_id", "left_anti")
    exposure = positions.groupBy("market_id").agg(total("current_value").alias("magnitude_usd"))
    return (fresh.select("market_id", "winner").join(exposure, "market_id", "left")
            .fillna({"magnitude_usd": 0.0})
            .withColumns({"type": F.lit("MARKET_RESOLVED"), "importance": F.lit(2),
                          "dedupe_key": F.concat_ws(":", F.lit("resolved"), "market_id")}))


def qualifies(as_of: int, cfg=None):
    """All the conditions a listed side must meet to be worth an alert (FLT-7)."""
    a, c = merge_config(cfg)["alerts"], F.col
    hours = (c("settles_ts") - as_of) / 3600.0
    return F.coalesce(
        (hours > 0) & (hours <= a["max_hours"]) & (c("net_edge_points") >= a["min_edge_points"])
        & (c("model_mid") >= a["min_win"]) & (c("horizon") >= a["min_score"])
        & (c("qualified_count") >= a["min_qualified"]) & (c("liquidity") >= a["min_liquidity"])
        & (c("effective_price") > 0) & (c("effective_price") < 1), F.lit(False))


def opportunity_alerts(board: DataFrame, as_of: int, cfg=None) -> DataFrame:
    """Alerts for the sides settling soon that qualify, kickoff ones first in urgency (TOP-7, EVT-4)."""
    a = merge_config(cfg)["alerts"]
    kickoff = (F.col("kickoff_ts") - as_of) / 3600.0
    soon = F.coalesce((kickoff > 0) & (kickoff <= a["kickoff_hours"]), F.lit(False))
    subject = F.concat_ws("-", "market_id", "outcome_index")
    return board.where((F.col("net_edge_points") > 0) & qualifies(as_of, cfg)).select(
        F.when(soon, "KICKOFF_SOON").otherwise("OPPORTUNITY").alias("kind"),
        F.concat_ws(":", F.when(soon, "kickoff").otherwise("opp"), subject,
                    day_text(F.lit(as_of))).alias("dedupe_key"),
        F.when(soon, "high").otherwise("normal").alias("priority"))


def settlement_alerts(bets: DataFrame, as_of: int, cfg=None) -> DataFrame:
    """One alert per recently placed bet that has settled (EVT-5)."""
    b = merge_config(cfg)["bets"]
    recent = bets.where(F.col("won").isNotNull()
                        & (F.col("placed_ts") >= as_of - b["lookback_days"] * 86400))
    newest = recent if b["newest"] is None else recent.orderBy(F.desc("placed_ts"), "bet_id").limit(b["newest"])
    return newest.select(F.lit("BET_SETTLED").alias("kind"),
                         F.concat_ws(":", F.lit("settled"), "bet_id").alias("dedupe_key"),
                         F.lit("low").alias("priority"))


def clv_alert(summary: DataFrame) -> DataFrame:
    """An alert only when the closing-line verdict is conclusive (EVT-6)."""
    up = F.col("verdict") == "BEATING_THE_CLOSE"
    return summary.where(F.col("verdict").isin("BEATING_THE_CLOSE", "PAYING_UP")).select(
        F.lit("CLV_VERDICT").alias("kind"), F.concat_ws(":", F.lit("clv"), "verdict").alias("dedupe_key"),
        F.when(up, "normal").otherwise("high").alias("priority"))


def freshness(df: DataFrame, ts: str, as_of: int, cfg=None) -> DataFrame:
    """Age of the newest row and whether it is past the limit (AGG-41)."""
    limit = merge_config(cfg)["alerts"]["stale_hours"]
    hours = hours_between(F.lit(as_of), "last_ts")
    return df.agg(F.max(ts).alias("last_ts")).withColumns(
        {"age_hours": hours, "stale": hours >= limit})


def stale_alert(fresh: DataFrame, as_of: int) -> DataFrame:
    """An alert per hour while the data is stale (EVT-7)."""
    return fresh.where("stale").select(
        F.lit("SYNC_STALE").alias("kind"),
        F.concat_ws(":", F.lit("stale"), hour_text(F.lit(as_of))).alias("dedupe_key"),
        F.lit("high").alias("priority"))


def new_alerts(kinds: list[DataFrame], raised: DataFrame) -> DataFrame:
    """All alert kinds in one table, less those raised before (SET-1, SET-5)."""
    rows = kinds[0]
    for more in kinds[1:]:
        rows = rows.unionByName(more)
    return rows.dropDuplicates(["dedupe_key"]).join(
        raised.select("dedupe_key"), "dedupe_key", "left_anti")


def feed(events: DataFrame, traders: DataFrame, markets: DataFrame, n: int = 120) -> DataFrame:
    """Newest events with trader and market context (JOIN-19, TOP-3)."""
    newest = events.orderBy(F.desc("ts"), "dedupe_key").limit(n)
    return (newest.join(traders.select("trader_id", "display_name"), "trader_id", "left")
            .join(markets.select("market_id", "question", "category"), "market_id", "left"))
