"""Aggregates and score of the tracked holders on each side of a market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.functions.numeric import count_where, half_up, scale_to_score, total, weighted_mean
from tidemark.functions.pricing import entry_gap
from tidemark.operators.holders import (
    entry_clusters, holder_weight, one_per_wallet, opposing_totals,
)
from tidemark.operators.prefix import exact_median
from tidemark.operators.scores import attach_score, points_if
from tidemark.session import cut_lineage


def side_aggregates(unique: DataFrame, keys: list[str], now_ts: str, cfg=None) -> DataFrame:
    """Exposure, counts, flow, weighted entry and age per side (AGG-8, AGG-13, AGG-14)."""
    cfg = merge_config(cfg)
    bar = cfg["consensus"]["qualified_score"]
    side = [*keys, "outcome_index"]
    net = F.coalesce("recent_net_usd", F.lit(0.0))
    score = F.coalesce("smart_score", F.lit(0.0))
    typical = F.when(F.col("typical_usd") > 0, F.col("size_usd") / F.col("typical_usd"))
    skilled = F.col("category_skill").isNotNull()
    weighted = unique.withColumn("_w", holder_weight(cfg))
    sums = weighted.groupBy(*side).agg(
        F.count(F.lit(1)).alias("trader_count"),
        count_where(score >= bar).alias("qualified_count"),
        count_where(F.col("likely_bot")).alias("bot_count"),
        total("size_usd").alias("exposure_usd"),
        total(F.greatest(F.lit(0.0), net)).alias("bought_24h"),
        total(F.greatest(F.lit(0.0), -net)).alias("sold_24h"),
        count_where(net > 0).alias("increasing_count"),
        count_where(net < 0).alias("decreasing_count"),
        F.avg("avg_price").alias("avg_entry_price"),
        weighted_mean("avg_price", "_w").alias("weighted_entry_price"),
        F.when(F.sum("_w") > 0, F.max("_w") / F.sum("_w")).alias("top_wallet_share"),
        F.when(F.sum("_w") > 0, F.sum(score * F.col("_w")) / F.sum("_w")).alias("_quality"),
        weighted_mean("category_skill", F.when(skilled, F.col("_w"))).alias("_skill"),
        F.avg(typical).alias("_relative"))
    ages = unique.withColumn("_age", F.col(now_ts) - F.col("opened_ts"))
    # One row a side each: written one after the other, so that what one of them shuffles is gone before the next.
    median = cut_lineage(exact_median(ages.where(F.col("_age") >= 0), side, "_age", "_median_age"))
    clusters = cut_lineage(entry_clusters(unique, keys, cfg))
    return (sums.join(median, side, "left").join(clusters, side, "left")
            .withColumn("median_age_hours", F.col("_median_age") / 3600.0).drop("_median_age"))


def consensus(holders: DataFrame, sides: DataFrame, keys: list[str] | None = None, cfg=None,
              opposing_size: str = "size_usd") -> DataFrame:
    """Consensus score of every side that someone holds (SCR-4).

    ``sides`` carries per (keys, outcome_index) the price, liquidity, spread and ``now_ts``; keys
    are ``market_id`` for a live run, plus the signal time for a point-in-time run.
    """
    keys = keys or ["market_id"]
    cfg = merge_config(cfg)
    c, weights = cfg["consensus"], cfg["consensus"]["weights"]
    side = [*keys, "outcome_index"]
    unique = cut_lineage(one_per_wallet(holders, keys))
    clocks = sides.select(*side, "now_ts")
    against = cut_lineage(opposing_totals(unique, keys, c["qualified_score"], opposing_size))
    facts = (side_aggregates(unique.join(clocks, side), keys, "now_ts", cfg)
             .join(against, side, "left").join(sides, side))
    facts = facts.withColumns(entry_gap("current_price", "weighted_entry_price", cfg))

    net_qualified = F.col("qualified_count") - F.col("qualified_opposing_count") * 0.5
    flow = (F.col("bought_24h") - F.col("sold_24h")) / F.col("exposure_usd")
    adding = F.col("increasing_count") / F.col("trader_count") * 100.0
    components = {
        "agreement": scale_to_score(
            F.sqrt(F.greatest(F.lit(0.0), net_qualified))
            / F.sqrt(F.lit(c["agreement_saturation"])), 0.0, 1.0),
        "trader_quality": F.col("_quality"),
        "category_skill": F.col("_skill"),
        "recency": F.when(F.col("exposure_usd") > 0,
                          scale_to_score(flow, -0.2, 0.3) * 0.6 + adding * 0.4),
        "conviction": scale_to_score("_relative", 0.5, 3.0),
        "entry_alignment": F.col("entry_score"),
    }
    cluster = F.col("largest_cluster")
    penalties = {
        "one_wallet": points_if(F.col("top_wallet_share") > c["top_share"], c["top_share_points"]),
        "possible_correlation": F.when(cluster >= 3, F.least(F.lit(10), cluster * 2)),
        "stale": points_if(F.col("median_age_hours") > c["stale_hours"], c["stale_points"]),
        "entry_gap": points_if(F.col("entry_gap") > c["large_gap"], c["large_gap_points"]),
        "low_liquidity": points_if(F.col("liquidity") < c["low_liquidity"],
                                   c["low_liquidity_points"]),
        "wide_spread": points_if(F.col("spread") > c["wide_spread"], c["wide_spread_points"]),
        "bots": F.when(F.col("bot_count") > 0, half_up(
            F.col("bot_count") / F.col("trader_count") * float(c["bot_points"]))),
    }
    return attach_score(facts, "consensus",
                        {k: (weights[k], v) for k, v in components.items()}, penalties) \
        .drop("_quality", "_skill", "_relative")


def contributors(holders: DataFrame, keys: list[str] | None = None, cfg=None) -> DataFrame:
    """Every holder of a side with its weight, heaviest first (TOP-6).

    Rows, not an array: a side may have any number of holders, and the final sort ranges over
    (side, weight) so one large side is spread over many tasks.
    """
    keys = keys or ["market_id"]
    unique = one_per_wallet(holders, keys)
    return (unique.withColumn("weight", half_up(holder_weight(merge_config(cfg)), 2))
            .select(*keys, "outcome_index", "trader_id", "wallet", "display_name", "smart_score",
                    "size_usd", "avg_price", "weight", "opened_ts", "recent_net_usd")
            .orderBy(*keys, "outcome_index", F.desc("weight"), "trader_id"))
