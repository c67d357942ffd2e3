"""Signals as they would have been given at past moments, with no look-ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.operators.board import opportunity_score
from tidemark.operators.consensus import consensus
from tidemark.operators.replay import observed_price, replay_positions
from tidemark.operators.traders import trader_scores_asof
from tidemark.session import cut_lineage, without_constraint_inference

MOMENT = ["market_id", "signal_ts"]
SIDE = [*MOMENT, "outcome_index"]


def testable_markets(markets: DataFrame, activity: DataFrame, from_ts: int, to_ts: int,
                     limit: int | None = None) -> DataFrame:
    """Resolved markets with a known settlement and a tracked fill, newest first (FLT-8, JOIN-2)."""
    inside = markets.where(F.col("resolved") & F.col("resolved_ts").between(from_ts, to_ts))
    traded = inside.join(activity.select("market_id"), "market_id", "left_semi")
    ordered = traded.orderBy(F.desc("resolved_ts"), "market_id")
    return traded if limit is None else ordered.limit(limit)


def signal_moments(markets: DataFrame, horizons, evaluated_ts: int) -> DataFrame:
    """One row per market and horizon with the reasons that need no other table (PIT-3)."""
    days = F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon_days")
    asked = markets.select("*", days).withColumn(
        "signal_ts", F.col("resolved_ts") - F.col("horizon_days") * F.lit(86400))
    return asked.withColumn("reject_reason", F.when(F.col("winner").isNull(), "NO_OUTCOME")
                            .when(F.col("signal_ts") < F.col("start_ts"), "BEFORE_START")
                            .when(F.col("signal_ts") >= evaluated_ts, "NOT_YET_PAST"))


def build_signals(markets: DataFrame, activity: DataFrame, closed: DataFrame, traders: DataFrame,
                  curves: DataFrame, snapshots: DataFrame, evaluated_ts: int, cfg=None,
                  horizons=None) -> tuple[DataFrame, DataFrame]:
    """Signals and reject counts for every horizon in one plan (PIT-2, PIT-3, AGG-38).

    ``markets`` is the tested universe. Every step is keyed by (market, signal time), so the
    horizons share one pass over fills, curves and settled positions.
    """
    with without_constraint_inference(markets.sparkSession):
        return _signals(markets, activity, closed, traders, curves, snapshots, evaluated_ts, merge_config(cfg), horizons)


def _signals(markets, activity, closed, traders, curves, snapshots, evaluated_ts, cfg, horizons):
    b = cfg["backtest"]
    moments = cut_lineage(signal_moments(markets, horizons or b["horizons"], evaluated_ts))
    open_moments = moments.where(F.col("reject_reason").isNull())
    asked = open_moments.select(*MOMENT, F.size("prices").alias("outcomes"))

    holdings = cut_lineage(replay_positions(activity, asked))
    prices = cut_lineage(observed_price(asked, curves, snapshots, activity))
    held = holdings.groupBy(*MOMENT).agg(F.count(F.lit(1)).alias("_held"))
    priced = prices.groupBy(*MOMENT).agg(F.max("observed_ts").alias("_observed"))
    age = F.greatest(F.lit(0), F.col("signal_ts") - F.col("_observed"))
    limit_s = b["max_price_age_hours"]
    judged = (moments.join(held, MOMENT, "left").join(priced, MOMENT, "left").withColumns({
        "age_seconds": age,
        "reject_reason": F.coalesce(
            "reject_reason", F.when(F.col("_held").isNull(), "NO_HOLDERS")
            .when(F.col("_observed").isNull(), "NO_PRICE")
            .when(age > int(limit_s * 3600), "STALE") if limit_s is not None else
            F.when(F.col("_held").isNull(), "NO_HOLDERS")
            .when(F.col("_observed").isNull(), "NO_PRICE"))}))
    passed = judged.where(F.col("reject_reason").isNull())

    per_side = holdings.groupBy(*SIDE).agg(F.count(F.lit(1)).alias("_holders"))
    sides = (passed.drop("liquidity", "spread", "reject_reason").join(per_side, MOMENT)
             .join(prices, SIDE, "left"))
    price = F.col("price")
    bad = price.isNull() | (price <= 0) | (price >= 1)
    sides = sides.withColumn("reject_reason", F.when(F.col("_holders") < b["min_holders"], "FEW_HOLDERS")
                             .when(bad, "NO_PRICE")
                             .when((price < b["min_price"]) | (price > b["max_price"]), "OUT_OF_BAND"))
    sides = cut_lineage(sides)
    scored_sides = sides.where(F.col("reject_reason").isNull()).select(
        *SIDE, "horizon_days", "category", "end_ts", "clarity_score", "winner", "resolved_ts",
        "age_seconds", "source", "liquidity", "spread", F.col("price").alias("current_price"),
        F.col("signal_ts").alias("now_ts"))

    at_day = F.floor(F.col("signal_ts") / F.lit(86400)).cast("long")
    dated = holdings.withColumn("as_of_day", at_day)
    needed = dated.select("trader_id", "as_of_day").distinct()
    settled = closed.withColumn("resolved_ts", F.coalesce("resolved_ts", "end_ts"))
    scores = trader_scores_asof(settled, needed, cfg).select("trader_id", "as_of_day", "smart_score")
    own_price = prices.select(*SIDE, "price")
    nothing = F.lit(None).cast("double")
    rated = cut_lineage(dated.join(scores, ["trader_id", "as_of_day"]).drop("as_of_day", "cost_usd"))
    holders = (rated
               .join(traders.select("trader_id", "wallet", "display_name"), "trader_id")
               .join(own_price, SIDE, "left")
               .select(*SIDE, "trader_id", "wallet", "display_name", "smart_score", "shares",
                       nothing.alias("category_skill"),
                       (F.col("shares") * F.col("price")).alias("size_usd"), "avg_price",
                       F.col("first_buy_ts").alias("opened_ts"), nothing.alias("typical_usd"),
                       "recent_net_usd", F.lit(False).alias("likely_bot")))
    agreed = consensus(holders, scored_sides, MOMENT, cfg, opposing_size="shares")
    agreed = cut_lineage(agreed).withColumn("opposing_exposure_usd",
                               F.col("opposing_exposure_usd") * F.col("current_price"))
    active = agreed.join(prices.select(*SIDE, "last_activity_ts"), SIDE, "left")
    signals = opportunity_score(active, cfg)
    won = F.col("outcome_index") == F.col("winner")
    signals = signals.withColumns({
        "won": won, "pnl": F.when(won, 1.0 / F.col("current_price") - 1.0).otherwise(-1.0)})
    signals = signals.select(
        "horizon_days", "market_id", "outcome_index", "signal_ts", "category",
        F.col("current_price").alias("price"), "source", "age_seconds", "opportunity", "consensus",
        "qualified_count", "trader_count", "weighted_entry_price", "entry_gap", "won", "pnl",
        "resolved_ts")
    counted = (judged.where(F.col("reject_reason").isNotNull()).select("horizon_days", "reject_reason")
               .unionByName(sides.where(F.col("reject_reason").isin("NO_PRICE", "OUT_OF_BAND"))
                            .select("horizon_days", "reject_reason")))
    rejects = counted.groupBy("horizon_days", "reject_reason").agg(
        F.count(F.lit(1)).alias("rejected"))
    return cut_lineage(signals), rejects
