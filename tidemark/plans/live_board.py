"""The live board in one plan: wallet scores, holders, consensus, gate, scores, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.operators import board as B
from tidemark.operators import traders as T
from tidemark.operators.behaviour import behaviour
from tidemark.operators.consensus import consensus
from tidemark.operators.holders import build_holders, last_activity, live_markets
from tidemark.session import cut_lineage, without_constraint_inference


def wallet_scores(traders: DataFrame, closed: DataFrame, positions: DataFrame,
                  activity: DataFrame, portfolio: DataFrame, as_of: int, cfg=None) -> DataFrame:
    """Behaviour, metrics and score of every tracked trader (SCR-1, SCR-2)."""
    known = closed.where(F.col("resolved_ts").isNull() | (F.col("resolved_ts") <= as_of))
    with without_constraint_inference(closed.sparkSession):
        acts = behaviour(activity, known, portfolio, as_of, cfg)
        metrics = T.trader_metrics(known, ["trader_id"], as_of, positions, cfg, universe=traders)
        return cut_lineage(T.trader_score(metrics, acts, ["trader_id"], cfg))


def category_skills(closed: DataFrame, as_of: int, cfg=None) -> DataFrame:
    known = closed.where(F.col("resolved_ts").isNull() | (F.col("resolved_ts") <= as_of))
    return T.category_performance(T.settled_summary(known, ["trader_id"], as_of), ["trader_id"], cfg)


def live_sides(markets: DataFrame, positions: DataFrame, as_of: int) -> DataFrame:
    """Outcomes of the live universe with their price and the clock."""
    live = live_markets(markets, positions)
    return B.market_sides(live).withColumn("now_ts", F.lit(as_of).cast("long"))


def score_sides(holders: DataFrame, sides: DataFrame, cfg=None) -> DataFrame:
    """Consensus of every held side, with the side's own columns kept."""
    with without_constraint_inference(holders.sparkSession):
        return cut_lineage(consensus(holders, sides, ["market_id"], cfg))


def build_board(scored: DataFrame, holders: DataFrame, activity: DataFrame, as_of: int,
                cfg=None) -> DataFrame:
    """Listed sides with opportunity, sports and horizon columns, ranked (SCR-11)."""
    cfg = merge_config(cfg)
    gated = B.listing_gate(scored, cfg)
    listed = cut_lineage(gated.where(F.col("reject_reason").isNull()).drop("reject_reason"))
    active = last_activity(activity, ["market_id"], as_of)
    listed = listed.join(active, "market_id", "left")
    opportunity = B.opportunity_score(listed, cfg)
    late = B.late_money(holders, listed.select("market_id", "kickoff_ts").distinct(), cfg)
    angled = B.sports_angle(opportunity, late, cfg)
    with without_constraint_inference(holders.sparkSession):
        scored = cut_lineage(B.horizon_score(B.with_side_quote(angled), cfg))
    return B.rank_board(scored)


def run(markets: DataFrame, positions: DataFrame, traders: DataFrame, closed: DataFrame,
        activity: DataFrame, portfolio: DataFrame, as_of: int, exclude_bots: bool = False,
        cfg=None) -> tuple[DataFrame, DataFrame]:
    """Consensus of all held sides, and the board, from the raw tables."""
    scores = wallet_scores(traders, closed, positions, activity, portfolio, as_of, cfg)
    skills = category_skills(closed, as_of, cfg)
    holders = build_holders(positions, markets, traders, scores, skills, activity, as_of,
                            exclude_bots, cfg)
    holders = cut_lineage(holders)
    scored = score_sides(holders, live_sides(markets, positions, as_of), cfg)
    return scored, build_board(scored, holders, activity, as_of, cfg)
