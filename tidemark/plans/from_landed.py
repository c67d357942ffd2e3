"""From landed files to the ranked board. A market's id is its condition id, a trader's its wallet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.holders import first_buy
from tidemark.plans import live_board
from tidemark.session import cut_lineage
from tidemark.sources import landed, normalize

HOLDING = ["trader_id", "market_id", "outcome_index"]


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"condition_id": "market_id", "wallet": "trader_id"})


def tables(events: DataFrame, positions: DataFrame, closed: DataFrame, activity: DataFrame,
           leaderboard: DataFrame, as_of: int) -> dict[str, DataFrame]:
    """The tables that ``live_board.run`` takes, from the scans of the landed files.

    Fills that arrived on several pages count once. A position is opened by its first known buy, a
    settled one has its market's category, and a wallet is followed if the leaderboard names it.
    """
    markets = _named(normalize.ingestible(normalize.normalize_markets(landed.event_markets(events))))
    markets = cut_lineage(markets)
    fills = normalize.normalize_activity(activity)
    fills = cut_lineage(_named(fills.dropDuplicates(["dedupe_key"])))
    known = fills.where(F.col("ts") <= as_of)
    held = _named(normalize.normalize_positions(positions)).join(first_buy(known), HOLDING, "left")
    settled = _named(normalize.normalize_closed(closed)).join(
        markets.select("market_id", "category"), "market_id", "left").fillna({"category": "UNKNOWN"})
    followed = leaderboard.select(
        F.lower(F.trim("wallet")).alias("trader_id"), F.coalesce("userName", "wallet").alias("display_name"))
    followed = followed.dropDuplicates(["trader_id"]).withColumn("wallet", F.col("trader_id"))
    held = cut_lineage(held)
    return {"markets": markets, "positions": held, "traders": followed, "closed": cut_lineage(settled),
            "activity": fills, "portfolio": held.groupBy("trader_id").agg(
                F.sum("current_value").alias("portfolio_value"))}


def board(events: DataFrame, positions: DataFrame, closed: DataFrame, activity: DataFrame,
          leaderboard: DataFrame, as_of: int, cfg=None) -> tuple[DataFrame, DataFrame]:
    """Consensus of all held sides and the ranked board (SRC-1 to SCR-11 in one plan)."""
    return live_board.run(**tables(events, positions, closed, activity, leaderboard, as_of), as_of=as_of, cfg=cfg)

