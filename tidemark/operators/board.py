"""The board: listing gate, opportunity and short-horizon scores, sports angle, rank, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.functions import sports as S
from tidemark.functions.numeric import (
    count_where, half_up, hours_between, liquidity_score, scale_to_score, spread_score, total,
)
from tidemark.functions.pricing import (
    effective_price, entry_gap, model_estimate, payout, quotes, risk,
)
from tidemark.operators.prefix import numbered
from tidemark.operators.scores import attach_score, points_if

SIDE = ["market_id", "outcome_index"]


def market_sides(markets: DataFrame) -> DataFrame:
    """One row per outcome: price, token and label, with a fallback label (PRJ-5)."""
    zipped = F.arrays_zip("prices", "token_ids", "outcomes")
    rest = [c for c in markets.columns if c not in ("prices", "token_ids", "outcomes")]
    sides = markets.select(*rest, F.posexplode(zipped).alias("outcome_index", "_side"))
    label = F.coalesce("_side.outcomes", F.concat(F.lit("Outcome "), F.col("outcome_index")))
    return (sides.withColumns({"current_price": F.col("_side.prices"),
                               "token_id": F.col("_side.token_ids"), "outcome_label": label})
            .drop("_side"))


def listing_gate(sides: DataFrame, cfg=None) -> DataFrame:
    """``reject_reason`` of every scored side, null when it may be listed (FLT-2)."""
    e = merge_config(cfg)["eligibility"]
    price = F.col("current_price")
    reason = (F.when(price.isNull() | (price <= 0) | (price >= 1), "NO_PRICE")
              .when((price < e["min_price"]) | (price > e["max_price"]), "UNTRADEABLE_PRICE")
              .when(F.col("qualified_count") < e["min_qualified"], "NO_QUALIFIED_TRADER"))
    return sides.withColumn("reject_reason", reason)


def gate_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reject_reason", F.lit("LISTED")).alias("reason")).agg(
        F.count(F.lit(1)).alias("sides"))


def opportunity_score(sides: DataFrame, cfg=None) -> DataFrame:
    """Opportunity score with payout, model estimate and risk (SCR-5).

    Needs the consensus columns plus ``end_ts``, ``now_ts``, ``clarity_score`` and
    ``last_activity_ts``.
    """
    cfg = merge_config(cfg)
    o, weights = cfg["opportunity"], cfg["opportunity"]["weights"]
    staged = sides.withColumns({
        "hours_left": hours_between("end_ts", "now_ts"),
        "idle_hours": hours_between("now_ts", "last_activity_ts"),
        **entry_gap("current_price", "weighted_entry_price", cfg)})
    staged = staged.withColumns(
        model_estimate("current_price", "consensus", "qualified_count", cfg)
        | risk("current_price", "liquidity", "hours_left", "clarity_score", cfg)
        | {f"payout_{k}": v for k, v in payout(F.lit(1.0), "current_price").items()
           if k in ("shares", "profit", "return_pct")})
    idle = F.col("idle_hours")
    components = {
        "consensus": F.col("consensus"),
        "trader_quality": F.col("consensus_trader_quality"),
        "entry_quality": F.col("entry_score"),
        "liquidity": liquidity_score("liquidity", o["liquidity_range"]),
        "execution": spread_score("spread", o["spread_range"]),
        "recency": F.when(idle.isNotNull(), F.greatest(
            F.lit(0.0), 100.0 - idle / o["stale_hours"] * 100.0))
        .otherwise(F.col("consensus_recency")),
        "clarity": F.col("clarity_score"),
    }
    excess = F.least(F.lit(o["gap_points_max"]),
                     (F.col("entry_gap") - o["gap_start"]) * o["gap_points_per_dollar"])
    penalties = {
        "low_liquidity": points_if(F.col("liquidity") < o["min_liquidity"],
                                   o["low_liquidity_points"]),
        "wide_spread": points_if(F.col("spread") > o["max_spread"], o["wide_spread_points"]),
        "stale": points_if(idle > o["stale_hours"], o["stale_points"]),
        "entry_gap": F.when(F.col("entry_gap") > o["gap_start"], half_up(excess, 1)),
        "one_wallet": points_if(F.col("top_wallet_share") > o["top_share"], o["top_share_points"]),
        "ambiguous": points_if(F.col("clarity_score") < cfg["ambiguous_clarity"],
                               o["ambiguous_points"]),
        "short_time": points_if(F.col("hours_left") < o["short_time_hours"],
                                o["short_time_points"]),
        "longshot": points_if(F.col("current_price") < o["longshot_price"], o["longshot_points"]),
        "no_edge": points_if(F.col("edge_points") <= 0, o["no_edge_points"]),
        "insufficient_sample": F.when(F.col("qualified_count") == 0, float(o["no_trader_points"]))
        .when(F.col("qualified_count") < o["min_qualified"], float(o["few_traders_points"])),
    }
    scored = attach_score(staged, "opportunity",
                          {k: (weights[k], v) for k, v in components.items()}, penalties)
    quality = F.col("entry_quality")
    good = F.array_compact(F.array(
        F.when(F.col("qualified_count") > 0, "QUALIFIED_TRADERS"),
        F.when(F.col("increasing_count") > 0, "INCREASING"),
        F.when(quality.isin("GOOD", "FAIR"), "ENTRY_CLOSE"),
        F.when(F.col("consensus_category_skill") >= 65, "CATEGORY_RECORD"),
        F.when(F.col("liquidity") >= 50000, "DEEP_LIQUIDITY"),
        F.when(F.col("exposure_usd") > 0, "TRACKED_CAPITAL")))
    bad = F.concat(F.transform("opportunity_penalties", lambda p: p["key"]), F.array_compact(F.array(
        F.when(quality.isin("POOR", "STALE"), "ENTRY_GONE"),
        F.when(F.col("bot_count") > 0, "BOT_CONTRIBUTORS"))))
    return scored.withColumns({"reasons_for": good, "reasons_against": bad})


def late_money(holders: DataFrame, kickoffs: DataFrame, cfg=None) -> DataFrame:
    """USD that arrived before and after kickoff minus 24 hours, per side (AGG-19).

    Positions of unknown opening time are in neither part.
    """
    hours = merge_config(cfg)["sports"]["late_hours"]
    dated = (holders.join(kickoffs.select("market_id", "kickoff_ts"), "market_id")
             .where(F.col("kickoff_ts").isNotNull()))
    counted = (F.col("size_usd") > 0) & F.col("opened_ts").isNotNull()
    late = F.col("opened_ts") >= F.col("kickoff_ts") - int(hours * 3600)
    sums = dated.groupBy(*SIDE).agg(
        total(F.when(counted & late, F.col("size_usd"))).alias("late_usd"),
        total(F.when(counted & ~late, F.col("size_usd"))).alias("early_usd"))
    whole = F.col("late_usd") + F.col("early_usd")
    return sums.withColumn("late_share", F.when(whole > 0, F.col("late_usd") / whole))


def sports_angle(sides: DataFrame, late: DataFrame, cfg=None) -> DataFrame:
    """Phase, settlement estimate, line verdict, tradeability and note codes (SCR-7)."""
    cfg = merge_config(cfg)
    joined = sides.join(late, SIDE, "left").fillna({"late_usd": 0.0, "early_usd": 0.0})
    joined = joined.withColumns(
        {"is_game": F.col("kickoff_ts").isNotNull(),
         "hours_to_kickoff": hours_between("kickoff_ts", "now_ts"),
         "sports_settles_ts": S.settles_at("kickoff_ts", "league")}
        | S.market_kind("sports_market_type") | S.tradeability("liquidity", "spread")
        | S.line_verdict("current_price", "weighted_entry_price", "increasing_count",
                         "decreasing_count", cfg))
    joined = joined.withColumn("game_phase", S.phase("hours_to_kickoff", "league", cfg))
    verdict, phase, share = F.col("line_verdict"), F.col("game_phase"), F.col("late_share")
    notes = F.array_compact(F.array(
        F.when(~F.col("is_game"), "SEASON_FUTURE"), F.when(phase == "IMMINENT", "KICKOFF_CLOSE"),
        F.when(phase == "EARLY", "GAME_FAR_OFF"),
        F.when(share >= 0.6, "LATE_MONEY").when(share <= 0.15, "EARLY_MONEY"),
        F.when(~verdict.isin("UNKNOWN", "CAPITULATING"), F.concat(F.lit("LINE_"), verdict)),
        F.when((F.col("tier") == "EXOTIC") & F.col("tradeable"), "EXOTIC_MARKET")))
    warnings = F.array_compact(F.array(
        F.when(~F.col("tradeable"), F.col("untradeable_reason")),
        F.when(phase == "IN_PLAY", "IN_PLAY"), F.when(phase == "ENDED", "ENDED"),
        F.when(verdict == "CAPITULATING", "LINE_CAPITULATING")))
    return joined.withColumns({"sports_notes": notes, "sports_warnings": warnings})


def horizon_score(sides: DataFrame, cfg=None) -> DataFrame:
    """Return per day of capital at the price actually paid (SCR-6).

    Needs ``best_ask`` of the side, ``model_mid``, ``model_low``, ``end_ts`` and the sports
    columns of :func:`sports_angle`.
    """
    cfg = merge_config(cfg)
    h, weights = cfg["horizon"], cfg["horizon"]["weights"]
    target = F.coalesce("sports_settles_ts", "end_ts")
    hours = (target - F.col("now_ts")) / 3600.0
    staged = sides.withColumns({
        "hours_to_settle": F.when(hours > 0, hours),
        "effective_price": effective_price("current_price", "best_ask", "spread", h["slippage"]),
        "settles_ts": target,
        "settlement_timing": F.when(F.col("is_game"), "SCHEDULED")
        .when(F.col("end_ts").isNotNull(), "STATED").otherwise("UNKNOWN")})
    days = F.col("hours_to_settle") / 24.0
    staged = staged.withColumns({
        "capital_days": F.when(days.isNotNull(), F.greatest(days, F.lit(h["min_capital_days"]))),
        "capital_days_floored": F.coalesce(days < h["min_capital_days"], F.lit(False)),
        "_gross": F.col("model_mid") - F.col("current_price"),
        "_net": F.col("model_mid") - F.col("effective_price")})
    staged = staged.withColumns({
        "edge_retention": F.when(F.col("_net").isNotNull() & (F.col("_gross") > 0), F.greatest(
            F.lit(0.0), F.least(F.lit(1.0), F.col("_net") / F.col("_gross")))),
        "expected_return": F.col("_net") / F.col("effective_price"),
        "downside_return": (F.col("model_low") - F.col("effective_price"))
        / F.col("effective_price"),
        "upside_if_right": (1.0 - F.col("effective_price")) / F.col("effective_price"),
        "gross_edge_points": F.col("_gross") * 100.0, "net_edge_points": F.col("_net") * 100.0})
    staged = staged.withColumns({
        "return_per_day": F.col("expected_return") / F.col("capital_days"),
        "downside_per_day": F.col("downside_return") / F.col("capital_days")})
    depth = liquidity_score("liquidity", h["liquidity_range"])
    kept = F.col("edge_retention") * 100.0
    timing = (F.when(F.col("settlement_timing") == "SCHEDULED", 100.0)
              .when(F.col("settlement_timing") == "STATED", 65.0).otherwise(0.0))
    clarity = F.col("clarity_score")
    components = {
        "capital_efficiency": scale_to_score("return_per_day", *h["return_per_day_range"]),
        "downside_tested": scale_to_score("downside_per_day", *h["return_per_day_range"]),
        "signal_confidence": F.col("consensus"),
        "executability": F.when(depth.isNull(), kept).when(kept.isNull(), depth)
        .otherwise(kept * 0.5 + depth * 0.5),
        "settlement_certainty": F.when(clarity.isNull(), timing)
        .otherwise(timing * 0.5 + clarity * 0.5),
    }
    penalties = {
        "unknown_horizon": points_if(F.col("hours_to_settle").isNull(),
                                     h["unknown_horizon_points"]),
        "negative_net_edge": points_if(F.col("_net") <= 0, h["negative_edge_points"]),
        "longshot": points_if(F.col("effective_price") < h["longshot_price"],
                              h["longshot_points"]),
        "thin_book": points_if(F.col("liquidity") < h["thin_book"], h["thin_book_points"]),
        "insufficient_sample": points_if(F.col("qualified_count") < h["min_qualified"],
                                         h["few_traders_points"]),
        "ambiguous": points_if(clarity < cfg["ambiguous_clarity"],
                               cfg["opportunity"]["ambiguous_points"]),
    }
    return attach_score(staged, "horizon",
                        {k: (weights[k], v) for k, v in components.items()}, penalties) \
        .drop("_gross", "_net")


def with_side_quote(sides: DataFrame) -> DataFrame:
    """Replace the market's bid and ask by the side's own (PRJ-6)."""
    own = quotes("outcome_index", "best_bid", "best_ask")
    return sides.withColumns({"best_bid": own["bid"], "best_ask": own["ask"]})


def rank_board(board: DataFrame, score: str = "opportunity") -> DataFrame:
    """Position by score, then market and outcome (WIN-5); ids may be of any ordered type."""
    ranked = numbered(board, [], [F.desc(score), F.asc("market_id"), F.asc("outcome_index")], "rank")
    return ranked.withColumn("rank", F.col("rank") + 1)


def signal_badges(board: DataFrame, cfg=None) -> DataFrame:
    """One row per badge of a listed side (SCR-8)."""
    cfg = merge_config(cfg)
    o, c = cfg["opportunity"], F.col
    quality = c("entry_quality")
    rules = [
        ("STRONG_CONSENSUS", "POSITIVE", (c("qualified_count") >= 3) & (c("consensus") >= 70)),
        ("RECENT_ACCUMULATION", "POSITIVE",
         (c("increasing_count") >= 2) & (c("bought_24h") >= 10000)),
        ("CATEGORY_EXPERTS", "POSITIVE", c("consensus_category_skill") >= 70),
        ("ENTRY_ATTRACTIVE", "POSITIVE", quality == "GOOD"),
        ("CHASING", "WARNING", quality.isin("POOR", "STALE")),
        ("ONE_WALLET_SIGNAL", "WARNING", c("top_wallet_share") > o["top_share"]),
        ("LOW_LIQUIDITY", "WARNING", c("liquidity") < o["min_liquidity"]),
        ("WIDE_SPREAD", "WARNING", c("spread") > o["max_spread"]),
        ("POSSIBLE_BOT_ACTIVITY", "WARNING", c("bot_count") > 0),
        ("STALE_POSITIONS", "WARNING", c("idle_hours") > o["stale_hours"]),
        ("RESOLVING_SOON", "WARNING", c("hours_left") < o["short_time_hours"]),
        ("AMBIGUOUS_RESOLUTION", "WARNING", c("clarity_score") < cfg["ambiguous_clarity"]),
    ]
    badges = F.array_compact(F.array(*[
        F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(tone).alias("tone")))
        for kind, tone, hit in rules]))
    return board.select(*SIDE, F.explode(badges).alias("_b")).select(*SIDE, "_b.type", "_b.tone")


def list_opportunities(board: DataFrame, as_of, limit: int = 100, categories=None,
                       min_score=None, min_consensus=None, min_traders=None, min_liquidity=None,
                       max_spread=None, resolves_within_hours=None, max_gap_cents=None) -> DataFrame:
    """Best-scored listed sides under the list filters (FLT-4).

    All filters apply before the limit. ``min_trader_score`` and bot exclusion are not read-time
    filters.
    """
    kept = board
    if categories:
        kept = kept.where(F.col("category").isin(list(categories)))
    for column, bound in (("opportunity", min_score), ("consensus", min_consensus),
                          ("qualified_count", min_traders), ("liquidity", min_liquidity)):
        if bound is not None:
            kept = kept.where(F.col(column) >= bound)
    if max_spread is not None:
        kept = kept.where(F.col("spread") <= max_spread)
    if resolves_within_hours is not None:
        end = F.col("end_ts")
        kept = kept.where((end > as_of) & (end <= as_of + int(resolves_within_hours * 3600)))
    if max_gap_cents is not None:
        gap = F.col("entry_gap")
        kept = kept.where(gap.isNull() | (F.abs(gap) * 100.0 <= max_gap_cents))
    return kept.orderBy(F.desc("opportunity"), *SIDE).limit(limit)


CASH_SOON_ORDER = {
    "perDay": [F.desc_nulls_last, "horizon"], "chance": [F.desc_nulls_last, "model_mid"],
    "profit": [F.asc_nulls_last, "effective_price"],
}


def cash_soon(board: DataFrame, as_of, within_hours: float = 168, categories=None,
              min_score: float | None = None, require_edge: bool = True, sort: str = "perDay",
              limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Sides settling soon, and the counts of what was left out, over the whole window (FLT-5, TOP-1)."""
    until = as_of + int(within_hours * 3600)
    window = board.where((F.col("settles_ts") > as_of) & (F.col("settles_ts") <= until))
    if categories:
        window = window.where(F.col("category").isin(list(categories)))
    direction, column = CASH_SOON_ORDER[sort]
    order = [direction(column), *SIDE]
    eaten = (F.coalesce(F.col("net_edge_points") <= 0, F.lit(True)) if require_edge
             else F.lit(False))
    below = (F.coalesce("horizon", F.lit(0.0)) < min_score if min_score is not None
             else F.lit(False))
    counts = window.agg(F.count(F.lit(1)).alias("in_window"),
                        count_where(eaten).alias("edge_eaten_by_spread"),
                        count_where(~eaten & below).alias("below_score_floor"))
    return window.where(~eaten & ~below).orderBy(*order).limit(limit), counts


def sports_slate(board: DataFrame, as_of, within_hours: float = 96, tradeable_only: bool = True,
                 exclude_in_play: bool = True) -> tuple[DataFrame, DataFrame]:
    """Sports sides of upcoming games, and the counts of what was left out (FLT-6)."""
    sports = board.where(F.col("category") == "SPORTS")
    until = as_of + int(within_hours * 3600)
    phase = F.col("game_phase").isin("IN_PLAY", "ENDED")
    fate = (F.when(F.col("kickoff_ts").isNull(), "SEASON_FUTURE")
            .when(F.col("kickoff_ts") > until, "LATER")
            .when(F.lit(tradeable_only) & ~F.col("tradeable"), "UNTRADEABLE")
            .when(F.lit(exclude_in_play) & phase, "IN_PLAY").otherwise("KEPT"))
    judged = sports.withColumn("_fate", fate)
    counts = judged.agg(
        F.count(F.lit(1)).alias("total_sides"),
        count_where(F.col("_fate") == "UNTRADEABLE").alias("untradeable"),
        count_where(F.col("_fate") == "IN_PLAY").alias("in_play"),
        count_where(F.col("_fate") == "SEASON_FUTURE").alias("season_futures"))
    return judged.where(F.col("_fate") == "KEPT").drop("_fate"), counts


def games(slate: DataFrame, limit: int = 40) -> DataFrame:
    """Slate grouped by event, soonest kickoff first, with each game's best side (TOP-2)."""
    key = F.coalesce(F.col("event_id").cast("string"), F.col("event_slug"),
                     F.col("market_id").cast("string"))
    order = F.struct((-F.coalesce("horizon", F.lit(0.0))).alias("minus"), "market_id", "outcome_index")
    return (slate.withColumn("game", key).groupBy("game").agg(
        F.min("kickoff_ts").alias("kickoff_ts"), F.count(F.lit(1)).alias("sides"),
        F.min(order).alias("_best"))
        .select("game", "kickoff_ts", "sides", F.col("_best.market_id").alias("best_market"),
                F.col("_best.outcome_index").alias("best_outcome"))
        .orderBy(F.asc_nulls_last("kickoff_ts"), "game").limit(limit))


def category_counts(board: DataFrame) -> DataFrame:
    """Listed sides per category, most first, then by name (AGG-27)."""
    return (board.groupBy("category").agg(F.count(F.lit(1)).alias("sides"))
            .orderBy(F.desc("sides"), "category"))


def dashboard(traders: DataFrame, board: DataFrame, consensus: DataFrame, activity: DataFrame,
              as_of, threshold: float = 60.0) -> DataFrame:
    """Tracked, active, listed, strong-consensus and 24-hour counters in one row (AGG-28)."""
    recent = activity.where((F.col("ts") >= as_of - 86400) & (F.col("ts") <= as_of))
    parts = [
        traders.agg(F.count(F.lit(1)).alias("tracked"), count_where(F.col("active")).alias("active")),
        board.agg(F.count(F.lit(1)).alias("listed")),
        consensus.agg(count_where(F.col("consensus") >= threshold).alias("strong")),
        recent.agg(F.count(F.lit(1)).alias("fills_24h"), F.sum("usd").alias("volume_24h")),
    ]
    return one_row(parts)


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Glue single-row aggregates side by side."""
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    row = keyed[0]
    for part in keyed[1:]:
        row = row.join(part, "_one")
    return row.drop("_one")


def short_term_stats(board: DataFrame, as_of) -> DataFrame:
    """Settling today and this week, best return per day, upcoming events (AGG-29)."""
    settles, week = F.col("settles_ts"), as_of + 7 * 86400
    soon = (settles > as_of) & (settles <= week)
    return board.agg(
        count_where((settles > as_of) & (settles <= as_of + 86400)).alias("settling_today"),
        count_where(soon).alias("settling_this_week"),
        F.max(F.when(soon & (F.col("net_edge_points") > 0), F.col("return_per_day")))
        .alias("best_return_per_day"),
        F.count_distinct(F.when(F.col("kickoff_ts") > as_of, F.col("event_id")))
        .alias("upcoming_games"))


def consensus_list(consensus: DataFrame, board: DataFrame, n: int = 80) -> DataFrame:
    """Largest exposures with market context and whether the side is listed (JOIN-12, TOP-3)."""
    listed = board.select(*SIDE, F.lit(True).alias("listed"))
    return (consensus.orderBy(F.desc("exposure_usd"), *SIDE).limit(n)
            .join(listed, SIDE, "left").fillna({"listed": False}))


def consensus_totals(consensus: DataFrame) -> DataFrame:
    """Sum of exposure and number of sides (AGG-30)."""
    return consensus.agg(total("exposure_usd").alias("exposure_usd"),
                         F.count(F.lit(1)).alias("sides"))


def top(df: DataFrame, order: list, n: int) -> DataFrame:
    """First ``n`` rows of an order ending in a unique key (TOP-3)."""
    return df.orderBy(*order).limit(n)
