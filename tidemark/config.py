"""Weights and thresholds of every score, in one nested dict, plus the override merge."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

# Score weights, penalties and thresholds. Money in USD, prices as 0..1, times in the
# unit the key names.
DEFAULTS: dict[str, Any] = {
    "trader": {
        "weights": {
            "long_term": 25, "consistency": 20, "recent_form": 15, "category_skill": 15,
            "risk_adjusted": 10, "sample_quality": 10, "conviction": 5,
        },
        "full_credit_sample": 50,
        "small_sample": 10, "small_sample_points": 12,
        "roi_range": (-0.5, 1.5),
        "hhi_limit": 0.4, "hhi_points": 6,
        "high_price_share": 0.6, "high_price_points": 10,
        "only_winners_points": 20,
        "short_hold_seconds": 900, "short_hold_points": 8,
        "top_win_share": 0.6, "top_win_points": 8,
        "poor_recent_roi": -0.1, "poor_recent_points": 6,
        "maker_points": 10, "bot_points": 8,
        "category_prior": 8,
    },
    "behaviour": {
        "high_frequency_7d": 300, "very_high_frequency_7d": 1000,
        "scalp_hold_seconds": 1800, "low_held_share": 0.2,
        "both_sides_markets": 8, "small_trade_usd": 25.0, "small_trade_share": 0.6,
        "high_turnover": 5.0,
        # None: all fills; a number keeps each trader's newest ones.
        "fills_considered": None,
    },
    "consensus": {
        "weights": {
            "agreement": 28, "trader_quality": 24, "category_skill": 14, "recency": 14,
            "conviction": 10, "entry_alignment": 10,
        },
        "qualified_score": 60.0, "agreement_saturation": 6.0,
        "stale_hours": 504.0, "stale_points": 10,
        "top_share": 0.6, "top_share_points": 12,
        "large_gap": 0.15, "large_gap_points": 12,
        "low_liquidity": 5000.0, "low_liquidity_points": 8,
        "wide_spread": 0.05, "wide_spread_points": 6,
        "bot_points": 10, "recent_hours": 24, "bot_weight": 0.35,
        "cluster_hours": 2, "cluster_price": 0.01,
    },
    "opportunity": {
        "weights": {
            "consensus": 30, "trader_quality": 20, "entry_quality": 15, "liquidity": 10,
            "execution": 10, "recency": 10, "clarity": 5,
        },
        "liquidity_range": (1000.0, 500000.0), "spread_range": (0.001, 0.08),
        "min_liquidity": 2000.0, "low_liquidity_points": 10,
        "max_spread": 0.05, "wide_spread_points": 8,
        "stale_hours": 336.0, "stale_points": 8,
        "gap_start": 0.05, "gap_points_per_dollar": 80.0, "gap_points_max": 20.0,
        "top_share": 0.6, "top_share_points": 10,
        "ambiguous_points": 6,
        "short_time_hours": 12.0, "short_time_points": 6,
        "min_qualified": 2, "few_traders_points": 10, "no_trader_points": 30,
        "longshot_price": 0.15, "longshot_points": 12,
        "no_edge_points": 18,
    },
    "eligibility": {"min_qualified": 1, "min_price": 0.02, "max_price": 0.98},
    "entry_gap": {"good": 0.05, "fair": 0.1, "poor": 0.2},
    "model": {
        "shift_fraction": 0.5, "shift_max": 0.12, "base_width": 0.04,
        "width_per_missing": 0.012, "min_width": 0.02, "max_width": 0.15,
    },
    "risk": {"longshot_price": 0.15, "underdog_price": 0.35, "thin_liquidity": 10000.0,
             "imminent_hours": 24.0},
    "horizon": {
        "weights": {
            "capital_efficiency": 40, "downside_tested": 20, "signal_confidence": 20,
            "executability": 12, "settlement_certainty": 8,
        },
        "min_capital_days": 1.0, "return_per_day_range": (0.0, 0.1),
        "liquidity_range": (500.0, 100000.0), "slippage": 0.01,
        "negative_edge_points": 35, "unknown_horizon_points": 25,
        "thin_book": 1000.0, "thin_book_points": 15,
        "min_qualified": 2, "few_traders_points": 15,
        "longshot_price": 0.15, "longshot_points": 12,
    },
    "sports": {"late_hours": 24.0, "flat_points": 0.5, "imminent_hours": 6.0, "early_hours": 168.0},
    "ambiguous_clarity": 45.0,
    "snapshot": {"price_move": 0.005, "liquidity_move": 0.05, "position_move": 0.02,
                 "max_age_seconds": 21600},
    "feed": {"min_usd": 500.0, "min_change": 0.15, "shift": 15.0, "crossed_gap": 0.1,
             "cluster_entrants": 3},
    "alerts": {
        "max_hours": 48.0, "min_win": 0.4, "min_edge_points": 2.0, "min_score": 60.0,
        "min_qualified": 2, "min_liquidity": 5000.0, "kickoff_hours": 3.0, "stale_hours": 3.0,
    },
    "tape": {"windows": (1, 6, 24), "quiet_fills": 5, "min_fills": 3, "min_usd": 250.0},
    "deep_dive": {"stakes": (1.0, 10.0, 50.0), "moved_points": 1.0, "thin_top_usd": 25.0,
                  "shrunk_points": 0.5, "shallow_points": 2.0, "max_leg_spread": 0.1},
    "clv": {"min_sample": 5, "z": 1.96, "max_needed": 5000, "slice_gate": 8, "relation_gate": 12},
    "bets": {"settle_delay_seconds": 600, "lookback_days": 30, "newest": None},
    "selection": {
        "new_share": 0.25, "hot_score": 60.0, "warm_score": 45.0,
        "hot_hours": 48.0, "warm_hours": 336.0, "dormant_hours": 2160.0,
    },
    # None: no limit.
    "discover": {"markets": None, "min_shares": 100.0, "min_markets": 2, "max_new": None,
                 "tape_min_usd": 50.0, "tape_min_markets": 2, "tape_max_new": None},
    "backtest": {
        "horizons": (1, 2, 3, 5, 7, 14), "min_price": 0.05, "max_price": 0.95, "min_holders": 1,
        "max_price_age_hours": 24.0,
        "iterations": 2000, "min_band_size": 20, "seed": 20260910,
        "alpha": 0.05, "min_signals": 100, "replication_share": 0.6,
    },
}


def merge_config(overrides: Mapping[str, Any] | None = None,
                 base: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Overlay ``overrides`` on the defaults, branch by branch; ``None`` leaves a value alone."""
    merged = dict(DEFAULTS if base is None else base)
    if not isinstance(overrides, Mapping):
        return merged
    for key, value in overrides.items():
        if value is None:
            continue
        current = merged.get(key)
        both = isinstance(value, Mapping) and isinstance(current, Mapping)
        merged[key] = merge_config(value, current) if both else value
    return merged
