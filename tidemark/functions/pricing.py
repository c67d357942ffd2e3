"""Prices, payouts, entry gap, model estimate, risk and closing-line value as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, col, finite, half_up


def tradeable_price(price) -> Column:
    price = finite(price)
    return F.coalesce((price > 0) & (price < 1), F.lit(False))


def quotes(outcome_index, bid, ask) -> dict[str, Column]:
    """Bid and ask of one outcome; the second outcome of a pair is the complement (PRJ-6)."""
    index, bid, ask = col(outcome_index), finite(bid), finite(ask)
    return {"bid": F.when(index == 0, bid).when(index == 1, 1.0 - ask),
            "ask": F.when(index == 0, ask).when(index == 1, 1.0 - bid)}


def effective_price(mid, ask, spread, slippage: float) -> Column:
    """What a buyer pays: ask, else mid plus half the spread, else mid; with slippage (PRJ-7)."""
    mid, ask, spread = finite(mid), finite(ask), finite(spread)
    base = F.when(F.coalesce((ask > 0) & (ask < 1), F.lit(False)), ask) \
        .when(mid.isNotNull() & spread.isNotNull(), mid + spread / 2.0).otherwise(mid)
    paid = base * (1.0 + slippage)
    return F.when((base > 0) & (paid < 1), paid)


def payout(stake, price) -> dict[str, Column]:
    """Shares, gross, profit, loss, return and the reason a payout cannot be computed (PRJ-8)."""
    stake, price = finite(stake), finite(price)
    shares = finite(stake / price)
    reason = (F.when(price.isNull(), "NO_PRICE").when(price <= 0, "PRICE_TOO_LOW")
              .when(price >= 1, "PRICE_TOO_HIGH")
              .when(stake.isNull() | (stake < 0), "BAD_STAKE")
              .when((stake > 0) & shares.isNull(), "STAKE_TOO_LARGE"))
    usable = reason.isNull()
    return {
        "shares": F.when(usable, shares),
        "gross": F.when(usable, shares),
        "profit": F.when(usable, shares - stake),
        "loss": F.when(usable, stake).otherwise(0.0),
        "return_pct": F.when(usable & (stake > 0), (shares - stake) / stake),
        "break_even": F.when(usable, price),
        "invalid_reason": reason,
    }


def expected_value(probability, price) -> dict[str, Column]:
    """Edge per share and per dollar at an assumed probability (PRJ-9)."""
    p, price = finite(probability), finite(price)
    usable = (price > 0) & (price < 1) & (p >= 0) & (p <= 1)
    return {
        "ev_per_share": F.when(usable, p - price),
        "ev_per_dollar": F.when(usable, (p - price) / price),
        "edge_points": F.when(usable, (p - price) * 100.0),
    }


def stake_outcome(stake, price) -> dict[str, Column]:
    """Shares, return and profit of a stake at the price paid (PRJ-11)."""
    stake, price = finite(stake), finite(price)
    usable = (stake > 0) & (price > 0) & (price < 1)
    shares = F.when(usable, finite(stake / price))
    return {"shares": shares, "returned": shares, "profit": shares - stake,
            "lost": F.when(shares.isNotNull(), stake)}


def entry_gap(price, entry, cfg) -> dict[str, Column]:
    """Distance of today's price from the weighted entry, banded and scored (PRJ-12)."""
    bounds = cfg["entry_gap"]
    price, entry = finite(price), finite(entry)
    known = price.isNotNull() & (entry > 0)
    gap = F.when(known, price - entry)
    size = F.abs(gap)
    quality = (F.when(gap < -bounds["good"], "BETTER_THAN_ELITE")
               .when(size <= bounds["good"], "GOOD").when(size <= bounds["fair"], "FAIR")
               .when(size <= bounds["poor"], "POOR").when(gap.isNotNull(), "STALE")
               .otherwise("UNKNOWN"))
    below = F.when(size > bounds["poor"], 75.0).otherwise(
        F.least(F.lit(100.0), 90.0 + F.least(F.lit(10.0), size / bounds["poor"] * 10.0)))
    above = F.greatest(F.lit(0.0), 100.0 - gap / bounds["poor"] * 85.0)
    score = half_up(F.when(gap <= 0, below).when(gap > 0, above), 1)
    badge = (F.when(quality == "GOOD", "ALIGNED").when(quality == "BETTER_THAN_ELITE", "BELOW_ELITE")
             .when(quality == "FAIR", "ACCEPTABLE").when(quality == "POOR", "CHASING")
             .when(quality == "STALE", "LIKELY_STALE").otherwise("UNAVAILABLE"))
    return {"entry_gap": gap, "entry_gap_pct": gap / entry, "entry_quality": quality,
            "entry_score": score, "entry_badge": badge}


def model_estimate(price, consensus_score, qualified, cfg) -> dict[str, Column]:
    """Bounded nudge of the price by the consensus, as low/mid/high (PRJ-15)."""
    m = cfg["model"]
    price, score, qualified = finite(price), col(consensus_score), col(qualified)
    usable = (price > 0) & (price < 1) & score.isNotNull() & (qualified > 0)
    strength = (score - 50.0) / 50.0
    headroom = F.when(strength >= 0, 1.0 - price).otherwise(price)
    shift = F.signum(strength) * F.least(F.abs(strength) * m["shift_fraction"] * headroom,
                                         F.lit(m["shift_max"]))
    mid = F.when(usable, clamp(price + shift, 0.01, 0.99))
    missing = F.greatest(F.lit(0), 6 - qualified).cast("double")
    width = F.least(F.lit(m["max_width"]), F.greatest(
        F.lit(m["min_width"]), m["base_width"] + missing * m["width_per_missing"]))
    return {
        "model_low": F.when(mid.isNotNull(), F.greatest(F.lit(0.01), mid - width)),
        "model_mid": mid,
        "model_high": F.when(mid.isNotNull(), F.least(F.lit(0.99), mid + width)),
        "edge_points": (mid - price) * 100.0,
        "ev_per_share": mid - price,
        "return_on_capital": (mid - price) / price,
    }


def risk(price, liquidity, hours, clarity, cfg) -> dict[str, Column]:
    """Risk points, level and reason codes (PRJ-16)."""
    r = cfg["risk"]
    price, liquidity = finite(price), finite(liquidity)
    longshot = price < r["longshot_price"]
    underdog = ~longshot & (price < r["underdog_price"])
    thin = liquidity < r["thin_liquidity"]
    soon = col(hours) < r["imminent_hours"]
    vague = col(clarity) < cfg["ambiguous_clarity"]
    points = (F.when(longshot, 2).when(underdog, 1).otherwise(0) + F.when(thin, 1).otherwise(0)
              + F.when(soon, 1).otherwise(0) + F.when(vague, 1).otherwise(0))
    level = (F.when(points >= 4, "VERY HIGH").when(points >= 2, "HIGH")
             .when(points >= 1, "MODERATE").otherwise("LOW"))
    codes = F.array_compact(F.array(
        F.when(longshot, "LONGSHOT").when(underdog, "UNDERDOG"), F.when(thin, "THIN_LIQUIDITY"),
        F.when(soon, "IMMINENT"), F.when(vague, "AMBIGUOUS")))
    return {"risk_points": points, "risk_level": level, "risk_reasons": codes}


def clv_points(entry, close) -> Column:
    """Points by which the close beat the price paid (PRJ-23)."""
    entry, close = finite(entry), finite(close)
    return F.when((entry > 0) & (entry < 1) & (close >= 0) & (close <= 1), (close - entry) * 100.0)


def complement(price_a, price_b, outcomes) -> Column:
    """Price of one side of a pair, taken from the other side when unknown (FN-20)."""
    return F.coalesce(col(price_a), F.when(col(outcomes) == 2, 1.0 - col(price_b)))
