"""Behaviour metrics and the additive-evidence behaviour class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.functions.numeric import count_where
from tidemark.functions.numeric import total as sum_of
from tidemark.operators.prefix import exact_median, extreme, latest_n, lowest, scan, total
from tidemark.session import cut_lineage

DAY = 86400
SIDE = ["trader_id", "market_id", "outcome_index"]
# A stretch of the notional axis in micro-USD: 65 536 USD.
AXIS = 65_536_000_000


def considered_fills(activity: DataFrame, as_of, cfg=None) -> DataFrame:
    """The fills behaviour looks at: all up to the clock, or each trader's newest (WIN-10)."""
    n = merge_config(cfg)["behaviour"]["fills_considered"]
    known = activity.where(F.col("ts") <= as_of)
    if n is None:
        return known
    return latest_n(known, ["trader_id"], [F.desc("ts"), F.asc("dedupe_key")], n, ["dedupe_key"])


def fifo_lots(fills: DataFrame, keys: list[str] = SIDE) -> DataFrame:
    """First-in-first-out matches of sells against buys, one row per matched piece (WIN-3).

    Buys and sells are laid on one axis of cumulative notional; what was sold without being held
    is left out by the running minimum of the net. The sorted end points of both sides cut the
    axis into pieces that each belong to one buy and one sell, so matching needs no join. Along the
    axis neither side's times decrease, so the buy and the sell that end next are running minima
    from the far end. Two scans do it: one of the fills by day for what was bought, the net and its
    minimum, one of the end points by stretch of the axis for both times.
    """
    order, day = ["ts", "dedupe_key"], F.floor(F.col("ts") / F.lit(DAY))
    amount, is_buy = F.abs(F.col("usd")), F.col("side") == "BUY"
    traded = fills.where((amount > 0) & F.col("side").isin("BUY", "SELL")).select(
        *keys, "ts", "dedupe_key", "side", amount.alias("_usd"))
    usd = F.col("_usd")
    totals = scan(traded, keys, day, order, total("_bought", F.when(is_buy, usd).otherwise(0.0)),
                  lowest("_net", "_least", F.when(is_buy, usd).otherwise(-usd)))
    held = F.col("_net") - F.least(F.lit(0.0), F.col("_least"))
    # A buy ends where all buys so far do; a sell ends where they do less what is still held.
    micro = F.round(F.when(is_buy, F.col("_bought")).otherwise(F.col("_bought") - held) * 1e6).cast("long")
    ends = totals.select(*keys, micro.alias("_at"), F.when(is_buy, F.col("ts")).alias("_buy"),
                         F.when(~is_buy, F.col("ts")).alias("_sell")).where(F.col("_at") > 0)
    stretch = -F.floor(F.col("_at") / F.lit(AXIS))
    points = cut_lineage(ends.groupBy(*keys, "_at").agg(F.min("_buy").alias("_buy"), F.min("_sell").alias("_sell")))
    met = scan(points, keys, stretch, [F.desc("_at")], extreme("buy_ts", F.col("_buy"), False),
               extreme("sell_ts", F.col("_sell"), False))
    return met.where(F.col("buy_ts").isNotNull() & F.col("sell_ts").isNotNull()).select(
        *keys, "_at", "buy_ts", "sell_ts", (F.col("sell_ts") - F.col("buy_ts")).alias("hold_seconds"))


def both_sides_markets(fills: DataFrame) -> DataFrame:
    """Markets of which a trader bought more than one outcome (AGG-11)."""
    bought = fills.where((F.col("side") == "BUY") & F.col("outcome_index").isNotNull())
    return (bought.groupBy("trader_id", "market_id")
            .agg((F.min("outcome_index") < F.max("outcome_index")).alias("_both"))
            .groupBy("trader_id").agg(count_where(F.col("_both")).alias("both_sides_markets")))


def behaviour_metrics(fills: DataFrame, closed: DataFrame, portfolio: DataFrame, as_of,
                      cfg=None) -> DataFrame:
    """Frequency, size, turnover, breadth and holding metrics per trader (AGG-10, 11, 12)."""
    b = merge_config(cfg)["behaviour"]
    age, amount = F.lit(as_of) - F.col("ts"), F.abs(F.col("usd"))
    counts = fills.groupBy("trader_id").agg(
        F.count(F.lit(1)).alias("trade_count"),
        count_where(age <= 7 * DAY).alias("trades_7d"),
        count_where(age <= 30 * DAY).alias("trades_30d"),
        F.try_divide(count_where((amount > 0) & (amount < b["small_trade_usd"])),
                     count_where(amount > 0)).alias("small_trade_share"),
        sum_of(F.when(age <= 30 * DAY, amount)).alias("notional_30d"),
        F.count_distinct("market_id").alias("distinct_markets"))
    holds = exact_median(fifo_lots(fills), ["trader_id"], "hold_seconds", "median_hold_seconds")
    settled = closed.groupBy("trader_id").agg(
        F.count(F.lit(1)).alias("settled_count"), F.count("won").alias("held_count"))
    return (counts.join(both_sides_markets(fills), "trader_id", "left")
            .join(holds, "trader_id", "left").join(settled, "trader_id", "left")
            .join(portfolio.select("trader_id", "portfolio_value"), "trader_id", "left")
            .withColumns({
                "both_sides_markets": F.coalesce("both_sides_markets", F.lit(0)),
                "settled_count": F.coalesce("settled_count", F.lit(0)),
                "held_share": F.try_divide(F.col("held_count"), F.col("settled_count")),
                "turnover_ratio": F.try_divide(F.col("notional_30d"), F.col("portfolio_value"))})
            .drop("held_count", "notional_30d"))


def classify(metrics: DataFrame, cfg=None) -> DataFrame:
    """Behaviour class by additive evidence, with confidence and reason codes (SCR-2)."""
    b = merge_config(cfg)["behaviour"]
    weekly, hold = F.col("trades_7d"), F.col("median_hold_seconds")
    per_market = F.try_divide(F.col("trade_count"), F.col("distinct_markets"))
    settled_enough = F.col("settled_count") >= 10
    # Each rule: code, condition, points for discretionary, bot, scalper, maker.
    rules: list[tuple[str, Column, float, float, float, float]] = [
        ("VERY_HIGH_FREQUENCY", weekly >= b["very_high_frequency_7d"], 0, 3, 2, 0),
        ("HIGH_FREQUENCY", (weekly >= b["high_frequency_7d"])
         & (weekly < b["very_high_frequency_7d"]), 0, 1.5, 1.5, 0),
        ("VERY_SHORT_HOLDS", hold <= b["scalp_hold_seconds"], 0, 1, 3, 0),
        ("LONG_HOLDS", (hold > b["scalp_hold_seconds"]) & (hold >= 7 * DAY), 2, 0, 0, 0),
        ("BOTH_SIDES", F.col("both_sides_markets") >= b["both_sides_markets"], 0, 0, 0, 3),
        ("SMALL_TRADES", (F.col("small_trade_share") >= b["small_trade_share"])
         & (F.col("trade_count") >= 100), 0, 2, 0, 1),
        ("HIGH_TURNOVER", F.col("turnover_ratio") >= b["high_turnover"], 0, 0, 1.5, 1),
        ("RARELY_HELD", settled_enough & (F.col("held_share") <= b["low_held_share"]),
         0, 0, 1.5, 0),
        ("USUALLY_HELD", settled_enough & (F.col("held_share") > b["low_held_share"])
         & (F.col("held_share") >= 0.6), 2, 0, 0, 0),
        ("FREQUENT_REENTRY", per_market >= 20, 0, 0, 1.5, 1),
        ("FEW_PER_MARKET", per_market <= 4, 1, 0, 0, 0),
    ]
    names = ["DISCRETIONARY", "POSSIBLE_BOT", "SCALPER", "MARKET_MAKER"]
    start = [1.0, 0.0, 0.0, 0.0]
    scores = {f"_s{i}": sum((F.when(rule[1], float(rule[2 + i])).otherwise(0.0)
                             for rule in rules if rule[2 + i]), F.lit(start[i]))
              for i in range(4)}
    ranked = F.array_sort(F.array(*[
        F.struct((-F.col(f"_s{i}")).alias("minus"), F.lit(i).alias("place"),
                 F.lit(name).alias("name")) for i, name in enumerate(names)]))
    top, margin = -F.col("_rank")[0]["minus"], F.col("_rank")[1]["minus"] - F.col("_rank")[0]["minus"]
    enough = F.col("trade_count") >= 5
    high, moderate = (top >= 5) & (margin >= 2), (top >= 3) & (margin >= 1)
    chosen = F.when(top <= 1, "DISCRETIONARY").otherwise(F.col("_rank")[0]["name"])
    codes = [F.when(rule[1] & F.element_at(
        F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(rule[2 + i] > 0))]),
        F.coalesce("behaviour_class_", F.lit("DISCRETIONARY"))), rule[0]) for rule in rules]
    return (metrics.withColumns(scores).withColumn("_rank", ranked)
            .withColumns({
                "behaviour_class_": chosen,
                "behaviour_confidence": F.when(~enough, 0.0).when(high, 0.9).when(moderate, 0.6)
                .otherwise(0.3)})
            .withColumns({
                "behaviour_class": F.when(enough, F.col("behaviour_class_")).otherwise("UNKNOWN"),
                "behaviour_reasons": F.when(~enough, F.array(F.lit("TOO_FEW_TRADES")))
                .otherwise(F.array_compact(F.array(*codes)))})
            .withColumn("excludable", (F.col("behaviour_confidence") >= 0.6)
                        & F.col("behaviour_class").isin(names[1:]))
            .drop("_rank", "behaviour_class_", *scores))


def behaviour(activity: DataFrame, closed: DataFrame, portfolio: DataFrame, as_of,
              cfg=None) -> DataFrame:
    """Metrics and class of every trader with activity up to the clock."""
    fills = cut_lineage(considered_fills(activity, as_of, cfg))
    return classify(behaviour_metrics(fills, closed, portfolio, as_of, cfg), cfg)
