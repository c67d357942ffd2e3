"""Order books, stake ladders, tape flow, event overround and the pre-trade check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.functions.numeric import count_where, finite

SIDE = ["market_id", "outcome_index"]


def book_summary(levels: DataFrame) -> DataFrame:
    """Best bid and ask, spread, mid and depth per token (AGG-23).

    Ask depth is valued at what the other side would pay, the sum of (1 - price) * size.
    """
    price, size = finite("price"), finite("size")
    usable = price.isNotNull() & size.isNotNull()
    bid, ask = usable & (F.col("kind") == "BID"), usable & (F.col("kind") == "ASK")
    best = levels.groupBy("token_id").agg(
        F.max(F.when(bid, price)).alias("best_bid"), F.min(F.when(ask, price)).alias("best_ask"),
        F.sum(F.when(bid, price * size)).alias("bid_depth_usd"),
        F.sum(F.when(ask, (1.0 - price) * size)).alias("ask_depth_usd"))
    return best.withColumns({"spread": F.col("best_ask") - F.col("best_bid"),
                             "mid": (F.col("best_bid") + F.col("best_ask")) / 2.0})


def usable_asks(levels: DataFrame) -> DataFrame:
    """Ask levels that can be bought from, one row per price.

    Levels at one price are added up first, so a ladder has at most as many rows as the token has
    price ticks.
    """
    price, size = finite("price"), finite("size")
    kept = levels.where((F.col("kind") == "ASK") & (price > 0) & (price < 1) & (size > 0))
    return kept.groupBy("token_id", price.alias("price")).agg(
        F.sum(size).alias("size"), F.count(F.lit(1)).alias("levels"))


def ladder_fill(levels: DataFrame, stakes=(1.0, 10.0, 50.0)) -> DataFrame:
    """What a stake buys walking up the asks, per token and stake (AGG-24, WIN-4)."""
    asks = usable_asks(levels)
    up = W.partitionBy("token_id").orderBy("price").rowsBetween(W.unboundedPreceding, -1)
    usd = F.col("price") * F.col("size")
    ladder = asks.withColumns({"_usd": usd, "_before": F.coalesce(F.sum(usd).over(up), F.lit(0.0))})
    offered = ladder.withColumn("stake", F.explode(F.array(*[F.lit(float(s)) for s in stakes])))
    left = F.col("stake") - F.col("_before")
    spent = F.when(left > 1e-9, F.least(left, F.col("_usd"))).otherwise(0.0)
    used = left > 1e-9
    facts = offered.withColumn("_spent", spent).groupBy("token_id", "stake").agg(
        F.sum("_spent").alias("filled_usd"),
        F.sum(F.when(F.col("_spent") < F.col("_usd"), F.col("_spent") / F.col("price"))
              .otherwise(F.col("size"))).alias("shares"),
        F.min("price").alias("best_ask"), F.max(F.when(used, F.col("price"))).alias("worst_price"),
        F.sum(F.when(used, F.col("levels")).otherwise(0)).alias("levels_consumed"),
        F.min_by("_usd", "price").alias("best_ask_depth_usd"), F.sum("_usd").alias("total_depth_usd"))
    average = F.col("filled_usd") / F.col("shares")
    return facts.withColumns({
        "unfilled_usd": F.col("stake") - F.col("filled_usd"), "average_price": average,
        "slippage_points": (average - F.col("best_ask")) * 100.0})


def tape_flow(trades: DataFrame, as_of: int, cfg=None) -> DataFrame:
    """Money for and against each side in the trailing windows (AGG-20).

    One pass over the fills sums every window per (market, outcome) before the shuffle; a side's
    opposite is the market total less its own part.
    """
    hours = merge_config(cfg)["tape"]["windows"]
    usd = F.col("size") * F.col("price")
    kept = trades.where(F.col("ts").isNotNull() & (usd > 0)
                        & (F.col("ts") >= as_of - max(hours) * 3600))
    windows = F.array(*[F.struct(F.lit(h).alias("hours"), F.lit(as_of - h * 3600).alias("since"))
                        for h in hours])
    hit = (kept.withColumn("_usd", usd).withColumn("_w", F.explode(windows))
           .where(F.col("ts") >= F.col("_w.since")))
    own = hit.groupBy(*SIDE, F.col("_w.hours").alias("hours")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_usd").alias("for_usd"),
        F.sum("size").alias("_shares"), F.max("_usd").alias("_largest"))
    market = own.groupBy("market_id", "hours").agg(
        F.sum("_n").alias("fills"), F.sum("for_usd").alias("_total"))
    sides = trades.select(*SIDE).distinct()
    frame = sides.withColumn("hours", F.explode(F.array(*[F.lit(h) for h in hours])))
    joined = (frame.join(own, [*SIDE, "hours"], "left").join(market, ["market_id", "hours"], "left")
              .fillna({"fills": 0, "for_usd": 0.0, "_total": 0.0}))
    return joined.select(
        *SIDE, "hours", "fills", "for_usd", (F.col("_total") - F.col("for_usd")).alias("against_usd"),
        (F.col("for_usd") * 2.0 - F.col("_total")).alias("net_usd"),
        F.when(F.col("_total") > 0, F.col("for_usd") / F.col("_total")).alias("for_share"),
        F.try_divide(F.col("for_usd"), F.col("_shares")).alias("vwap"),
        F.col("_largest").alias("largest_for_usd"))


def tape_reading(flow: DataFrame, cfg=None) -> DataFrame:
    """Per side: first significant window, price pressure, quiet flag (AGG-20)."""
    t = merge_config(cfg)["tape"]
    tight, wide = min(t["windows"]), max(t["windows"])
    volume = F.col("for_usd") + F.col("against_usd")
    strong = (F.col("fills") >= t["min_fills"]) & (volume >= t["min_usd"])
    row = F.struct("hours", "fills", "for_usd", "against_usd", "net_usd", "for_share")

    def at(hours, column):
        return F.max(F.when(F.col("hours") == hours, F.col(column)))

    sides = flow.groupBy(*SIDE).agg(
        F.min_by(F.when(strong, row), F.when(strong, F.col("hours"))).alias("_w"),
        ((at(tight, "vwap") - at(wide, "vwap")) * 100.0).alias("pressure_points"),
        at(wide, "largest_for_usd").alias("largest_for_usd"),
        (F.coalesce(at(wide, "fills"), F.lit(0)) < t["quiet_fills"]).alias("too_quiet"))
    return sides.select(*SIDE, F.col("_w.hours").alias("window_hours"),
                        F.col("_w.net_usd").alias("window_net_usd"),
                        F.col("_w.for_share").alias("window_for_share"),
                        "pressure_points", "largest_for_usd", "too_quiet")


def overround(legs: DataFrame, cfg=None) -> DataFrame:
    """Cost of every outcome of an event whose legs provably exclude each other (AGG-22, JOIN-18).

    Either all legs are marked negative-risk, or the event is two or three Yes/No moneylines.
    """
    wide = merge_config(cfg)["deep_dive"]["max_leg_spread"]
    names = F.transform("outcomes", lambda o: F.lower(F.trim(o)))
    yes_no = (F.size("outcomes") == 2) & F.array_contains(names, "yes") & F.array_contains(names, "no")
    at = F.greatest(F.array_position(names, "yes") - 1, F.lit(0)).cast("int")
    mid = finite(F.get("prices", at))
    ask = F.when(at == 0, finite("best_ask"))
    quoted = ask.isNotNull() & (F.col("spread") <= wide)
    sums = legs.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("legs"), F.bool_and(F.coalesce("neg_risk", F.lit(False))).alias("_neg"),
        F.bool_and(F.coalesce(F.col("sports_market_type") == "moneyline", F.lit(False))
                   & yes_no).alias("_match"),
        F.count(mid).alias("_mids"), F.sum(mid).alias("mid_sum"),
        count_where(quoted).alias("_asks"), F.sum(ask).alias("_ask_sum"))
    kind = (F.when(F.col("_neg"), "NEG_RISK")
            .when(F.col("_match") & (F.col("legs") <= 3), "MATCH_RESULT"))
    sums = sums.withColumn("kind", kind).where(
        (F.col("legs") >= 2) & F.col("kind").isNotNull() & (F.col("_mids") == F.col("legs")))
    asked = F.when(F.col("_asks") == F.col("legs"), F.col("_ask_sum"))
    return sums.select("event_id", "kind", "legs", "mid_sum",
                       ((F.col("mid_sum") - 1.0) * 100.0).alias("mid_points"),
                       asked.alias("ask_sum"), ((asked - 1.0) * 100.0).alias("ask_points"))


def pre_trade_findings(board: DataFrame, fills: DataFrame, vig: DataFrame, tape: DataFrame,
                       cfg=None) -> DataFrame:
    """Finding codes for every listed side before a trade (SCR-9).

    ``fills`` is the ladder of :func:`ladder_fill`, ``vig`` the event overround and ``tape`` the
    side readings of :func:`tape_reading`.
    """
    d = merge_config(cfg)["deep_dive"]
    unit, large = d["stakes"][0], d["stakes"][-1]
    at_one = fills.where(F.col("stake") == unit).select(
        "token_id", F.col("average_price").alias("_live"), F.col("best_ask_depth_usd").alias("_depth"))
    at_most = fills.where(F.col("stake") == large).select(
        "token_id", F.col("slippage_points").alias("_slip"))
    joined = (board.select(*SIDE, "token_id", "event_id", "effective_price", "model_mid",
                           "net_edge_points")
              .join(at_one, "token_id", "left").join(at_most, "token_id", "left")
              .join(vig.select("event_id", F.coalesce("ask_points", "mid_points").alias("_vig")),
                    "event_id", "left")
              .join(tape, SIDE, "left"))
    c = F.col
    drift = (c("_live") - c("effective_price")) * 100.0
    edge = (c("model_mid") - c("_live")) * 100.0
    findings = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(code).alias("finding"),
                                                              F.lit(tone).alias("tone")))
        for code, tone, hit in [
            ("no-book", "STOP", c("_live").isNull()),
            ("price-moved", "WARNING", drift >= d["moved_points"]),
            ("price-moved", "GOOD", drift <= -d["moved_points"]),
            ("edge-gone", "STOP", edge <= 0),
            ("edge-shrunk", "WARNING", (edge > 0)
             & (edge < c("net_edge_points") - d["shrunk_points"])),
            ("thin-top", "WARNING", c("_depth") < d["thin_top_usd"]),
            ("depth-ok", "GOOD", c("_depth") >= d["thin_top_usd"]),
            ("shallow-book", "WARNING", c("_slip") > d["shallow_points"]),
            ("vig-exceeds-edge", "STOP", (c("_vig") > 0) & (c("_vig") >= c("net_edge_points"))),
            ("vig", "NEUTRAL", (c("_vig") > 0)
             & ~F.coalesce(c("_vig") >= c("net_edge_points"), F.lit(False))),
            ("underround", "GOOD", c("_vig") <= 0),
            ("quiet-tape", "NEUTRAL", c("window_hours").isNull()),
            ("flow-with", "GOOD", c("window_net_usd") > 0),
            ("flow-against", "WARNING", c("window_net_usd") <= 0)]]))
    return (joined.select(*SIDE, edge.alias("live_edge_points"), F.explode(findings).alias("_f"))
            .select(*SIDE, "live_edge_points", "_f.finding", "_f.tone"))
