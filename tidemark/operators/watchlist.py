"""Which wallets to follow and refresh, what to keep, and repairs of landed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.fixed_values import TIERS
from tidemark.functions.numeric import count_where
from tidemark.functions.parse import wallet_of


def first_rows(df: DataFrame, order: list, n: int | None) -> DataFrame:
    """The first ``n`` rows; all of them, in any order, if ``n`` is None."""
    return df if n is None else df.orderBy(*order).limit(n)


def discover_holders(markets: DataFrame, holders: DataFrame, traders: DataFrame,
                     cfg=None) -> DataFrame:
    """New wallets that hold several traded markets, or of the largest ones (AGG-25, SET-4).

    ``holders`` has market_id, wallet, shares and optionally a public name. The specialty is the
    most frequent category among a wallet's markets, unknown on a tie.
    """
    d = merge_config(cfg)["discover"]
    traded = markets.where(F.col("volume") > 0)
    sampled = first_rows(traded, [F.desc("volume"), "market_id"], d["markets"]).select(
        "market_id", "category", "volume")
    held = (holders.where(F.col("shares") >= d["min_shares"])
            .withColumn("wallet", wallet_of("wallet")).where(F.col("wallet") != "")
            .join(sampled, "market_id"))
    per_market = held.groupBy("wallet", "market_id", "category").agg(
        F.sum("shares").alias("shares"),
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("volume"))).alias("name"),
        F.max("volume").alias("volume"))
    per_category = per_market.groupBy("wallet", "category").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("shares").alias("_s"),
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("volume"))).alias("name"),
        F.max(F.when(F.col("name").isNotNull(), F.col("volume"))).alias("_v"))
    known = F.col("category") != "UNKNOWN"
    ranked = per_category.groupBy("wallet").agg(
        F.sum("_n").alias("markets"), F.sum("_s").alias("shares"),
        F.max_by("name", "_v").alias("name"),
        F.array_sort(F.collect_list(F.when(known, F.struct((-F.col("_n")).alias("n"), "category"))))
        .alias("_c"))
    first, second = F.get("_c", F.lit(0)), F.get("_c", F.lit(1))
    tie = second.isNotNull() & (first["n"] == second["n"])
    fallback = F.concat(F.substring("wallet", 1, 6), F.lit("..."), F.right("wallet", F.lit(4)))
    new = ranked.join(traders.select("wallet"), "wallet", "left_anti").where(
        F.col("markets") >= d["min_markets"])
    return (first_rows(new, [F.desc("markets"), F.desc("shares"), "wallet"], d["max_new"])
            .select("wallet", F.coalesce("name", fallback).alias("display_name"),
                    F.when(first.isNull() | tie, "UNKNOWN").otherwise(first["category"])
                    .alias("specialty"), "markets", "shares", F.lit("HOLDERS").alias("source")))


def discover_tape(trades: DataFrame, traders: DataFrame, cfg=None) -> DataFrame:
    """New wallets seen trading real money in several markets (AGG-26)."""
    d = merge_config(cfg)["discover"]
    usd = F.coalesce(F.col("size") * F.col("price"), F.lit(0.0))
    seen = (trades.withColumns({"_usd": usd, "wallet": wallet_of("wallet")})
            .where((F.col("_usd") >= d["tape_min_usd"]) & (F.col("wallet") != ""))
            .groupBy("wallet", "market_id").agg(F.sum("_usd").alias("_usd"))
            .groupBy("wallet").agg(F.count(F.lit(1)).alias("markets"), F.sum("_usd").alias("notional")))
    new = seen.join(traders.select("wallet"), "wallet", "left_anti").where(
        F.col("markets") >= d["tape_min_markets"])
    return first_rows(new, [F.desc("markets"), F.desc("notional"), "wallet"], d["tape_max_new"]).withColumns(
        {"specialty": F.lit("UNKNOWN"), "source": F.lit("HOLDERS")})


def new_leaderboard_wallets(leaderboard: DataFrame, traders: DataFrame) -> DataFrame:
    """Leaderboard entries not followed yet, one per wallet (SRC-10)."""
    rows = leaderboard.withColumn("wallet", wallet_of("wallet")).dropDuplicates(["wallet"])
    return rows.join(traders.select("wallet"), "wallet", "left_anti")


def classified(traders: DataFrame, as_of: int, cfg=None) -> DataFrame:
    """Refresh tier and whether a refresh is due."""
    s = merge_config(cfg)["selection"]
    idle = F.when(F.col("last_activity_ts") > 0, (as_of - F.col("last_activity_ts")) / 3600.0)
    score = F.coalesce("smart_score", F.lit(0.0))
    tier = (F.when(F.col("last_synced_ts").isNull(), "NEW")
            .when(idle.isNull() | (idle > s["dormant_hours"]), "DORMANT")
            .when(F.col("has_sync_error"), "COLD")
            .when((score >= s["hot_score"]) & (idle <= s["hot_hours"]), "HOT")
            .when((idle <= s["warm_hours"]) | (score >= s["warm_score"]), "WARM").otherwise("COLD"))
    refresh = F.element_at(F.create_map(*[F.lit(x) for t in TIERS for x in (t[0], t[1])]), F.col("tier"))
    priority = F.element_at(F.create_map(*[F.lit(x) for t in TIERS for x in (t[0], t[2])]), F.col("tier"))
    age = (as_of - F.col("last_synced_ts")) / 3600.0
    return traders.withColumn("tier", tier).withColumns({
        "priority": priority, "due": F.coalesce(age >= refresh, F.lit(True))})


def refresh_candidates(traders: DataFrame, budget: int, as_of: int,
                       cfg=None) -> tuple[DataFrame, DataFrame]:
    """Wallets to refresh within the budget, and what was deferred or not due (TOP-4).

    A quarter of the slots is kept for new wallets; slots either group leaves unused go to the
    other. Only the first ``budget`` rows of each group are ever ranked.
    """
    s = merge_config(cfg)["selection"]
    judged = classified(traders, as_of, cfg)
    due = judged.where("due")
    stale = F.coalesce("last_synced_ts", F.lit(0))
    reserved = -int(-budget * min(1.0, max(0.0, s["new_share"])) // 1)
    fresh = due.where(F.col("tier") == "NEW").orderBy(stale, "trader_id").limit(budget)
    known = due.where(F.col("tier") != "NEW").orderBy("priority", stale, "trader_id").limit(budget)
    group = W.partitionBy("_new").orderBy("priority", stale, "trader_id")
    pool = (fresh.withColumn("_new", F.lit(True)).unionByName(known.withColumn("_new", F.lit(False)))
            .withColumn("_at", F.row_number().over(group)))
    sizes = pool.agg(count_where(F.col("_new")).alias("_f"), count_where(~F.col("_new")).alias("_k"))
    first = F.least(F.col("_f"), F.lit(reserved))
    rest = F.least(F.col("_k"), budget - first)
    sizes = sizes.select(F.least(F.col("_f"), budget - rest).alias("_fresh"), rest.alias("_known"),
                         F.lit(1).alias("_one"))
    picked = (pool.withColumn("_one", F.lit(1)).join(sizes, "_one")
              .where(F.col("_at") <= F.when(F.col("_new"), F.col("_fresh")).otherwise(F.col("_known"))))
    depth = {name: F.element_at(F.create_map(*[F.lit(x) for t in TIERS for x in (t[0], t[i])]),
                                F.col("tier")) for name, i in (("closed_depth", 3), ("fill_depth", 4))}
    selected = picked.select("trader_id", "tier", "priority", "last_synced_ts").withColumns(depth)
    chosen = selected.agg(F.count(F.lit(1)).alias("selected")).withColumn("_one", F.lit(1))
    counts = (judged.agg(count_where(F.col("due")).alias("_due"),
                         count_where(~F.col("due")).alias("not_due"))
              .withColumn("_one", F.lit(1)).join(chosen, "_one")
              .select("selected", (F.col("_due") - F.col("selected")).alias("deferred"), "not_due"))
    return selected, counts


def cap_watchlist(traders: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """Traders kept when the list is over ``n``: manual ones and the ``n`` best others (TOP-5)."""
    size = traders.agg((F.count(F.lit(1)) > n).alias("_over")).withColumn("_one", F.lit(1))
    others = traders.where(F.col("source") != "MANUAL").join(
        scores.select("trader_id", "smart_score"), "trader_id", "left")
    best = (others.orderBy(F.desc_nulls_last("smart_score"), F.desc_nulls_last("last_activity_ts"),
                           "trader_id").limit(n).select("trader_id", F.lit(True).alias("_best")))
    marked = (traders.withColumn("_one", F.lit(1)).join(size, "_one")
              .join(best, "trader_id", "left"))
    kept = ~F.col("_over") | (F.col("source") == "MANUAL") | F.col("_best")
    return marked.where(F.coalesce(kept, F.lit(False))).drop("_one", "_over", "_best")


def keep_recent(df: DataFrame, ts: str, days: int, as_of: int) -> DataFrame:
    """Rows not older than ``days``; 0 keeps everything (FLT-9)."""
    return df if days <= 0 else df.where(F.col(ts) >= as_of - days * 86400)


def keep_markets(markets: DataFrame, positions: DataFrame, closed: DataFrame, bets: DataFrame,
                 days: int, as_of: int) -> DataFrame:
    """Drop old resolved markets nothing refers to any more (JOIN-3, FLT-9)."""
    if days <= 0:
        return markets
    old = markets.where(F.col("resolved") & (F.col("resolved_ts") < as_of - days * 86400))
    for used in (positions, closed, bets):
        old = old.join(used.select("market_id"), "market_id", "left_anti")
    return markets.join(old.select("market_id"), "market_id", "left_anti")


def stale_markets(markets: DataFrame, positions: DataFrame, as_of: int,
                  limit: int | None = None) -> DataFrame:
    """Unresolved held markets not refreshed for an hour, or ever (FLT-11)."""
    old = F.col("last_synced_ts").isNull() | (F.col("last_synced_ts") < as_of - 3600)
    held = markets.where(~F.col("resolved") & old).join(positions.select("market_id"), "market_id", "left_semi")
    return first_rows(held, [F.asc_nulls_first("last_synced_ts"), "market_id"], limit)


def relink(rows: DataFrame, markets: DataFrame) -> DataFrame:
    """Fill a missing market id from the condition id (JOIN-10)."""
    known = markets.select("condition_id", F.col("market_id").alias("_m"))
    return (rows.join(known, "condition_id", "left")
            .withColumn("market_id", F.coalesce("market_id", "_m")).drop("_m"))


def unknown_conditions(rows: DataFrame) -> DataFrame:
    """Condition ids still without a market after relinking (JOIN-10)."""
    return rows.where(F.col("market_id").isNull()).agg(
        F.count_distinct("condition_id").alias("still_unknown"))


def repair_resolved_at(markets: DataFrame, closed: DataFrame, as_of: int) -> DataFrame:
    """Replace an untrustworthy settlement time by the earliest clean one, else clear it (AGG-18)."""
    clean = closed.where(F.col("won").isNotNull() & F.col("resolved_ts").isNotNull())
    first = clean.groupBy("market_id").agg(F.min("resolved_ts").alias("_first"))
    stamp = F.col("resolved_ts")
    ahead = F.coalesce(F.col("end_ts") > as_of, F.lit(False))
    untrusted = stamp.isNull() | (stamp > as_of) | ahead
    fixed = F.when(F.col("_first") <= as_of, F.col("_first"))
    return (markets.join(first, "market_id", "left")
            .withColumn("resolved_ts", F.when(F.col("resolved") & untrusted, fixed).otherwise(stamp))
            .drop("_first"))


def price_backfill(markets: DataFrame, series: DataFrame, fresh_after: int) -> DataFrame:
    """Tokens of the selected markets whose curve is missing or old (SNK-9)."""
    tokens = markets.select("market_id", F.posexplode("token_ids").alias("outcome_index", "token_id"))
    fresh = series.where(F.col("fetched_ts") > fresh_after).select("token_id")
    return tokens.where(F.col("token_id").isNotNull()).join(fresh, "token_id", "left_anti")


def curve_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points, first and last time of each curve (SNK-10)."""
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.min("t").alias("first_t"),
                                     F.max("t").alias("last_t"))
