"""Landed records into domain rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import ACTIVITY_TYPES
from tidemark.functions import parse as P
from tidemark.functions.numeric import epoch, finite, first_number
from tidemark.functions.text import resolution_clarity, resolve_category

NO_TAGS = "array<string>"


def normalize_markets(raw: DataFrame) -> DataFrame:
    """Typed market rows with flags, resolution, clarity, category and league (PRJ-1)."""
    c = F.col
    context = {"event_id": "string", "event_slug": "string", "event_title": "string",
               "event_open_interest": "double", "tags": NO_TAGS, "arrival": "string"}
    for name, kind in context.items():
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(kind))
    kept = raw.where(F.length("conditionId") > 0)
    closed = F.coalesce(c("closed"), F.lit(False))
    prices = P.json_numbers("outcomePrices")
    rows = kept.select(
        c("conditionId").alias("condition_id"), F.coalesce("question", F.lit("Unknown market")).alias("question"),
        F.coalesce("question", "event_title").alias("_text"),
        "slug", "event_id", "event_slug", "event_title", "description", "arrival",
        F.coalesce("tags", F.array().cast(NO_TAGS)).alias("tags"),
        P.json_strings("outcomes").alias("outcomes"), P.json_strings("clobTokenIds").alias("token_ids"),
        prices.alias("prices"), finite("bestBid").alias("best_bid"), finite("bestAsk").alias("best_ask"),
        finite("spread").alias("spread"), finite("lastTradePrice").alias("last_trade_price"),
        first_number("liquidityNum", "liquidity", "liquidityClob").alias("liquidity"),
        first_number("volumeNum", "volume", "volumeClob").alias("volume"),
        first_number("volume24hr", "volume24hrClob").alias("volume_24h"),
        first_number("volume1wk").alias("volume_1wk"),
        first_number("event_open_interest").alias("open_interest"),
        epoch(P.timestamp_of(F.coalesce("startDateIso", "startDate"))).alias("start_ts"),
        epoch(P.timestamp_of(F.coalesce("endDateIso", "endDate"))).alias("end_ts"),
        F.coalesce("active", F.lit(True)).alias("active"), closed.alias("closed"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
        F.coalesce("acceptingOrders", F.lit(True)).alias("accepting_orders"),
        F.coalesce("enableOrderBook", F.lit(True)).alias("enable_order_book"),
        F.coalesce("negRisk", F.lit(False)).alias("neg_risk"),
        P.resolved_outcome(prices, closed).alias("winner"),
        epoch(P.kickoff_of("gameStartTime")).alias("kickoff_ts"),
        c("sportsMarketType").alias("sports_market_type"), P.league_of("tags").alias("league"),
        *[v.alias(k) for k, v in resolution_clarity("description", "resolutionSource").items()])
    rows = rows.withColumn("resolved", c("closed") & c("winner").isNotNull())
    unique = dedupe_markets(rows)
    return resolve_category(unique, "tags", "_text").drop("_text")


def dedupe_markets(markets: DataFrame) -> DataFrame:
    """One row per market that arrived under several events (SET-2).

    Copies differ only in their event context; the last to arrive is kept, by the ``arrival`` that
    the scan of events gives (any ordered type will do).
    """
    rest = [c for c in markets.columns if c not in ("condition_id", "arrival")]
    kept = markets.groupBy("condition_id").agg(F.max_by(F.struct(*rest), "arrival").alias("_row"))
    return kept.select("condition_id", "_row.*")


def ingestible(markets: DataFrame) -> DataFrame:
    """Markets with an order book or any price (FLT-3)."""
    return markets.where(F.col("enable_order_book") | (F.size("prices") > 0))


def _outcome():
    return F.coalesce("outcome", F.when(F.col("outcomeIndex") == 0, "Yes").otherwise("No"))


def normalize_positions(raw: DataFrame) -> DataFrame:
    """Typed open positions (PRJ-2)."""
    kept = raw.where((F.length("asset") > 0) & (F.length("conditionId") > 0) & finite("size").isNotNull())
    money = {"avgPrice": "avg_price", "initialValue": "initial_value", "currentValue": "current_value",
             "cashPnl": "cash_pnl", "percentPnl": "percent_pnl", "totalBought": "shares_bought",
             "realizedPnl": "realized_pnl", "curPrice": "cur_price"}
    flags = {"redeemable": "redeemable", "mergeable": "mergeable", "negativeRisk": "negative_risk"}
    return kept.select(
        P.wallet_of("proxyWallet").alias("wallet"), "asset", F.col("conditionId").alias("condition_id"),
        _outcome().alias("outcome"), F.coalesce("outcomeIndex", F.lit(0)).alias("outcome_index"),
        finite("size").alias("size"), *[finite(k).alias(v) for k, v in money.items()],
        *[F.coalesce(k, F.lit(False)).alias(v) for k, v in flags.items()], "title",
        epoch(P.timestamp_of("endDate")).alias("end_ts"))


def normalize_closed(raw: DataFrame) -> DataFrame:
    """Typed settled positions; cost is shares bought times average price (PRJ-3)."""
    kept = raw.where((F.length("asset") > 0) & (F.length("conditionId") > 0))
    shares, price = finite("totalBought"), finite("avgPrice")
    return kept.select(
        P.wallet_of("proxyWallet").alias("wallet"), "asset", F.col("conditionId").alias("condition_id"),
        F.coalesce("title", F.lit("Unknown market")).alias("title"), _outcome().alias("outcome"),
        F.coalesce("outcomeIndex", F.lit(0)).alias("outcome_index"), price.alias("avg_price"),
        shares.alias("shares"), F.when(price > 0, shares * price).alias("cost_basis_usd"),
        finite("realizedPnl").alias("realized_pnl"), finite("curPrice").alias("cur_price"),
        P.won_of(finite("curPrice")).alias("won"),
        epoch(P.timestamp_of("endDate")).alias("end_ts"),
        F.when(F.col("timestamp") > 0, F.col("timestamp")).alias("resolved_ts"))


def number_text(value):
    """A double as wire text: plain decimals from 1e-6 up to 1e21, exponents outside, never ``.0``."""
    value = F.coalesce(value, F.lit(0.0))
    size = F.abs(value)
    plain = F.when(size >= 1, value.cast("decimal(38,17)").cast("string")).otherwise(
        value.cast("decimal(38,30)").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    spelled = F.regexp_replace(value.cast("string"), r"(?:\.0)?E(-?)", "e$1")
    spelled = F.regexp_replace(spelled, r"e(\d)", "e+$1")
    return F.when(size == 0, "0").when((size >= 1e-6) & (size < 1e21), plain).otherwise(spelled)


def normalize_activity(raw: DataFrame) -> DataFrame:
    """Typed fills with their dedupe key (PRJ-4)."""
    kept = raw.where((F.col("timestamp") > 0) & (F.length("conditionId") > 0))
    kind = F.when(F.col("type").isin(ACTIVITY_TYPES), F.col("type")).otherwise("OTHER")
    wallet = P.wallet_of("proxyWallet")
    key = F.concat_ws(":", wallet, F.coalesce("transactionHash", F.lit("no-tx")),
                      F.coalesce("asset", "conditionId"), kind, F.coalesce("side", F.lit("-")),
                      F.col("timestamp").cast("string"), number_text(finite("size")))
    return kept.select(
        wallet.alias("wallet"), key.alias("dedupe_key"), F.col("timestamp").alias("ts"),
        F.col("conditionId").alias("condition_id"), kind.alias("type"),
        F.when(F.col("side").isin("BUY", "SELL"), F.col("side")).alias("side"),
        finite("size").alias("size"), finite("usdcSize").alias("usd"), finite("price").alias("price"),
        "asset", "outcome", F.col("outcomeIndex").alias("outcome_index"), "title",
        F.coalesce(F.nullif("name", F.lit("")), F.nullif("pseudonym", F.lit(""))).alias("profile_name"))
