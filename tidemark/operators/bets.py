"""The own-bet log: entries, imports, closing-line value, settlement and record slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.fixed_values import PRICE_SLICES, SCORE_SLICES
from tidemark.functions.numeric import band_label, count_where, total
from tidemark.functions.pricing import clv_points, tradeable_price
from tidemark.operators.asof import asof_last

SIDE = ["market_id", "outcome_index"]


def record_bets(requests: DataFrame, board: DataFrame, fills: DataFrame) -> DataFrame:
    """Bet rows for the sides asked for, at the ladder price where a book exists (PRJ-25).

    ``requests`` has market_id, outcome_index and stake; ``fills`` is the ladder for those stakes.
    """
    live = fills.select("token_id", "stake", F.col("average_price").alias("_live"))
    joined = requests.join(board.select(
        *SIDE, "token_id", "outcome_label", "question", "effective_price", "current_price",
        F.col("horizon").alias("horizon_score"), "model_mid", "net_edge_points", "qualified_count",
        "kickoff_ts", "end_ts"), SIDE).join(live, ["token_id", "stake"], "left")
    entry = F.coalesce("_live", "effective_price", "current_price")
    return (joined.withColumns({
        "entry_price": entry, "closes_ts": F.coalesce("kickoff_ts", "end_ts"),
        "clv_source": F.when(F.col("_live").isNull(), "ENTRY_FROM_SNAPSHOT"),
        "source": F.lit("MANUAL")})
        .where(tradeable_price("entry_price"))
        .drop("_live", "effective_price", "current_price", "kickoff_ts", "end_ts", "token_id"))


def import_bets(fills: DataFrame, markets: DataFrame, board: DataFrame, bets: DataFrame) -> DataFrame:
    """Buys of the own wallet as bets, once per external id, with the board's view (JOIN-16)."""
    buys = fills.where((F.col("side") == "BUY") & F.col("size").isNotNull()
                       & tradeable_price("price"))
    context = markets.select("market_id", F.coalesce("kickoff_ts", "end_ts").alias("closes_ts"))
    view = board.select(*SIDE, F.col("horizon").alias("horizon_score"), "model_mid",
                        "net_edge_points", "qualified_count")
    fresh = buys.join(bets.where(F.col("external_id").isNotNull()).select(
        F.col("external_id").alias("dedupe_key")), "dedupe_key", "left_anti")
    return (fresh.dropDuplicates(["dedupe_key"]).join(context, "market_id").join(view, SIDE, "left")
            .select(F.col("dedupe_key").alias("external_id"), F.lit("WALLET").alias("source"), *SIDE,
                    "asset", F.col("price").alias("entry_price"),
                    F.coalesce("usd", F.col("size") * F.col("price")).alias("stake"),
                    F.col("ts").alias("placed_ts"), "closes_ts", "horizon_score", "model_mid",
                    "net_edge_points", "qualified_count"))


def close_bets(bets: DataFrame, curves: DataFrame, as_of: int, cfg=None) -> DataFrame:
    """Closing price and closing-line value of bets past their close (JOIN-17, PRJ-23).

    A bet without any sample at or before its close is marked unavailable; one still open, or
    without a close, has no source yet.
    """
    delay = merge_config(cfg)["bets"]["settle_delay_seconds"]
    due = F.col("closes_ts") <= as_of - delay
    samples = curves.select(*SIDE, F.col("t").alias("_ct"), "p", "seq")
    priced = asof_last(bets.where(due), samples, SIDE, "closes_ts", "_ct", {"closing_price": "p"},
                       tie=["seq"])
    priced = priced.withColumns({
        "clv_points": clv_points("entry_price", "closing_price"),
        "clv_source": F.when(F.col("closing_price").isNull(), "UNAVAILABLE")
        .otherwise("CLOB_HISTORY")})
    waiting = bets.where(F.coalesce(~due, F.lit(True)))
    return priced.unionByName(waiting, allowMissingColumns=True)


def unsettled(bets: DataFrame) -> DataFrame:
    """Bets whose result is not known yet; a table without results has only such."""
    return bets.where(F.col("won").isNull()) if "won" in bets.columns else bets


def settle_manual(bets: DataFrame, markets: DataFrame) -> DataFrame:
    """Outcome and profit of manual bets on resolved markets (PRJ-24)."""
    ended = markets.where(F.col("resolved") & F.col("winner").isNotNull()).select("market_id", "winner")
    won = F.col("outcome_index") == F.col("winner")
    paid = won & (F.col("entry_price") > 0)
    return (unsettled(bets).where(F.col("source") == "MANUAL").join(ended, "market_id")
            .withColumns({"won": won, "pnl": F.when(
                paid, F.col("stake") / F.col("entry_price") - F.col("stake"))
                .otherwise(-F.col("stake"))}).drop("winner"))


def settle_imported(bets: DataFrame, closed: DataFrame) -> DataFrame:
    """Settled profit of a token shared among its unsettled imported bets by stake (AGG-35).

    The stakes of a token are summed by a plain aggregation and joined back, so a token with very
    many bets is never gathered in one window.
    """
    own = unsettled(bets).where((F.col("source") == "WALLET") & F.col("asset").isNotNull())
    stakes = own.groupBy("asset").agg(F.sum("stake").alias("_all"))
    settled = closed.where(F.col("won").isNotNull()).select("asset", "won", "realized_pnl")
    share = F.when(F.col("_all") > 0, F.col("stake") / F.col("_all")).otherwise(1.0)
    return (own.drop("won").join(stakes.join(settled, "asset"), "asset")
            .withColumn("pnl", F.col("realized_pnl") * share).drop("_all", "realized_pnl"))


def logged_positions(bets: DataFrame) -> DataFrame:
    """Bets, stake and stake-weighted price per side (AGG-21)."""
    return bets.groupBy(*SIDE).agg(
        F.count(F.lit(1)).alias("bets"), F.sum("stake").alias("total_stake"),
        F.coalesce(F.try_divide(F.sum(F.col("stake") * F.col("entry_price")), F.sum("stake")),
                   F.min("entry_price")).alias("average_price"))


def logged_on_board(bets: DataFrame, board: DataFrame) -> DataFrame:
    """Board sides with what was already bet on them (JOIN-14)."""
    return board.select(*SIDE, "opportunity", "horizon").join(logged_positions(bets), SIDE, "left") \
        .fillna({"bets": 0, "total_stake": 0.0})


def bet_totals(bets: DataFrame) -> DataFrame:
    """Staked, settled, won and profit in one row (AGG-34)."""
    return bets.agg(F.count(F.lit(1)).alias("bets"), total("stake").alias("staked"),
                    F.count("won").alias("settled"), count_where(F.col("won")).alias("wins"),
                    total("pnl").alias("pnl"))


def _slices(bets: DataFrame, label, names: list[str] | None, cfg) -> DataFrame:
    gate = merge_config(cfg)["clv"]["slice_gate"]
    facts = bets.withColumn("label", label).where(F.col("label").isNotNull()).groupBy("label").agg(
        F.count(F.lit(1)).alias("bets"), F.count("clv_points").alias("measured"),
        F.avg("clv_points").alias("_mean"), count_where(F.col("won")).alias("wins"),
        count_where(~F.col("won")).alias("losses"))
    if names is not None:
        spark = bets.sparkSession
        frame = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("label"))
        facts = frame.join(facts, "label", "left").fillna(0, ["bets", "measured", "wins", "losses"])
    return facts.withColumn("mean_clv", F.when(F.col("measured") >= gate, F.col("_mean"))).drop("_mean")


def slice_by_price(bets: DataFrame, cfg=None) -> DataFrame:
    """Record per entry-price band, empty bands kept (AGG-32)."""
    return _slices(bets, band_label("entry_price", PRICE_SLICES), [b[0] for b in PRICE_SLICES], cfg)


def slice_by_score(bets: DataFrame, cfg=None) -> DataFrame:
    """Record per horizon-score band, empty bands kept (AGG-32)."""
    return _slices(bets, band_label("horizon_score", SCORE_SLICES), [b[0] for b in SCORE_SLICES], cfg)


def slice_by_category(bets: DataFrame, cfg=None) -> DataFrame:
    """Record per category, most bets first (AGG-32)."""
    return _slices(bets, F.col("category"), None, cfg).orderBy(F.desc("bets"), "label")


def clv_summary(bets: DataFrame, cfg=None) -> DataFrame:
    """Mean closing-line value with interval, verdict and bets still needed (AGG-33)."""
    c = merge_config(cfg)["clv"]
    points = clv_points("entry_price", "closing_price")
    facts = bets.agg(F.count(points).alias("count"), F.avg(points).alias("_mean"),
                     F.stddev_samp(points).alias("_sd"), count_where(points > 0).alias("_up"))
    enough = F.col("count") >= c["min_sample"]
    mean, sd = F.when(enough, F.col("_mean")), F.when(enough, F.col("_sd"))
    error = sd / F.sqrt(F.col("count").cast("double"))
    low, high = mean - c["z"] * error, mean + c["z"] * error
    needed = F.when((F.abs(mean) >= 1e-9) & (sd > 0),
                    F.ceil(F.pow(c["z"] * sd / F.abs(mean), F.lit(2.0))))
    return facts.select(
        "count", mean.alias("mean_points"), sd.alias("stddev_points"), error.alias("standard_error"),
        low.alias("interval_low"), high.alias("interval_high"),
        F.try_divide(F.col("_up"), F.col("count")).alias("positive_rate"),
        F.when(~enough, "TOO_FEW").when(low > 0, "BEATING_THE_CLOSE").when(high < 0, "PAYING_UP")
        .otherwise("INCONCLUSIVE").alias("verdict"),
        F.when(needed <= c["max_needed"], needed).alias("bets_needed"))


def score_vs_clv(bets: DataFrame, cfg=None) -> DataFrame:
    """Correlation of score and closing-line value with its interval (STA-5)."""
    c = merge_config(cfg)["clv"]
    score, clv = F.col("horizon_score"), F.col("clv_points")
    both = score.isNotNull() & clv.isNotNull()
    facts = bets.where(both).agg(
        F.count(F.lit(1)).alias("n"), F.corr(score, clv).alias("_r"),
        F.stddev_samp(score).alias("_sx"), F.stddev_samp(clv).alias("_sy"))
    usable = (F.col("n") >= c["relation_gate"]) & (F.col("_sx") > 0) & (F.col("_sy") > 0)
    r = F.when(usable, F.col("_r"))
    clipped = F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), r))
    z = 0.5 * F.log((1.0 + clipped) / (1.0 - clipped))
    step = F.when(usable, c["z"] / F.sqrt(F.col("n").cast("double") - 3.0))
    low, high = F.when(usable, F.tanh(z - step)), F.when(usable, F.tanh(z + step))
    return facts.select("n", r.alias("correlation"), low.alias("low"), high.alias("high"),
                        F.when(r.isNull(), "TOO_FEW").when(low > 0, "POSITIVE")
                        .when(high < 0, "NEGATIVE").otherwise("NO_RELATION").alias("verdict"))
