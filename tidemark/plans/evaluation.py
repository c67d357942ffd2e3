"""Bands, headline figures, drawdown, calibration and robustness of a set of signals.

Every function is keyed by ``horizon_days``, so one call evaluates all horizons.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.fixed_values import SIGNAL_BANDS
from tidemark.functions.numeric import band_label, count_where, day_of
from tidemark.functions.stats import significance, uniform_draw, wilson
from tidemark.operators.prefix import (
    numbered,
    average_rank, order_statistics, running, running_extreme, spearman,
)

KEY = ["horizon_days"]
BAND_NAMES = [name for name, _, _ in SIGNAL_BANDS]


def score_bands(signals: DataFrame) -> DataFrame:
    """Record per score band; empty bands are kept (AGG-36)."""
    banded = signals.withColumn("band", band_label("opportunity", SIGNAL_BANDS))
    facts = banded.groupBy(*KEY, "band").agg(
        F.count(F.lit(1)).alias("signals"), count_where(F.col("won")).alias("wins"),
        F.avg("price").alias("implied"), F.avg("pnl").alias("roi"))
    frame = signals.select(*KEY).distinct().withColumn(
        "band", F.explode(F.array(*[F.lit(n) for n in BAND_NAMES])))
    full = frame.join(facts, [*KEY, "band"], "left").fillna({"signals": 0, "wins": 0})
    full = full.withColumn("win_rate", F.try_divide(F.col("wins"), F.col("signals")))
    interval = wilson("wins", "signals")
    return full.withColumns({"win_low": interval["low"], "win_high": interval["high"],
                             "edge_points": (F.col("win_rate") - F.col("implied")) * 100.0})


def max_drawdown(signals: DataFrame) -> DataFrame:
    """Worst fall of the equal-stake running profit below its peak, floored at zero (WIN-2)."""
    order = ["resolved_ts", "market_id", "outcome_index"]
    day = day_of("resolved_ts")
    cum = running(signals.select(*KEY, *order, "pnl"), KEY, day, order, sums={"_cum": F.col("pnl")})
    peak = running_extreme(cum, KEY, day, order, "_peak", F.col("_cum"), largest=True)
    fall = F.col("_cum") - F.greatest(F.lit(0.0), F.col("_peak"))
    return peak.groupBy(*KEY).agg(F.least(F.lit(0.0), F.min(fall)).alias("max_drawdown"))


def headline(signals: DataFrame) -> DataFrame:
    """Wins, rates, edge, return, price sources and price ages (AGG-37)."""
    base = signals.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("signals"), count_where(F.col("won")).alias("wins"),
        F.avg("price").alias("implied"), F.avg("pnl").alias("roi"),
        *[count_where(F.col("source") == s).alias(f"from_{s}")
          for s in ("series", "snapshot", "trade")],
        F.count_distinct("market_id").alias("markets_tested"))
    n = F.col("n")
    ages = order_statistics(signals, KEY, "age_seconds", 86400, {
        "_p50": F.least(n - 1, F.floor(n * 0.5)) + 1, "_p90": F.least(n - 1, F.floor(n * 0.9)) + 1})
    ages = ages.select(*KEY, (F.col("_p50") / 3600.0).alias("median_age_hours"),
                       (F.col("_p90") / 3600.0).alias("p90_age_hours"))
    interval = wilson("wins", "signals")
    win_rate = F.col("wins") / F.col("signals")
    rho = spearman(signals.withColumn("_won", F.col("won").cast("int")), "opportunity", "_won",
                   KEY, "rank_correlation")
    return (base.join(ages, KEY).join(max_drawdown(signals), KEY).join(rho, KEY)
            .withColumns({"losses": F.col("signals") - F.col("wins"), "win_rate": win_rate,
                          "win_low": interval["low"], "win_high": interval["high"],
                          "edge_points": (win_rate - F.col("implied")) * 100.0}))


def warning_codes(head: DataFrame, bands: DataFrame, calibration: DataFrame,
                  rejects: DataFrame) -> DataFrame:
    """Codes of what makes a run's figures unsafe to read at face value (AGG-37)."""
    order = F.array(*[F.lit(n) for n in BAND_NAMES])
    filled = bands.where((F.col("signals") >= 20) & F.col("edge_points").isNotNull()) \
        .withColumn("_at", F.array_position(order, F.col("band")))
    slope = filled.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_bands"), F.max_by("edge_points", "_at").alias("_top"),
        F.min_by("edge_points", "_at").alias("_bottom"))
    missing = rejects.where(F.col("reject_reason") == "NO_PRICE").select(
        *KEY, F.col("rejected").alias("_no_price"))
    c = F.col
    joined = (head.join(slope, KEY, "left").join(missing, KEY, "left")
              .join(calibration.select(*KEY, "best_band_p"), KEY, "left"))
    codes = F.array_compact(F.array(
        F.when(c("signals") < 30, "FEW_SIGNALS"),
        F.when(c("best_band_p") > 0.05, "BEST_BAND_IS_CHANCE")
        .when(c("best_band_p").isNotNull(), "BEST_BAND_SURVIVES"),
        F.when(c("rank_correlation") <= 0.02, "SCORE_DOES_NOT_RANK"),
        F.when((c("_bands") >= 2) & (c("_top") < c("_bottom")), "NOT_MONOTONIC"),
        F.when(c("median_age_hours") > 6, "STALE_PRICES"),
        F.when(c("from_trade") > c("from_series") + c("from_snapshot"), "PRICES_FROM_FILLS"),
        F.when(c("_no_price") > c("markets_tested"), "MANY_WITHOUT_PRICE"),
        F.lit("WATCHLIST_HINDSIGHT")))
    return joined.select(*KEY, codes.alias("warnings"))


def calibration_test(signals: DataFrame, cfg=None) -> DataFrame:
    """Chance of the best band, rank correlation and overall edge under the market's prices (STA-3).

    Draw ``k = iteration * n + i`` belongs to signal ``i`` of an iteration. Each signal emits its
    own iterations and they are summed per iteration before the shuffle, so what travels is one
    small row per iteration and task, whatever the number of signals.
    """
    b = merge_config(cfg)["backtest"]
    iterations, seed = int(b["iterations"]), int(b["seed"])
    usable = signals.where((F.col("price") > 0) & (F.col("price") < 1)
                           & F.col("opportunity").isNotNull())
    usable = usable.select(*KEY, "market_id", "outcome_index", "price", "opportunity",
                           F.col("won").cast("int").alias("_won"),
                           band_label("opportunity", SIGNAL_BANDS).alias("_band"))
    indexed = numbered(usable, KEY, ["market_id", "outcome_index"], "_i")
    ranks = average_rank(usable, "opportunity", KEY).select(
        *KEY, "opportunity", F.col("average_rank").alias("_rank"))
    ranked = indexed.join(ranks, [*KEY, "opportunity"])

    def band_sums(value, prefix):
        return [F.sum(F.when(F.col("_band") == name, value).otherwise(0)).alias(f"{prefix}{i}")
                for i, name in enumerate(BAND_NAMES)]

    one = F.lit(1)
    fixed = ranked.groupBy(*KEY).agg(
        F.count(one).alias("n"), F.sum("price").alias("_implied"), F.sum("_won").alias("_w"),
        F.sum(F.col("_rank") * F.col("_won")).alias("_rw"),
        F.sum(F.col("_rank") * F.col("_rank")).alias("_rr"),
        *band_sums(one, "_n"), *band_sums(F.col("price"), "_p"), *band_sums(F.col("_won"), "_w"))
    fixed = fixed.where(F.col("n") >= 10)

    def edges(wins: str):
        return [F.when(F.col(f"_n{i}") >= b["min_band_size"],
                       (F.col(f"{wins}{i}") / F.col(f"_n{i}") - F.col(f"_p{i}") / F.col(f"_n{i}"))
                       * 100.0) for i in range(len(BAND_NAMES))]

    n = F.col("n").cast("double")

    def rank_r(wins, rank_wins):
        dx = F.col("_rr") - n * (n + 1.0) * (n + 1.0) / 4.0
        dy = wins * (n - wins) * n / 4.0
        top = (rank_wins - wins * (n + 1.0) / 2.0) * n / 2.0
        return F.when((dx > 0) & (dy > 0), top / F.sqrt(dx * dy))

    def overall(wins):
        return (wins / n - F.col("_implied") / n) * 100.0

    observed = fixed.withColumns({
        "_best": F.greatest(*edges("_w")), "_r": rank_r(F.col("_w"), F.col("_rw")),
        "_edge": overall(F.col("_w"))})
    observed = observed.withColumn("best_band", reduce(
        lambda acc, pair: F.when(pair[1] == F.col("_best"), BAND_NAMES[pair[0]]).otherwise(acc),
        reversed(list(enumerate(edges("_w")))), F.lit(None).cast("string")))

    # The rows are few next to the draws they stand for, so they are spread over all cores by count
    # rather than by size.
    parts = int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = (ranked.join(fixed.select(*KEY, "n"), KEY)
             .repartition(parts, *KEY, "market_id", "outcome_index")
             .withColumn("_it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))))
    draw = uniform_draw(seed, F.col("_it").cast("long") * F.col("n") + F.col("_i"))
    turns = turns.withColumn("_hit", F.when(draw < F.col("price"), 1).otherwise(0))
    simulated = turns.groupBy(*KEY, "_it").agg(
        F.sum("_hit").alias("_sw"), F.sum(F.col("_rank") * F.col("_hit")).alias("_srw"),
        *band_sums(F.col("_hit"), "_s"))
    judged = simulated.join(observed, KEY).withColumns({
        "_sbest": F.greatest(*edges("_s")), "_sr": rank_r(F.col("_sw"), F.col("_srw")),
        "_sedge": overall(F.col("_sw"))})
    counts = judged.groupBy(*KEY).agg(
        count_where(F.col("_sbest") >= F.col("_best")).alias("_cb"),
        count_where(F.col("_sr") >= F.col("_r")).alias("_cr"),
        count_where(F.col("_sedge") >= F.col("_edge")).alias("_ce"))

    def p(count: str, known: str):
        return F.when(F.col(known).isNotNull(), (F.col(count) + 1) / F.lit(float(iterations + 1)))

    return observed.join(counts, KEY).select(
        *KEY, F.col("n").alias("signals"), F.lit(iterations).alias("iterations"), "best_band",
        F.col("_best").alias("best_band_edge"), p("_cb", "_best").alias("best_band_p"),
        F.col("_r").alias("rank_correlation"), p("_cr", "_r").alias("rank_correlation_p"),
        F.col("_edge").alias("overall_edge"), p("_ce", "_edge").alias("overall_edge_p"),
        significance(p("_cb", "_best")).alias("significance"))


def horizon_outcomes(head: DataFrame, calibration: DataFrame, cfg=None) -> DataFrame:
    """One line per horizon, with whether it would have looked like a discovery alone (PIT-3)."""
    b = merge_config(cfg)["backtest"]
    alone = F.coalesce((F.col("best_band_p") <= b["alpha"]) & (F.col("signals") >= b["min_signals"]),
                       F.lit(False))
    tested = calibration.select(*KEY, "best_band", "best_band_edge", "best_band_p", "overall_edge_p")
    return (head.select(*KEY, "signals", "win_rate", "implied", "edge_points", "rank_correlation")
            .join(tested, KEY, "left").withColumn("significant_alone", alone))


def robustness(outcomes: DataFrame, cfg=None) -> DataFrame:
    """Whether a band's edge holds across horizons, as one verdict row (PIT-3)."""
    b = merge_config(cfg)["backtest"]
    found = F.col("significant_alone")
    total = outcomes.agg(
        count_where(F.col("signals") >= b["min_signals"]).alias("usable_horizons"),
        count_where(found).alias("significant_horizons"),
        count_where(F.col("rank_correlation") > 0).alias("positive_correlations"),
        F.count("rank_correlation").alias("correlations")).withColumn("_one", F.lit(1))
    bands = (outcomes.where(found & F.col("best_band").isNotNull()).groupBy("best_band")
             .agg(F.count(F.lit(1)).alias("_times")).where(F.col("_times") >= 2)
             .agg(F.count(F.lit(1)).alias("replicated_bands"), F.max("_times").alias("_most"))
             .withColumn("_one", F.lit(1)))
    share = F.when(F.col("usable_horizons") > 0, F.col("_most") / F.col("usable_horizons"))
    verdict = (F.when(F.col("usable_horizons") < 2, "TOO LITTLE DATA")
               .when(share >= b["replication_share"], "REPLICATES")
               .when(F.col("replicated_bands") > 0, "INCONSISTENT")
               .when(F.col("significant_horizons") > 0, "DOES NOT REPLICATE")
               .otherwise("NOTHING FOUND"))
    return total.join(bands, "_one").withColumn("verdict", verdict).drop("_one", "_most")
