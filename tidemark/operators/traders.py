"""Wallet track records and the trader score.

Settled positions are first summed per (key, category, month), which combines map-side and leaves
at most a calendar's worth of rows per key; everything after that runs on those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.fixed_values import ENTRY_BANDS
from tidemark.functions.numeric import (
    band_label, col, count_where, day_of, half_up, herfindahl, month_text, scale_to_score,
    total,
)
from tidemark.operators.prefix import latest_n, running, thin
from tidemark.operators.scores import attach_score, points_if
from tidemark.session import cut_lineage, with_settings

DAY = 86400


def settled_summary(closed: DataFrame, keys: list[str], as_of=None) -> DataFrame:
    """Per (keys, category, month) sums of settled positions, the common first step.

    ``as_of`` is the clock of the trailing 30 and 90 days, a literal or a column of ``closed``.
    ``resolved_ts`` null means the date is unknown: counted in the totals, not in time series.
    """
    cost, pnl, won = F.col("cost_basis_usd"), F.col("realized_pnl"), F.col("won")
    when = F.col("resolved_ts")
    clock = col(as_of) if as_of is not None else F.lit(None).cast("long")
    staked = cost > 0

    def trailing(value, days):
        return total(F.when(when >= clock - days * DAY, value))

    return (closed.withColumn("month", month_text("resolved_ts"))
            .groupBy(*keys, "category", "month").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("won").alias("decided"),
        count_where(won).alias("wins"),
        count_where(~won).alias("losses"),
        total(cost).alias("staked"),
        total(pnl).alias("pnl"),
        trailing(cost, 30).alias("staked_30"), trailing(pnl, 30).alias("pnl_30"),
        trailing(cost, 90).alias("staked_90"), trailing(pnl, 90).alias("pnl_90"),
        F.count("avg_price").alias("priced"), total("avg_price").alias("price_sum"),
        count_where(F.col("avg_price") >= 0.95).alias("high_priced"),
        count_where(staked).alias("stakes"),
        total(F.when(staked, cost)).alias("stake_sum"),
        F.max(F.when(staked, cost)).alias("stake_max"),
        total(F.when(pnl > 0, pnl)).alias("winnings"),
        F.max(F.when(pnl > 0, pnl)).alias("win_max"),
        F.min(F.when(pnl < 0, pnl)).alias("loss_min"),
        count_where(staked & won).alias("win_stakes"),
        total(F.when(staked & won, cost)).alias("win_stake_sum"),
        count_where(staked & ~won).alias("loss_stakes"),
        total(F.when(staked & ~won, cost)).alias("loss_stake_sum"),
    ))


def monthly_buckets(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Profit, stake, wins, losses and return per month (AGG-2)."""
    return (summary.where(F.col("month").isNotNull()).groupBy(*keys, "month")
            .agg(F.sum("pnl").alias("pnl"), F.sum("staked").alias("staked"),
                 F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))
            .withColumn("roi", F.when(F.col("staked") > 0, F.col("pnl") / F.col("staked"))))


def category_performance(summary: DataFrame, keys: list[str], cfg=None) -> DataFrame:
    """Record per category with skill shrunk toward the overall return (AGG-4)."""
    prior = float(merge_config(cfg)["trader"]["category_prior"])
    grouped = summary.groupBy(*keys, "category").agg(
        F.sum("n").alias("closed_count"), F.sum("decided").alias("decided"),
        F.sum("wins").alias("win_count"), F.sum("pnl").alias("realized_pnl"),
        F.sum("staked").alias("total_staked"))
    everywhere = W.partitionBy(*keys)
    all_staked = F.sum("total_staked").over(everywhere)
    overall = F.when(all_staked > 0, F.sum("realized_pnl").over(everywhere) / all_staked)
    roi = F.when(F.col("total_staked") > 0, F.col("realized_pnl") / F.col("total_staked"))
    n = F.col("closed_count").cast("double")
    shrunk = (F.col("roi") * n + F.coalesce("_overall", F.lit(0.0)) * prior) / (n + prior)
    return (grouped.withColumns({"_overall": overall, "roi": roi})
            .withColumns({"win_rate": F.try_divide(F.col("win_count"), F.col("decided")),
                          "skill_score": scale_to_score(shrunk, -0.5, 1.0)})
            .drop("_overall", "decided"))


def entry_buckets(closed: DataFrame, keys: list[str]) -> DataFrame:
    """Record per entry-price band; bands a trader never used are kept, empty (AGG-3)."""
    label = band_label("avg_price", ENTRY_BANDS)
    facts = (closed.withColumn("bucket", label).groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("count"), F.count("won").alias("decided"),
        count_where(F.col("won")).alias("wins"), total("cost_basis_usd").alias("staked"),
        total("realized_pnl").alias("pnl")))
    names = F.array(*[F.lit(name) for name, _, _ in ENTRY_BANDS])
    frame = facts.select(*keys).distinct().withColumn("bucket", F.explode(names))
    return (frame.join(facts, [*keys, "bucket"], "left")
            .fillna({"count": 0, "decided": 0, "wins": 0, "staked": 0.0, "pnl": 0.0})
            .withColumns({
                "roi": F.when(F.col("staked") > 0, F.col("pnl") / F.col("staked")),
                "win_rate": F.try_divide(F.col("wins"), F.col("decided"))})
            .drop("decided"))


def open_metrics(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Unrealized profit and concentration of the open positions (AGG-1, AGG-7)."""
    return positions.groupBy(*keys).agg(
        total("cash_pnl").alias("unrealized_pnl"),
        herfindahl("current_value").alias("concentration_hhi"))


def trader_metrics(closed: DataFrame, keys: list[str], as_of, positions: DataFrame | None = None,
                   cfg=None, summary: DataFrame | None = None,
                   universe: DataFrame | None = None) -> DataFrame:
    """One row per key: totals, rates, trailing returns, consistency (AGG-1, 5, 6, 9, 40).

    ``universe`` adds the keys without a settled position, with zero counts and null figures.
    """
    summary = settled_summary(closed, keys, as_of) if summary is None else summary
    summary = cut_lineage(summary)  # three aggregations read it; it has a calendar's rows per key
    overall = summary.groupBy(*keys).agg(
        F.sum("n").alias("closed_count"), F.sum("decided").alias("decided_count"),
        F.sum("wins").alias("win_count"), F.sum("losses").alias("loss_count"),
        F.sum("pnl").alias("realized_pnl"), F.sum("staked").alias("total_staked"),
        F.try_divide(F.sum("price_sum"), F.sum("priced")).alias("avg_entry_price"),
        F.try_divide(F.sum("stake_sum"), F.sum("stakes")).alias("avg_position_usd"),
        F.max("stake_max").alias("largest_position_usd"),
        F.max("win_max").alias("largest_win_usd"), F.min("loss_min").alias("largest_loss_usd"),
        F.when(F.sum("staked_30") > 0, F.sum("pnl_30") / F.sum("staked_30")).alias("roi_30d"),
        F.when(F.sum("staked_90") > 0, F.sum("pnl_90") / F.sum("staked_90")).alias("roi_90d"),
        F.sum("winnings").alias("_winnings"), F.sum("high_priced").alias("_high"),
        F.sum("win_stakes").alias("_ws"), F.sum("win_stake_sum").alias("_wsum"),
        F.sum("loss_stakes").alias("_ls"), F.sum("loss_stake_sum").alias("_lsum"),
    )
    months = monthly_buckets(summary, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"),
        F.try_divide(count_where(F.col("pnl") > 0), F.count(F.lit(1))).alias("monthly_win_rate"),
        F.avg("roi").alias("_mean_month"),
        F.when(F.count("roi") >= 2, F.stddev_samp("roi")).alias("profit_volatility"))
    skill = category_performance(summary, keys, cfg).where(
        F.col("skill_score").isNotNull() & (F.col("total_staked") > 0)).groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("skill_score") * F.col("total_staked")),
                     F.sum("total_staked")).alias("weighted_skill"))
    if universe is not None:
        overall = universe.select(*keys).join(overall, keys, "left").fillna(
            0, ["closed_count", "decided_count", "win_count", "loss_count", "_ws", "_ls"])
    joined = overall.join(months, keys, "left").join(skill, keys, "left")
    if positions is not None:
        joined = joined.join(open_metrics(positions, keys), keys, "left")
    else:
        joined = joined.withColumns({"unrealized_pnl": F.lit(None).cast("double"),
                                     "concentration_hhi": F.lit(None).cast("double")})
    return _with_rates(joined)


def _with_rates(joined: DataFrame) -> DataFrame:
    """Rates and ratios from the summed figures of a key."""
    win_mean = F.try_divide(F.col("_wsum"), F.col("_ws"))
    loss_mean = F.try_divide(F.col("_lsum"), F.col("_ls"))
    return joined.withColumns({
        "total_pnl": F.when(
            F.col("realized_pnl").isNotNull() | F.col("unrealized_pnl").isNotNull(),
            F.coalesce("realized_pnl", F.lit(0.0)) + F.coalesce("unrealized_pnl", F.lit(0.0))),
        "win_rate": F.try_divide(F.col("win_count"), F.col("decided_count")),
        "roi": F.when(F.col("total_staked") > 0, F.col("realized_pnl") / F.col("total_staked")),
        "risk_adjusted_return": F.when(F.col("profit_volatility") > 0,
                                       F.col("_mean_month") / F.col("profit_volatility")),
        "top_win_share": F.when(F.col("_winnings") > 0,
                                F.col("largest_win_usd") / F.col("_winnings")),
        "high_price_share": F.try_divide(F.col("_high"), F.col("closed_count")),
        "only_winners": (F.col("decided_count") >= 10) & (F.col("loss_count") == 0),
        "conviction_ratio": F.when((F.col("_ws") + F.col("_ls") >= 5) & (loss_mean > 0),
                                   win_mean / loss_mean),
        "months": F.coalesce("months", F.lit(0)),
    }).drop("_winnings", "_high", "_ws", "_wsum", "_ls", "_lsum", "_mean_month", "decided_count")


def trader_score(metrics: DataFrame, behaviour: DataFrame | None, keys: list[str],
                 cfg=None) -> DataFrame:
    """The trader score: seven components, nine penalties (SCR-1)."""
    t = merge_config(cfg)["trader"]
    weights = t["weights"]
    if behaviour is not None:
        wanted = behaviour.select(*keys, "behaviour_class", "behaviour_confidence",
                                  "median_hold_seconds")
        metrics = metrics.join(wanted, keys, "left")
        confident = F.col("behaviour_confidence") >= 0.6
        held = F.col("median_hold_seconds")
        maker = confident & (F.col("behaviour_class") == "MARKET_MAKER")
        bot = confident & F.col("behaviour_class").isin("POSSIBLE_BOT", "SCALPER")
    else:
        held, maker, bot = F.lit(None).cast("double"), F.lit(False), F.lit(False)

    drag = F.coalesce(F.least(F.lit(25.0), F.col("profit_volatility") * 25.0), F.lit(0.0))
    n = F.col("closed_count").cast("double")
    components = {
        "long_term": scale_to_score("roi", *t["roi_range"]),
        "consistency": F.when(F.col("months") >= 2, F.greatest(
            F.lit(0.0), F.col("monthly_win_rate") * 100.0 - drag))
        .when(F.col("closed_count") >= 5, F.col("win_rate") * 80.0),
        "recent_form": scale_to_score(F.coalesce("roi_30d", "roi_90d"), -0.5, 1.0),
        "category_skill": F.col("weighted_skill"),
        "risk_adjusted": scale_to_score("risk_adjusted_return", -1.0, 3.0),
        "sample_quality": F.least(F.lit(100.0), F.sqrt(n / float(t["full_credit_sample"])) * 100.0),
        "conviction": scale_to_score("conviction_ratio", 0.5, 2.0),
    }
    severity = 1.0 - n / float(t["small_sample"])
    penalties = {
        "small_sample": F.when(F.col("closed_count") < t["small_sample"],
                               half_up(float(t["small_sample_points"]) * severity)),
        "concentration": points_if(F.col("concentration_hhi") > t["hhi_limit"], t["hhi_points"]),
        "only_winners": points_if(F.col("only_winners"), t["only_winners_points"]),
        "high_price": points_if(F.col("high_price_share") > t["high_price_share"],
                                t["high_price_points"]),
        "short_hold": points_if(held < t["short_hold_seconds"], t["short_hold_points"]),
        "one_win": points_if(F.col("top_win_share") > t["top_win_share"], t["top_win_points"]),
        "poor_recent": points_if(F.col("roi_30d") < t["poor_recent_roi"], t["poor_recent_points"]),
        "market_maker": points_if(maker, t["maker_points"]),
        "bot": points_if(bot, t["bot_points"]),
    }
    return attach_score(metrics, "smart_score",
                        {k: (weights[k], c) for k, c in components.items()}, penalties)


def daily_record(closed: DataFrame) -> DataFrame:
    """Settled positions summed per (trader, category, UTC day), for point-in-time scoring.

    The clock of a point-in-time score is a day boundary and nothing settled on or after it
    counts, so whole days are the finest grain needed and one trader has at most a calendar of rows.
    """
    day = closed.where(F.col("resolved_ts").isNotNull()).withColumn("day", day_of("resolved_ts"))
    summary = settled_summary(day, ["trader_id", "day"])
    return summary.drop("staked_30", "pnl_30", "staked_90", "pnl_90")


def _month_index(day):
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    return F.year(date) * 12 + F.month(date)


ADDED = ["n", "decided", "wins", "losses", "staked", "pnl", "high_priced", "winnings", "win_stakes",
         "win_stake_sum", "loss_stakes", "loss_stake_sum"]


def _known_by(rows: DataFrame, asked: DataFrame, keys: list[str], at: str, values: list[str],
              most: list[str] = (), trailing: dict[int, list[str]] | None = None) -> DataFrame:
    """Sums over the rows of a key strictly before each asked moment, in one window pass.

    ``rows`` and ``asked`` share ``keys`` and the whole-number column ``at``; both have at most one
    row per key and moment, so a partition is bounded by the calendar.
    """
    both = rows.select(*keys, at, *values, *most).withColumn("_ask", F.lit(0)).unionByName(
        asked.select(*keys, at).withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(at)
    before = order.rangeBetween(W.unboundedPreceding, -1)
    out = {v: F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values}
    out |= {v: F.max(v).over(before) for v in most}
    for length, names in (trailing or {}).items():
        out |= {f"{v}_{length}": F.sum(v).over(order.rangeBetween(-length, -1)) for v in names}
    return both.select(*keys, at, "_ask", *[c.alias(n) for n, c in out.items()]) \
        .where(F.col("_ask") == 1).drop("_ask")


def trader_scores_asof(closed: DataFrame, asked: DataFrame, cfg=None,
                       record: DataFrame | None = None) -> DataFrame:
    """Trader score as of the start of each asked UTC day (JOIN-9, PIT-1).

    ``asked`` holds the distinct (trader_id, as_of_day) pairs that are needed; a trader with
    nothing settled before the day scores 0. Asked days are merged into each trader's daily record
    and read running sums there, so a record is never repeated for every day it counts towards.
    Records and asked days are dealt by trader once; every window, sum and join below stays there.
    """
    cfg = merge_config(cfg)
    key = ["trader_id", "as_of_day"]
    record = cut_lineage(daily_record(closed) if record is None else record).repartition("trader_id")
    asked = cut_lineage(asked.select(*key).distinct()).repartition("trader_id")
    days = asked.select("trader_id", F.col("as_of_day").alias("day"))
    daily = record.groupBy("trader_id", "day").agg(
        *[F.sum(c).alias(c) for c in ADDED], F.max("win_max").alias("win_max"))

    overall = _known_by(daily.withColumn("last_day", F.col("day")), days, ["trader_id"], "day", ADDED, ["win_max", "last_day"],
                        {30: ["pnl", "staked"], 90: ["pnl", "staked"]})
    # The month that is under way on the day before, as far as it is known, and the whole ones before.
    now = _month_index(F.col("day") - 1)
    partial = _known_by(daily.withColumn("month_at", _month_index(F.col("day"))),
                        days.withColumn("month_at", now), ["trader_id", "month_at"], "day",
                        ["n", "pnl", "staked"])
    part_roi = F.when(F.col("staked") > 0, F.col("pnl") / F.col("staked"))
    partial = partial.select("trader_id", "day", "month_at", (F.col("n") > 0).cast("int").alias("_pm"),
                             ((F.col("n") > 0) & (F.col("pnl") > 0)).cast("int").alias("_pw"),
                             part_roi.alias("_pr"))
    roi = F.col("pnl") / F.col("staked")
    months = (daily.groupBy("trader_id", _month_index(F.col("day")).alias("month_at"))
              .agg(F.sum("pnl").alias("pnl"), F.sum("staked").alias("staked"))
              .withColumns({"m": F.lit(1), "up": (F.col("pnl") > 0).cast("int"),
                            "r": F.when(F.col("staked") > 0, roi)})
              .withColumns({"k": F.col("r").isNotNull().cast("int"), "rr": F.col("r") * F.col("r")}))
    whole = _known_by(months, partial.select("trader_id", "month_at").distinct(), ["trader_id"],
                      "month_at", ["m", "up", "k", "r", "rr"])
    extra = F.coalesce("_pr", F.lit(0.0))
    series = partial.join(whole, ["trader_id", "month_at"]).select(
        "trader_id", "day", (F.col("m") + F.col("_pm")).alias("months"),
        (F.col("up") + F.col("_pw")).alias("_up"),
        (F.col("k") + F.col("_pr").isNotNull().cast("int")).alias("_k"),
        (F.col("r") + extra).alias("_r"), (F.col("rr") + extra * extra).alias("_rr"))
    mean = F.try_divide(F.col("_r"), F.col("_k"))
    spread = F.greatest(F.lit(0.0), (F.col("_rr") - F.col("_k") * mean * mean) / (F.col("_k") - 1))
    series = series.select(
        "trader_id", "day", "months", F.try_divide(F.col("_up"), F.col("months")).alias("monthly_win_rate"),
        mean.alias("_mean_month"), F.when(F.col("_k") >= 2, F.sqrt(spread)).alias("profit_volatility"))

    known = record.groupBy("trader_id", "category", "day").agg(
        F.sum("n").alias("n"), F.sum("pnl").alias("pnl"), F.sum("staked").alias("staked"))
    # Skill changes with a settled day, not with the day it is asked for: of asked days between two settled ones one counts.
    base = (overall.where(F.col("n") > 0).groupBy("trader_id", (F.col("last_day") + 1).alias("day")).agg(
        F.max(F.coalesce(F.try_divide(F.col("pnl"), F.col("staked")), F.lit(0.0))).alias("_overall")))
    wanted = known.select("trader_id", "category").distinct().join(base.select("trader_id", "day"), "trader_id")
    skill = _known_by(known, wanted, ["trader_id", "category"], "day", ["n", "pnl", "staked"])
    prior, n = float(cfg["trader"]["category_prior"]), F.col("n").cast("double")
    shrunk = (roi * n + F.col("_overall") * prior) / (n + prior)
    skill = (skill.where(F.col("staked") > 0).join(base, ["trader_id", "day"])
             .withColumn("_s", scale_to_score(shrunk, -0.5, 1.0)).groupBy("trader_id", (F.col("day") - 1).alias("last_day"))
             .agg(F.try_divide(F.sum(F.col("_s") * F.col("staked")), F.sum("staked")).alias("weighted_skill")))

    nothing = F.lit(None).cast("double")
    summed = (overall.where(F.col("n") > 0).join(series, ["trader_id", "day"])
              .join(skill, ["trader_id", "last_day"], "left").select(
        "trader_id", F.col("day").alias("as_of_day"), F.col("n").alias("closed_count"),
        F.col("decided").alias("decided_count"), F.col("wins").alias("win_count"),
        F.col("losses").alias("loss_count"), F.col("pnl").alias("realized_pnl"),
        F.col("staked").alias("total_staked"), F.col("win_max").alias("largest_win_usd"),
        F.when(F.col("staked_30") > 0, F.col("pnl_30") / F.col("staked_30")).alias("roi_30d"),
        F.when(F.col("staked_90") > 0, F.col("pnl_90") / F.col("staked_90")).alias("roi_90d"),
        F.col("winnings").alias("_winnings"), F.col("high_priced").alias("_high"),
        F.col("win_stakes").alias("_ws"), F.col("win_stake_sum").alias("_wsum"),
        F.col("loss_stakes").alias("_ls"), F.col("loss_stake_sum").alias("_lsum"), "months",
        "monthly_win_rate", "_mean_month", "profit_volatility", "weighted_skill",
        nothing.alias("unrealized_pnl"), nothing.alias("concentration_hhi")))
    scored = trader_score(_with_rates(summed), None, key, cfg).select(*key, "smart_score", "closed_count")
    found = asked.join(scored, key, "left").fillna({"smart_score": 0.0, "closed_count": 0})
    # A join on trader and day may rely on rows that are dealt by trader alone.
    with with_settings(closed.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        return cut_lineage(found)


def pnl_curve(closed: DataFrame, key: str = "trader_id") -> DataFrame:
    """Realized profit per UTC day and its running total (AGG-31, WIN-1).

    The window runs on one row per trader and day, whatever the number of positions.
    """
    dated = closed.where(F.col("resolved_ts").isNotNull() & F.col("realized_pnl").isNotNull())
    daily = dated.groupBy(key, day_of("resolved_ts").alias("day")).agg(
        F.sum("realized_pnl").alias("pnl"))
    upto = W.partitionBy(key).orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.withColumn("cumulative", F.sum("pnl").over(upto))


def monthly_pnl(closed: DataFrame, key: str = "trader_id") -> DataFrame:
    """Realized profit per month (AGG-31)."""
    dated = closed.where(F.col("resolved_ts").isNotNull() & F.col("realized_pnl").isNotNull())
    return dated.groupBy(key, month_text("resolved_ts").alias("month")).agg(
        F.sum("realized_pnl").alias("pnl"))


def position_curve(closed: DataFrame, max_points: int | None = None) -> DataFrame:
    """Running profit after every settled position, thinned to ``max_points`` (WIN-1, WIN-9)."""
    dated = closed.where(F.col("resolved_ts").isNotNull())
    order = ["resolved_ts", "market_id", "outcome_index"]
    curve = running(dated, ["trader_id"], day_of("resolved_ts"), order,
                    sums={"cumulative_pnl": F.coalesce("realized_pnl", F.lit(0.0))})
    curve = curve.select("trader_id", *order, "realized_pnl", "cumulative_pnl")
    if max_points is None:
        return curve
    return thin(curve, ["trader_id"], day_of("resolved_ts"), order, max_points)


def newest_closed(closed: DataFrame, n: int = 100) -> DataFrame:
    """Each trader's ``n`` most recently settled positions (WIN-10)."""
    order = [F.desc_nulls_last("resolved_ts"), F.asc("market_id"), F.asc("outcome_index")]
    return latest_n(closed, ["trader_id"], order, n, ["market_id", "outcome_index"])


def list_traders(traders: DataFrame, scores: DataFrame, positions: DataFrame,
                 include_inactive: bool = False) -> DataFrame:
    """Traders with performance and open-position count, best score first (AGG-39)."""
    held = positions.groupBy("trader_id").agg(F.count(F.lit(1)).alias("open_positions"))
    shown = traders if include_inactive else traders.where("active")
    return (shown.join(scores, "trader_id", "left").join(held, "trader_id", "left")
            .fillna({"open_positions": 0})
            .orderBy(F.desc_nulls_last("smart_score"), "display_name", "trader_id"))
