"""Positions and prices as they stood at past moments, from fills, curves and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import day_of
from tidemark.functions.pricing import complement
from tidemark.operators.asof import Pick, asof_each
from tidemark.operators.prefix import affine, extreme, lowest, scan
from tidemark.session import among, cut_lineage

HOLDING = ["market_id", "trader_id", "outcome_index"]


def usable_fills(activity: DataFrame) -> DataFrame:
    """Fills that can move a position."""
    return activity.where((F.col("size") > 0) & (F.col("usd") > 0)
                          & F.col("outcome_index").isNotNull() & F.col("side").isNotNull())


def replay_positions(activity: DataFrame, queries: DataFrame, min_shares: float = 0.5,
                     min_cost: float = 0.5) -> DataFrame:
    """Holdings at every asked (market_id, signal_ts), from fills up to then (WIN-11).

    Every asked moment is a row of each holding that has a fill by then, after the fills of its second.
    One scan gives shares (the net less its lowest value, since overselling leaves zero) and the first
    buy. Buys add cost, sells scale it by the share kept: each fill is a map ``cost -> r*cost + b``, and
    the maps are composed along the rows where the scan has left them.
    """
    moments = queries.select("market_id", "signal_ts").distinct()
    last = cut_lineage(moments.groupBy("market_id").agg(F.max("signal_ts").alias("_last")))
    fills = usable_fills(activity).select(*HOLDING, "ts", "dedupe_key", "side", "size", "usd")
    known = cut_lineage(among(fills, last, "market_id")
                        .where(F.col("ts") <= F.col("_last")).drop("_last"))
    since = known.groupBy(*HOLDING).agg(F.min("ts").alias("_since"))
    nothing = F.lit(0.0)
    asked_rows = since.join(moments, "market_id").where(F.col("signal_ts") >= F.col("_since")).select(
        *HOLDING, F.col("signal_ts").alias("ts"), F.lit("").alias("dedupe_key"), F.lit(None).cast("string").alias("side"),
        nothing.alias("size"), nothing.alias("usd"), F.lit(1).alias("_ask"))
    rows = known.withColumn("_ask", F.lit(0)).unionByName(asked_rows)
    bought, sold, order = F.col("side") == "BUY", F.col("_ask") == 0, ["ts", "_ask", "dedupe_key"]
    signed = F.when(bought, F.col("size")).otherwise(-F.col("size"))
    held = scan(rows, HOLDING, day_of("ts"), order, lowest("_net", "_low", signed),
                extreme("first_buy_ts", F.when(bought, F.col("ts")), False), keep=True)
    held = held.withColumn("shares", F.col("_net") - F.least(F.lit(0.0), F.col("_low"))).drop("_net", "_low")
    shares, size = F.col("shares"), F.col("size")
    kept = F.when(bought | ~sold, 1.0).when(shares > 0, shares / (shares + size)).otherwise(0.0)
    costed = affine(held, order, kept, F.when(bought, F.col("usd")).otherwise(0.0), "cost_usd")
    placed = costed.where((F.col("_ask") == 1) & (shares > min_shares) & (F.col("cost_usd") > min_cost)).select(
        *HOLDING, F.col("ts").alias("signal_ts"), "shares", "cost_usd", "first_buy_ts")
    asked = moments.groupBy("market_id").agg(F.array_sort(F.collect_set("signal_ts")).alias("_asked"))

    ts = F.col("ts")
    signed = F.when(bought, F.col("usd")).otherwise(-F.col("usd"))
    recent = (known.join(asked, "market_id")
              .withColumn("signal_ts", F.explode(F.filter(
                  "_asked", lambda t: (ts <= t) & (ts >= t - 86400))))
              .groupBy(*HOLDING, "signal_ts").agg(F.sum(signed).alias("recent_net_usd")))
    return (placed.join(recent, [*HOLDING, "signal_ts"], "left")
            .fillna({"recent_net_usd": 0.0})
            .withColumn("avg_price", F.col("cost_usd") / F.col("shares")))


def usable_price(price):
    return (price > 0) & (price < 1)


def observed_price(queries: DataFrame, curves: DataFrame, snapshots: DataFrame,
                   activity: DataFrame) -> DataFrame:
    """Price of every outcome as last seen at or before each asked moment (JOIN-7).

    ``queries`` has market_id, signal_ts and outcomes (their number). The curve wins when it has
    any usable sample, then the latest snapshot, then the last fill per outcome. Nothing after the
    moment is looked at. The second side of a pair is inferred from the first, except for
    snapshots, which quote both. ``last_activity_ts`` is the outcome's last fill at any price.

    Curves, fills and snapshots are merged with the moments at once; a snapshot stands on its
    market's first outcome and reaches the others through the market's row.
    """
    key = ["market_id", "signal_ts"]
    asked = queries.select(*key, "outcomes").distinct()
    sides = asked.withColumn("outcome_index", F.explode(
        F.sequence(F.lit(0), F.greatest("outcomes", F.lit(2)) - 1)))
    last = cut_lineage(asked.groupBy("market_id").agg(F.max("signal_ts").alias("_last")))

    def known(rows: DataFrame, ts: str, *cols: str) -> DataFrame:
        """Rows of asked markets, up to the last moment that is asked for."""
        return among(rows.select("market_id", ts, *cols), last, "market_id").where(F.col(ts) <= F.col("_last")).drop("_last")

    both = cut_lineage(asof_each(sides, ["market_id", "outcome_index"], "signal_ts", [
        (known(curves, "t", "outcome_index", "p", "seq"), "t", [Pick({"curve_p": "p", "curve_t": "t"}, ["seq"])]),
        (known(usable_fills(activity), "ts", "outcome_index", "price", "dedupe_key"), "ts", [
            Pick({"fill_p": "price", "fill_t": "ts"}, ["dedupe_key"], usable_price(F.col("price"))),
            Pick({"last_activity_ts": "ts"})]),
        (known(snapshots, "captured_ts", "seq", "prices", "liquidity", "spread").withColumn("outcome_index", F.lit(0)), "captured_ts", [
            Pick({"prices": "prices", "liquidity": "liquidity", "spread": "spread", "captured_ts": "captured_ts"}, ["seq"])])]))
    good, first = usable_price(F.col("curve_p")), F.col("outcome_index") == 0
    both = both.withColumns({"curve_p": F.when(good, F.col("curve_p")),
                             "curve_t": F.when(good, F.col("curve_t"))})
    market = both.groupBy(*key).agg(
        F.max("curve_t").alias("_curve_at"), F.max("fill_t").alias("_fill_at"),
        *[F.max(F.when(F.col("outcome_index") == i, F.col(c))).alias(f"_{c[0]}{i}") for c in ("curve_p", "fill_p") for i in (0, 1)],
        *[F.max(F.when(first, F.col(c))).alias(n) for c, n in (
            ("prices", "_prices"), ("liquidity", "_liquidity"), ("spread", "_spread"), ("captured_ts", "_snap_at"))])
    joined = both.drop("prices", "liquidity", "spread", "captured_ts").join(market, key)
    quoted = F.coalesce(F.exists("_prices", usable_price), F.lit(False))
    source = (F.when(F.col("_curve_at").isNotNull(), "series").when(quoted, "snapshot")
              .when(F.col("_fill_at").isNotNull(), "trade"))
    pair = F.greatest("outcomes", F.lit(2)) == 2

    def completed(own: str, zero: str, one: str):
        other = F.when(first, F.col(one)).otherwise(F.col(zero))
        return complement(own, other, F.when(pair, 2))

    from_snapshot = F.col("source") == "snapshot"
    return (joined.withColumn("source", source).where(F.col("source").isNotNull()).withColumns({
        "price": F.when(F.col("source") == "series", completed("curve_p", "_c0", "_c1"))
        .when(from_snapshot, F.get("_prices", F.col("outcome_index")))
        .otherwise(completed("fill_p", "_f0", "_f1")),
        "liquidity": F.when(from_snapshot, F.col("_liquidity")),
        "spread": F.when(from_snapshot, F.col("_spread")),
        "observed_ts": F.when(F.col("source") == "series", F.col("_curve_at"))
        .when(from_snapshot, F.col("_snap_at")).otherwise(F.col("_fill_at"))})
        .select(*key, "outcome_index", "price", "liquidity", "spread", "source", "observed_ts", "last_activity_ts"))
