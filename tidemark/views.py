"""Domain tables derived from the TPC-H-like driver tables, over all of their rows.

Prices are multiples of 1/128 and sizes whole numbers, so money sums are exact in doubles and do
not depend on the order of summation. Times are epoch seconds. ``AS_OF`` is the live clock and
``TAPE_AS_OF`` the clock of the event tape.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import epoch
from tidemark.session import prepare

AS_OF = 996624000
TAPE_AS_OF = 1706659200
FIRST_SETTLEMENT = 836000000
TAPE_START = 1704067200
CATEGORIES = ["POLITICS", "ECONOMICS", "SPORTS", "CRYPTO", "ENTERTAINMENT", "GEOPOLITICS"]
SPORTS_TYPES = ["moneyline", "spreads", "totals", "q1_spreads", "team_totals", "safety"]
LEAGUES = ["nfl", "nba", "epl", "chess"]


def price_of(seed):
    """A pseudo-random price in 2/128 .. 126/128."""
    return (F.pmod(seed, F.lit(125)) + 2) / F.lit(128.0)


def pick(values: list[str], index):
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


class Tables:
    """Lazily built views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def traders(self) -> DataFrame:
        k = F.col("s_suppkey")
        score = F.pmod(k * 37, F.lit(1001)) / F.lit(10.0)
        synced = F.when(k % 9 != 4, AS_OF - F.pmod(k * 7919, F.lit(300)) * 3600)
        active = F.when(k % 13 != 6, AS_OF - F.pmod(k * 104729, F.lit(3000)) * 3600)
        return self.raw("supplier").select(
            k.alias("trader_id"),
            F.concat(F.lit("0x"), F.lpad(k.cast("string"), 40, "0")).alias("wallet"),
            F.col("s_name").alias("display_name"), (F.col("s_acctbal") > 0).alias("active"),
            F.when(F.col("s_nationkey") == 7, "MANUAL").otherwise("LEADERBOARD").alias("source"),
            F.when(k % 8 != 3, score).alias("stored_score"),
            synced.alias("last_synced_ts"), active.alias("last_activity_ts"),
            (k % 17 == 5).alias("has_sync_error"))

    @cached_property
    def markets(self) -> DataFrame:
        """Ten parts make a market; its attributes are aggregates over them."""
        cents = F.round(F.col("p_retailprice") * 100).cast("long") * F.col("p_size")
        base = self.raw("part").groupBy(F.floor(F.col("p_partkey") / 10).alias("market_id")).agg(
            F.sum(cents).alias("_cents"), F.sum("p_size").cast("long").alias("_size"),
            F.min("p_name").alias("question"))
        m = F.col("market_id")
        resolved = m % 2 == 0
        settled = FIRST_SETTLEMENT + F.pmod(m * 7919, F.lit(1800)) * 86400 + F.pmod(m, F.lit(24)) * 3600
        sports = F.floor(m / 2) % 6 == 2
        thin = F.when(m % 7 == 3, 500.0).when(m % 7 == 5, 50.0).otherwise(1.0)
        p0 = price_of(m * 37)
        spread = F.when(m % 11 != 3, (F.pmod(m, F.lit(24)) + 1) / F.lit(128.0))
        end = F.when(resolved, settled + (m % 5 - 2) * 3600).otherwise(
            F.when(m % 13 != 5, AS_OF + (F.pmod(m * 31, F.lit(1000)) - 50) * 3600))
        return base.select(
            m.alias("market_id"), F.concat(F.lit("c"), m).alias("condition_id"),
            F.floor(m / 3).alias("event_id"), F.concat(F.lit("event-"), F.floor(m / 3)).alias("event_slug"),
            "question", pick(CATEGORIES, F.floor(m / 2)).alias("category"),
            F.array(p0, 1.0 - p0).alias("prices"),
            F.array(F.concat(F.lit("t"), m * 10), F.concat(F.lit("t"), m * 10 + 1)).alias("token_ids"),
            F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"),
            (F.col("_cents") / F.lit(100.0) / thin).alias("liquidity"),
            (F.col("_size") * 100.0).alias("volume"),
            spread.alias("spread"),
            (p0 - spread / 2.0).alias("best_bid"), (p0 + spread / 2.0).alias("best_ask"),
            resolved.alias("closed"), resolved.alias("resolved"), (m % 29 != 1).alias("accepting_orders"),
            F.when(resolved & (m % 31 != 2), F.pmod(F.floor(m / 2), F.lit(2)).cast("int")).alias("winner"),
            F.when(resolved & (m % 37 != 4), settled).alias("resolved_ts"), end.alias("end_ts"),
            F.when(m % 19 != 6, settled - (F.pmod(m * 17, F.lit(200)) + 1) * 86400).alias("start_ts"),
            F.when(m % 10 != 7, F.pmod(m * 13, F.lit(101)).cast("double")).alias("clarity_score"),
            F.when(sports & (m % 5 != 0) & ~resolved, end).alias("kickoff_ts"),
            F.when(sports, pick(SPORTS_TYPES, F.floor(m / 12))).alias("sports_market_type"),
            F.when(sports, pick(LEAGUES, F.floor(m / 24))).alias("league"),
            F.when(m % 23 != 9, AS_OF - F.pmod(m * 11, F.lit(7200))).alias("last_synced_ts"))

    @cached_property
    def activity(self) -> DataFrame:
        """Every line item is a fill.

        Every fourth trader mostly buys the side that will win; every tenth trades a few markets
        back and forth in the last days before the clock.
        """
        o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
        price = price_of(o * 7 + p * 13)
        rapid = (s % 10 == 1) & (o % 4 != 0)
        market = F.when(rapid, F.floor(p / 100) * 10).otherwise(F.floor(p / 10))
        outcome = F.when((s % 4 == 0) & (n % 3 != 0), F.pmod(F.floor(market / 2), F.lit(2))) \
            .otherwise(n % 2).cast("int")
        shipped = epoch("l_shipdate") + F.pmod(o * 37 + n, F.lit(86400))
        ts = F.when(rapid, AS_OF - 86400 * (o % 3 + 1) + n * 600 + o % 7 * 60).otherwise(shipped)
        return self.raw("lineitem").select(
            s.alias("trader_id"), market.alias("market_id"), outcome.alias("outcome_index"),
            F.concat(F.lit("t"), market * 10 + outcome).alias("asset"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.col("l_quantity").alias("size"), price.alias("price"),
            (F.col("l_quantity") * price).alias("usd"), ts.alias("ts"),
            F.concat_ws(":", o, n, p, s).alias("dedupe_key"))

    @cached_property
    def known_activity(self) -> DataFrame:
        return self.activity.where(F.col("ts") <= AS_OF)

    @cached_property
    def closed(self) -> DataFrame:
        """Buys before the settlement of a resolved market; every 17th market settles at 50 cents."""
        market = self.markets.where("resolved").select(
            "market_id", "category", "winner", "resolved_ts", "end_ts")
        bought = (self.activity.where(F.col("side") == "BUY").join(market, "market_id")
                  .where(F.col("ts") < F.coalesce("resolved_ts", "end_ts"))
                  .groupBy("trader_id", "market_id", "outcome_index", "category", "winner",
                           "resolved_ts", "end_ts")
                  .agg(F.sum("size").alias("shares"), F.sum("usd").alias("cost_basis_usd")))
        split = (F.col("market_id") % 17 == 3) | F.col("winner").isNull()
        won = F.when(~split, F.col("outcome_index") == F.col("winner"))
        paid = F.when(won, F.col("shares")).when(~won, 0.0).otherwise(F.col("shares") * 0.5)
        return bought.select(
            "trader_id", "market_id", "outcome_index", "category",
            F.concat(F.lit("t"), F.col("market_id") * 10 + F.col("outcome_index")).alias("asset"),
            (F.col("cost_basis_usd") / F.col("shares")).alias("avg_price"), "shares",
            "cost_basis_usd", (paid - F.col("cost_basis_usd")).alias("realized_pnl"), won.alias("won"),
            "resolved_ts", "end_ts")

    @cached_property
    def positions(self) -> DataFrame:
        """Net shares still held in open markets, valued at the market price."""
        live = self.markets.where(~F.col("resolved")).select("market_id", "prices")
        buy = F.col("side") == "BUY"
        held = (self.known_activity.join(live, "market_id")
                .groupBy("trader_id", "market_id", "outcome_index").agg(
            F.sum(F.when(buy, F.col("size")).otherwise(-F.col("size"))).alias("size"),
            F.sum(F.when(buy, F.col("size"))).alias("_bought"),
            F.sum(F.when(buy, F.col("usd"))).alias("_cost"),
            F.min(F.when(buy, F.col("ts"))).alias("opened_ts"),
            F.first(F.get("prices", F.col("outcome_index"))).alias("_price")))
        entry = F.col("_cost") / F.col("_bought")
        return held.where(F.col("size") > 0).select(
            "trader_id", "market_id", "outcome_index",
            F.concat(F.lit("t"), F.col("market_id") * 10 + F.col("outcome_index")).alias("asset"),
            "size", entry.alias("avg_price"), (F.col("size") * F.col("_price")).alias("current_value"),
            (F.col("size") * F.col("_price") - F.col("size") * entry).alias("cash_pnl"), "opened_ts")

    @cached_property
    def portfolio(self) -> DataFrame:
        return self.positions.groupBy("trader_id").agg(F.sum("current_value").alias("portfolio_value"))

    @cached_property
    def snapshots(self) -> DataFrame:
        """Every order is a market snapshot."""
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        p = price_of(o * 11)
        return self.raw("orders").select(
            F.floor(c / 10).alias("market_id"),
            (epoch("o_orderdate") + F.pmod(o * 13, F.lit(86400))).alias("captured_ts"),
            o.alias("seq"), F.array(p, 1.0 - p).alias("prices"),
            F.col("o_totalprice").alias("liquidity"),
            ((F.pmod(o, F.lit(12)) + 1) / F.lit(128.0)).alias("spread"))

    @cached_property
    def curves(self) -> DataFrame:
        """Every event is a price sample, its month stretched over the settlement years."""
        e = F.col("event_id")
        return self.raw("events").select(
            F.col("user_id").alias("market_id"), (e % 2).cast("int").alias("outcome_index"),
            (FIRST_SETTLEMENT + (epoch("ts") - TAPE_START) * 60).alias("t"),
            price_of(e * 31).alias("p"), e.alias("seq"))

    @cached_property
    def tape(self) -> DataFrame:
        """Every event is a public fill."""
        e = F.col("event_id")
        return self.raw("events").select(
            F.concat(F.lit("0x"), F.lpad(F.col("user_id").cast("string"), 40, "0")).alias("wallet"),
            F.floor(F.col("user_id") / 10).alias("market_id"), (e % 2).cast("int").alias("outcome_index"),
            F.round(F.col("value") * 100).cast("long").cast("double").alias("size"),
            price_of(e * 31).alias("price"), epoch("ts").alias("ts"),
            F.concat_ws(":", e, "user_id").alias("dedupe_key"))

    @cached_property
    def book(self) -> DataFrame:
        """Five levels on each side of every part's price."""
        k = F.col("p_partkey")
        p0, step = price_of(k * 37), (F.col("level") + 1) / F.lit(128.0)
        levels = self.raw("part").select(
            "p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"))
        both = levels.select(
            F.concat(F.lit("t"), k).alias("token_id"), F.explode(F.array(
                F.struct(F.lit("BID").alias("kind"), (p0 - step).alias("price")),
                F.struct(F.lit("ASK").alias("kind"), (p0 + step).alias("price")))).alias("_l"),
            (F.col("p_size") * (F.col("level") + 1)).cast("double").alias("size"))
        return both.select("token_id", "_l.kind", "_l.price", "size").where(
            (F.col("price") > 0) & (F.col("price") < 1))

    @cached_property
    def legs(self) -> DataFrame:
        """Every part is one leg of a three-leg event."""
        k = F.col("p_partkey")
        event = F.floor(k / 3)
        p0, spread = price_of(k * 37), (F.pmod(k, F.lit(16)) + 1) / F.lit(128.0)
        labels = F.when(k % 7 == 0, F.array(F.lit("No"), F.lit("Yes"))).otherwise(
            F.array(F.lit("Yes"), F.lit("No")))
        return self.raw("part").select(
            k.alias("leg_id"), event.alias("event_id"), F.col("p_name").alias("question"),
            labels.alias("outcomes"), F.array(p0, 1.0 - p0).alias("prices"),
            F.when(k % 10 != 9, p0 + spread / 2.0).alias("best_ask"), spread.alias("spread"),
            F.when(event % 3 == 1, "moneyline").otherwise("totals").alias("sports_market_type"),
            ((event % 3 == 0) & (k % 20 != 0)).alias("neg_risk"))

    @cached_property
    def bets(self) -> DataFrame:
        """Every order is a logged bet."""
        o, m = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 10)
        wallet = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        placed = epoch("o_orderdate")
        base = self.raw("orders").select(
            o.alias("bet_id"), m.alias("market_id"), (o % 2).cast("int").alias("outcome_index"),
            F.concat(F.lit("t"), m * 10 + o % 2).alias("asset"), price_of(o * 17).alias("entry_price"),
            (o % 5 + 1).cast("double").alias("stake"), placed.alias("placed_ts"),
            F.when(o % 6 != 1, placed + (o % 40) * 86400 + 43200).alias("closes_ts"),
            F.when(wallet, "WALLET").otherwise("MANUAL").alias("source"),
            F.when(o % 9 != 2, F.pmod(F.col("o_custkey") * 7, F.lit(1001)) / F.lit(10.0))
            .alias("horizon_score"),
            F.when(wallet, F.concat_ws(":", o, F.lit(0))).alias("external_id"))
        return base.join(self.markets.select("market_id", "category"), "market_id")
