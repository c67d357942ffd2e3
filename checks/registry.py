"""Registered queries: output columns, the Spark side and the DuckDB side of each."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracle import AS_OF, H, month, typed, wilson
from tidemark import fixed_values as V
from tidemark.config import merge_config
from tidemark.functions import numeric as N
from tidemark.functions import stats as ST
from tidemark.operators import behaviour, bets, board, consensus, holders, prefix, replay, traders
from tidemark.plans import evaluation, live_board, point_in_time
from tidemark.session import cut_lineage
from tidemark.views import Tables

PIT_CFG = {"backtest": {"max_price_age_hours": 720.0}}
KEY = ["market_id", "outcome_index"]


class Workspace(Tables):
    """The views plus derived tables, each written once to the shared folder and reused."""

    @cached_property
    def closed(self) -> DataFrame:
        return cut_lineage(Tables.closed.func(self))

    @cached_property
    def positions(self) -> DataFrame:
        return cut_lineage(Tables.positions.func(self))

    @cached_property
    def known_closed(self) -> DataFrame:
        return self.closed.where(F.col("resolved_ts").isNull() | (F.col("resolved_ts") <= AS_OF))

    @cached_property
    def seen(self) -> DataFrame:
        return cut_lineage(behaviour.considered_fills(self.activity, AS_OF))

    @cached_property
    def behaviour(self) -> DataFrame:
        return behaviour.behaviour(self.activity, self.known_closed, self.portfolio, AS_OF)

    @cached_property
    def metrics(self) -> DataFrame:
        return traders.trader_metrics(self.known_closed, ["trader_id"], AS_OF, self.positions,
                                      universe=self.traders)

    @cached_property
    def scores(self) -> DataFrame:
        return live_board.wallet_scores(
            self.traders, self.closed, self.positions, self.activity, self.portfolio, AS_OF)

    @cached_property
    def skills(self) -> DataFrame:
        return live_board.category_skills(self.closed, AS_OF)

    @cached_property
    def holders(self) -> DataFrame:
        return cut_lineage(holders.build_holders(self.positions, self.markets, self.traders, self.scores,
                                                 self.skills, self.known_activity, AS_OF))

    @cached_property
    def sides(self) -> DataFrame:
        return live_board.live_sides(self.markets, self.positions, AS_OF)

    @cached_property
    def consensus(self) -> DataFrame:
        return live_board.score_sides(self.holders, self.sides)

    @cached_property
    def board(self) -> DataFrame:
        return cut_lineage(live_board.build_board(self.consensus, self.holders, self.known_activity, AS_OF))

    @cached_property
    def universe(self) -> DataFrame:
        return point_in_time.testable_markets(self.markets, self.activity, 0, AS_OF)

    @cached_property
    def moments(self) -> DataFrame:
        return cut_lineage(point_in_time.signal_moments(
            self.universe, merge_config()["backtest"]["horizons"], AS_OF)
            .where(F.col("reject_reason").isNull())
            .select("market_id", "signal_ts", F.size("prices").alias("outcomes")))

    @cached_property
    def run(self) -> tuple[DataFrame, DataFrame]:
        signals, rejects = point_in_time.build_signals(
            self.universe, self.activity, self.closed, self.traders, self.curves, self.snapshots,
            AS_OF, PIT_CFG)
        return signals, cut_lineage(rejects)

    @cached_property
    def signals(self) -> DataFrame:
        return self.run[0]

    @cached_property
    def headline(self) -> DataFrame:
        return cut_lineage(evaluation.headline(self.signals))

    @cached_property
    def calibration(self) -> DataFrame:
        return cut_lineage(evaluation.calibration_test(self.signals, PIT_CFG))

    @cached_property
    def measured_bets(self) -> DataFrame:
        return cut_lineage(bets.close_bets(self.bets, self.curves, AS_OF))


Entry = tuple[str, Callable[[Workspace], DataFrame], str | None]
ENTRIES: dict[str, Entry] = {}
_CAST = {"i": "bigint", "d": "double", "s": "string", "b": "boolean"}


def entry(name: str, cols: str, spark: Callable[[Workspace], DataFrame], sql: str | None) -> None:
    ENTRIES[name] = (cols, spark, sql)


def conform(df: DataFrame, cols: str) -> DataFrame:
    """The registered columns, doubles to six decimals the same way the SQL side does it."""
    out = []
    for name, kind in (c.split(":") for c in cols.split()):
        value = F.col(name).cast(_CAST[kind])
        if kind == "d":
            value = F.floor(value * 1e6 + 0.37).cast("double") / 1e6
        out.append(value.alias(name))
    return df.select(*out)


_spaces: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _spaces:
        _spaces[key] = Workspace(spark, sf_dir)
    return _spaces[key]


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    cols, fn, _ = ENTRIES[name]
    return conform(fn(workspace(spark, sf_dir)), cols)


def oracle(name: str) -> str | None:
    cols, _, sql = ENTRIES[name]
    return None if sql is None else typed(cols, sql)


# --- flagship -----------------------------------------------------------------------------------
def leaders(w: Workspace) -> DataFrame:
    m = (w.closed.groupBy("trader_id").agg(
        F.count("won").alias("decided"), N.count_where(F.col("won")).alias("wins"),
        F.sum("realized_pnl").alias("pnl"), F.sum("cost_basis_usd").alias("staked")))
    i = ST.wilson("wins", "decided")
    return m.withColumns({"roi": F.col("pnl") / F.col("staked"), "win_low": i["low"], "win_high": i["high"]}) \
        .orderBy(F.desc("roi"), "trader_id").limit(20)


_lo, _hi = wilson("wins", "decided")
entry("wallet_leaders", "trader_id:i decided:i wins:i pnl:d staked:d roi:d win_low:d win_high:d", leaders,
      f"""SELECT *, pnl/staked AS roi, {_lo} AS win_low, {_hi} AS win_high FROM (SELECT trader_id, count(won) AS decided, count(*) FILTER (WHERE won) AS wins,
      sum(realized_pnl) AS pnl, sum(cost_basis_usd) AS staked FROM closed GROUP BY 1) ORDER BY roi DESC, trader_id LIMIT 20""")

# --- wallet scores ------------------------------------------------------------------------------
METRICS = """trader_id:i closed_count:i win_count:i loss_count:i realized_pnl:d total_staked:d roi:d win_rate:d avg_entry_price:d avg_position_usd:d
 largest_position_usd:d largest_win_usd:d largest_loss_usd:d roi_30d:d roi_90d:d months:i monthly_win_rate:d profit_volatility:d risk_adjusted_return:d
 top_win_share:d high_price_share:d conviction_ratio:d weighted_skill:d unrealized_pnl:d concentration_hhi:d"""
entry("trader_metrics", METRICS, lambda w: w.metrics, "SELECT * FROM wallet0")
entry("trader_score", "trader_id:i smart_score:d smart_base:d smart_penalty:d long_term:d consistency:d recent_form:d category_skill:d risk_adjusted:d sample_quality:d conviction:d",
      lambda w: w.scores.select("trader_id", "smart_score", F.col("smart_score_base").alias("smart_base"), F.col("smart_score_penalty").alias("smart_penalty"),
                                *[F.col(f"smart_score_{k}").alias(k) for k in "long_term consistency recent_form category_skill risk_adjusted sample_quality conviction".split()]),
      "SELECT trader_id, smart_score, smart_base, smart_penalty, smart_long_term AS long_term, smart_consistency AS consistency, smart_recent_form AS recent_form, smart_category_skill AS category_skill, smart_risk_adjusted AS risk_adjusted, smart_sample_quality AS sample_quality, smart_conviction AS conviction FROM smart_f")
entry("monthly_buckets", "trader_id:i month:s pnl:d staked:d wins:i losses:i roi:d",
      lambda w: traders.monthly_buckets(traders.settled_summary(w.known_closed, ["trader_id"]), ["trader_id"]), "SELECT * FROM rec_mon")
entry("category_performance", "trader_id:i category:s closed_count:i win_count:i realized_pnl:d total_staked:d roi:d win_rate:d skill_score:d", lambda w: w.skills,
      "SELECT * FROM rec_cat")
_band = "CASE " + " ".join(f"WHEN avg_price >= {a}e0 AND avg_price < {b}e0 THEN '{n}'" for n, a, b in V.ENTRY_BANDS) + " END"
entry("entry_buckets", "trader_id:i bucket:s count:i wins:i staked:d pnl:d roi:d win_rate:d", lambda w: traders.entry_buckets(w.closed, ["trader_id"]),
      f"""SELECT t.trader_id, b.bucket, count(c.bucket) AS count, count(*) FILTER (WHERE won) AS wins, coalesce(sum(cost_basis_usd),0e0) AS staked, coalesce(sum(realized_pnl),0e0) AS pnl,
      sum(realized_pnl)/sum(cost_basis_usd) AS roi, (count(*) FILTER (WHERE won))::DOUBLE/nullif(count(won),0) AS win_rate FROM (SELECT DISTINCT trader_id FROM closed) t
      CROSS JOIN (VALUES {','.join(f"('{n}')" for n, _, _ in V.ENTRY_BANDS)}) b(bucket) LEFT JOIN (SELECT *, {_band} AS bucket FROM closed) c ON c.trader_id=t.trader_id AND c.bucket=b.bucket GROUP BY 1,2""")
entry("pnl_curve", "trader_id:i day:i pnl:d cumulative:d", lambda w: traders.pnl_curve(w.closed),
      """SELECT trader_id, day, pnl, sum(pnl) OVER (PARTITION BY trader_id ORDER BY day) AS cumulative FROM (SELECT trader_id, resolved_ts // 86400 AS day, sum(realized_pnl) AS pnl
      FROM closed WHERE resolved_ts IS NOT NULL GROUP BY 1,2)""")
entry("monthly_pnl", "trader_id:i month:s pnl:d", lambda w: traders.monthly_pnl(w.closed), f"SELECT trader_id, {month('resolved_ts')} AS month, sum(realized_pnl) AS pnl FROM closed WHERE resolved_ts IS NOT NULL GROUP BY 1,2")
_curve = """SELECT *, sum(realized_pnl) OVER (PARTITION BY trader_id ORDER BY resolved_ts, market_id, outcome_index ROWS UNBOUNDED PRECEDING) AS cumulative_pnl,
 row_number() OVER (PARTITION BY trader_id ORDER BY resolved_ts, market_id, outcome_index) - 1 AS i, count(*) OVER (PARTITION BY trader_id) AS n FROM closed WHERE resolved_ts IS NOT NULL"""
entry("position_curve", "trader_id:i market_id:i outcome_index:i resolved_ts:i cumulative_pnl:d", lambda w: traders.position_curve(w.closed), _curve)
entry("thinned_curve", "trader_id:i market_id:i outcome_index:i cumulative_pnl:d", lambda w: traders.position_curve(w.closed, 20),
      f"SELECT * FROM ({_curve}) WHERE n <= 20 OR i = n - 1 OR i IN (SELECT floor(k*(n::DOUBLE/20e0)) FROM range(20) r(k))")
entry("newest_closed", "trader_id:i market_id:i outcome_index:i resolved_ts:i", lambda w: traders.newest_closed(w.closed, 25),
      "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trader_id ORDER BY resolved_ts DESC NULLS LAST, market_id, outcome_index) AS rn FROM closed) WHERE rn <= 25")
BEH = """trader_id:i trade_count:i trades_7d:i trades_30d:i small_trade_share:d distinct_markets:i both_sides_markets:i median_hold_seconds:d settled_count:i held_share:d
 turnover_ratio:d behaviour_class:s behaviour_confidence:d"""
entry("behaviour", BEH, lambda w: w.behaviour, "SELECT * FROM behaviour")
_why = [("VERY_HIGH_FREQUENCY", "trades_7d >= 1000", "bs"), ("HIGH_FREQUENCY", "trades_7d >= 300 AND trades_7d < 1000", "bs"), ("VERY_SHORT_HOLDS", "median_hold_seconds <= 1800", "bs"),
        ("LONG_HOLDS", "median_hold_seconds >= 604800", "d"), ("BOTH_SIDES", "both_sides_markets >= 8", "m"), ("SMALL_TRADES", "small_trade_share >= 0.6e0 AND trade_count >= 100", "bm"),
        ("HIGH_TURNOVER", "turnover_ratio >= 5", "sm"), ("RARELY_HELD", "settled_count >= 10 AND held_share <= 0.2e0", "s"), ("USUALLY_HELD", "settled_count >= 10 AND held_share >= 0.6e0", "d"),
        ("FREQUENT_REENTRY", "trade_count/distinct_markets >= 20", "sm"), ("FEW_PER_MARKET", "trade_count/distinct_markets <= 4", "d")]
_whys = ", ".join(f"CASE WHEN {test} AND contains('{classes}', c) THEN '{code}' END" for code, test, classes in _why)
entry("behaviour_reasons", "trader_id:i reasons:s", lambda w: w.behaviour.withColumn("reasons", F.array_join("behaviour_reasons", ",")),
      f"""SELECT trader_id, CASE WHEN trade_count < 5 THEN 'TOO_FEW_TRADES' ELSE concat_ws(',', {_whys}) END AS reasons
      FROM (SELECT *, CASE WHEN r[1] <= 1 OR s_d = r[1] THEN 'd' WHEN s_b = r[1] THEN 'b' WHEN s_s = r[1] THEN 's' ELSE 'm' END AS c FROM beh4)""")
entry("fifo_lots", "trader_id:i market_id:i outcome_index:i buy_ts:i sell_ts:i hold_seconds:i", lambda w: behaviour.fifo_lots(w.seen), "SELECT * FROM lots")
entry("both_sides_markets", "trader_id:i both_sides_markets:i", lambda w: behaviour.both_sides_markets(w.seen),
      "SELECT trader_id, coalesce(max(both_sides_markets), 0) AS both_sides_markets FROM (SELECT DISTINCT trader_id FROM seen WHERE side='BUY') LEFT JOIN both_bought USING (trader_id) GROUP BY 1")
entry("list_traders", "trader_id:i display_name:s smart_score:d open_positions:i", lambda w: traders.list_traders(w.traders, w.scores.select("trader_id", "smart_score"), w.positions),
      "SELECT t.trader_id, t.display_name, s.smart_score, coalesce(o.n,0) AS open_positions FROM trader t LEFT JOIN smart_f s USING (trader_id) LEFT JOIN (SELECT trader_id, count(*) AS n FROM open_p GROUP BY 1) o USING (trader_id) WHERE t.active")

# --- holders, consensus, board ------------------------------------------------------------------
entry("live_markets", "market_id:i", lambda w: holders.live_markets(w.markets, w.positions), "SELECT market_id FROM live")
entry("recent_net", "market_id:i trader_id:i outcome_index:i recent_net_usd:d", lambda w: holders.recent_net(w.activity, AS_OF), "SELECT *, net AS recent_net_usd FROM recent")
entry("last_activity", "market_id:i outcome_index:i last_activity_ts:i", lambda w: holders.last_activity(w.activity, KEY, AS_OF), "SELECT market_id, outcome_index, max(ts) AS last_activity_ts FROM fills GROUP BY 1,2")
entry("first_buy", "trader_id:i market_id:i outcome_index:i opened_ts:i", lambda w: holders.first_buy(w.activity), "SELECT trader_id, market_id, outcome_index, min(ts) AS opened_ts FROM activity WHERE side='BUY' GROUP BY 1,2,3")
entry("holders", "market_id:i outcome_index:i trader_id:i smart_score:d category_skill:d size_usd:d avg_price:d opened_ts:i typical_usd:d recent_net_usd:d likely_bot:b", lambda w: w.holders,
      "SELECT *, smart AS smart_score, skill AS category_skill, typical AS typical_usd, net AS recent_net_usd, bot AS likely_bot FROM holders")
entry("opposing_side", "market_id:i outcome_index:i opposing_count:i qualified_opposing_count:i opposing_exposure_usd:d",
      lambda w: holders.opposing_totals(holders.one_per_wallet(w.holders, ["market_id"]), ["market_id"], 60.0),
      """SELECT s.*, coalesce(opposing_count, 0) AS opposing_count, coalesce(qualified_opposing_count, 0) AS qualified_opposing_count, coalesce(opposing_exposure_usd, 0e0) AS opposing_exposure_usd
      FROM (SELECT DISTINCT market_id, outcome_index FROM holders) s LEFT JOIN cons_opp o USING (market_id, outcome_index)""")
# Opening times modulo 200000 s crowd a side's holders into 28 stretches of two hours; as they are, hardly any two meet.
entry("entry_clusters", "market_id:i outcome_index:i largest_cluster:i", lambda w: holders.entry_clusters(holders.one_per_wallet(w.holders.withColumn("opened_ts", F.col("opened_ts") % 200000), ["market_id"]), ["market_id"]),
      """SELECT market_id, outcome_index, max(n) AS largest_cluster FROM (SELECT a.market_id, a.outcome_index, a.trader_id, count(*) AS n FROM (SELECT * REPLACE (opened_ts % 200000 AS opened_ts) FROM holders) a
      JOIN (SELECT * REPLACE (opened_ts % 200000 AS opened_ts) FROM holders) b ON a.market_id=b.market_id AND a.outcome_index=b.outcome_index AND (b.trader_id=a.trader_id OR ((b.opened_ts > a.opened_ts OR (b.opened_ts=a.opened_ts AND (b.avg_price > a.avg_price OR (b.avg_price = a.avg_price AND b.trader_id > a.trader_id))))
      AND b.opened_ts - a.opened_ts <= 7200 AND abs(b.avg_price - a.avg_price) <= 0.01e0)) WHERE a.opened_ts IS NOT NULL GROUP BY 1,2,3) GROUP BY 1,2""")
entry("entry_clusters_unfolded", "market_id:i outcome_index:i largest_cluster:i", lambda w: holders.entry_clusters(holders.one_per_wallet(w.holders, ["market_id"]), ["market_id"]),
      """SELECT market_id, outcome_index, max(n) AS largest_cluster FROM (SELECT a.market_id, a.outcome_index, a.trader_id, count(*) AS n FROM holders a
      JOIN holders b ON a.market_id=b.market_id AND a.outcome_index=b.outcome_index AND (b.trader_id=a.trader_id OR ((b.opened_ts > a.opened_ts OR (b.opened_ts=a.opened_ts AND (b.avg_price > a.avg_price OR (b.avg_price = a.avg_price AND b.trader_id > a.trader_id))))
      AND b.opened_ts - a.opened_ts <= 7200 AND abs(b.avg_price - a.avg_price) <= 0.01e0)) WHERE a.opened_ts IS NOT NULL GROUP BY 1,2,3) GROUP BY 1,2""")
CONS = """market_id:i outcome_index:i trader_count:i qualified_count:i bot_count:i exposure_usd:d opposing_count:i qualified_opposing_count:i opposing_exposure_usd:d bought_24h:d sold_24h:d
 increasing_count:i decreasing_count:i avg_entry_price:d weighted_entry_price:d top_wallet_share:d median_age_hours:d entry_gap:d entry_quality:s consensus:d agreement:d trader_quality:d category_skill:d recency:d"""
entry("consensus", CONS, lambda w: w.consensus.select("*", *[F.col(f"consensus_{k}").alias(k) for k in "agreement trader_quality category_skill recency".split()]),
      "SELECT *, cons_score AS consensus, cons_agreement AS agreement, cons_trader_quality AS trader_quality, cons_category_skill AS category_skill, cons_recency AS recency FROM cons_f")
entry("contributors", "market_id:i outcome_index:i trader_id:i weight:d size_usd:d", lambda w: consensus.contributors(w.holders), f"SELECT *, {H('w', 2)} AS weight FROM cons_h")
entry("side_holders", "market_id:i outcome_index:i trader_id:i smart_score:d current_value:d", lambda w: holders.side_holders(w.positions, w.traders, w.scores), "SELECT p.*, s.smart_score FROM open_p p LEFT JOIN smart_f s USING (trader_id)")
entry("listing_gate", "reason:s sides:i", lambda w: board.gate_counts(board.listing_gate(w.consensus)), "SELECT coalesce(reject_reason,'LISTED') AS reason, count(*) AS sides FROM gated GROUP BY 1")
OPP = """market_id:i outcome_index:i opportunity:d base:d penalty:d model_low:d model_mid:d model_high:d edge_points:d risk_level:s hours_left:d idle_hours:d liquidity_score:d execution:d rec:d"""
entry("opportunity_score", OPP, lambda w: w.board.select("*", F.col("opportunity_base").alias("base"), F.col("opportunity_penalty").alias("penalty"), F.col("opportunity_liquidity").alias("liquidity_score"),
                                                          F.col("opportunity_execution").alias("execution"), F.col("opportunity_recency").alias("rec")),
      "SELECT *, opp_score AS opportunity, opp_base AS base, opp_penalty AS penalty, opp_liquidity AS liquidity_score, opp_execution AS execution, opp_recency AS rec, CASE WHEN risk_points >= 4 THEN 'VERY HIGH' WHEN risk_points >= 2 THEN 'HIGH' WHEN risk_points >= 1 THEN 'MODERATE' ELSE 'LOW' END AS risk_level FROM opp_f")
entry("risk_reasons", "market_id:i outcome_index:i reasons:s", lambda w: w.board.withColumn("reasons", F.array_join("risk_reasons", ",")),
      """SELECT market_id, outcome_index, concat_ws(',', CASE WHEN current_price < 0.15e0 THEN 'LONGSHOT' WHEN current_price < 0.35e0 THEN 'UNDERDOG' END, CASE WHEN liquidity < 10000 THEN 'THIN_LIQUIDITY' END,
      CASE WHEN hours_left < 24 THEN 'IMMINENT' END, CASE WHEN clarity_score < 45 THEN 'AMBIGUOUS' END) AS reasons FROM opp_f""")
entry("sports_angle", "market_id:i outcome_index:i tier:s kind_label:s untradeable_reason:s game_phase:s late_usd:d early_usd:d late_share:d line_move_points:d line_verdict:s sports_settles_ts:i", lambda w: w.board, "SELECT * FROM sport")
entry("horizon_score", "market_id:i outcome_index:i horizon:d base:d penalty:d effective_price:d hours_to_settle:d capital_days:d edge_retention:d return_per_day:d net_edge_points:d settles_ts:i",
      lambda w: w.board.select("*", F.col("horizon_base").alias("base"), F.col("horizon_penalty").alias("penalty")), "SELECT *, hor_score AS horizon, hor_base AS base, hor_penalty AS penalty FROM hor_f")
entry("board_rank", "market_id:i outcome_index:i opportunity:d rank:i", lambda w: w.board, "SELECT *, opp_score AS opportunity FROM board")
_rules = [("STRONG_CONSENSUS", "POSITIVE", "qualified_count >= 3 AND cons_score >= 70"), ("RECENT_ACCUMULATION", "POSITIVE", "increasing_count >= 2 AND bought_24h >= 10000"),
          ("CATEGORY_EXPERTS", "POSITIVE", "cons_category_skill >= 70"), ("ENTRY_ATTRACTIVE", "POSITIVE", "entry_quality = 'GOOD'"), ("CHASING", "WARNING", "entry_quality IN ('POOR','STALE')"),
          ("ONE_WALLET_SIGNAL", "WARNING", "top_wallet_share > 0.6e0"), ("LOW_LIQUIDITY", "WARNING", "liquidity < 2000"), ("WIDE_SPREAD", "WARNING", "spread > 0.05e0"),
          ("POSSIBLE_BOT_ACTIVITY", "WARNING", "bot_count > 0"), ("STALE_POSITIONS", "WARNING", "idle_hours > 336"), ("RESOLVING_SOON", "WARNING", "hours_left < 12"), ("AMBIGUOUS_RESOLUTION", "WARNING", "clarity_score < 45")]
entry("signal_badges", "market_id:i outcome_index:i type:s tone:s", lambda w: board.signal_badges(w.board),
      " UNION ALL ".join(f"SELECT market_id, outcome_index, '{k}' AS type, '{t}' AS tone FROM board WHERE {c}" for k, t, c in _rules))
entry("list_opportunities", "market_id:i outcome_index:i opportunity:d", lambda w: board.list_opportunities(w.board, AS_OF, limit=40, min_liquidity=1000, max_spread=0.12, min_traders=2, max_gap_cents=30),
      "SELECT *, opp_score AS opportunity FROM board WHERE liquidity >= 1000 AND spread <= 0.12e0 AND qualified_count >= 2 AND (entry_gap IS NULL OR abs(entry_gap)*100e0 <= 30) ORDER BY opp_score DESC, market_id, outcome_index LIMIT 40")
_cs = f"SELECT * FROM board WHERE settles_ts > {AS_OF} AND settles_ts <= {AS_OF} + 2160000"
entry("cash_soon", "market_id:i outcome_index:i horizon:d", lambda w: board.cash_soon(w.board, AS_OF, within_hours=600)[0],
      f"SELECT *, hor_score AS horizon FROM ({_cs}) WHERE net_edge_points > 0 ORDER BY hor_score DESC, market_id, outcome_index LIMIT 50")
for _sort, _by in (("chance", "model_mid DESC NULLS LAST"), ("profit", "effective_price NULLS LAST")):
    entry(f"cash_soon_{_sort}", "market_id:i outcome_index:i horizon:d", lambda w, sort=_sort: board.cash_soon(w.board, AS_OF, within_hours=600, sort=sort)[0],
          f"SELECT *, hor_score AS horizon FROM ({_cs}) WHERE net_edge_points > 0 ORDER BY {_by}, market_id, outcome_index LIMIT 50")
entry("cash_soon_counts", "in_window:i edge_eaten_by_spread:i below_score_floor:i", lambda w: board.cash_soon(w.board, AS_OF, within_hours=600, min_score=30)[1],
      f"SELECT count(*) AS in_window, count(*) FILTER (WHERE net_edge_points IS NULL OR net_edge_points <= 0) AS edge_eaten_by_spread, count(*) FILTER (WHERE net_edge_points > 0 AND hor_score < 30) AS below_score_floor FROM ({_cs})")
_slate = f"""SELECT *, CASE WHEN kickoff_ts IS NULL THEN 'SEASON_FUTURE' WHEN kickoff_ts > {AS_OF} + 1440000 THEN 'LATER' WHEN untradeable_reason IS NOT NULL THEN 'UNTRADEABLE' WHEN game_phase IN ('IN_PLAY','ENDED') THEN 'IN_PLAY' ELSE 'KEPT' END AS fate
 FROM (SELECT * FROM board WHERE category = 'SPORTS')"""
entry("sports_slate_counts", "total_sides:i untradeable:i in_play:i season_futures:i", lambda w: board.sports_slate(w.board, AS_OF, within_hours=400)[1],
      f"SELECT count(*) AS total_sides, count(*) FILTER (WHERE fate='UNTRADEABLE') AS untradeable, count(*) FILTER (WHERE fate='IN_PLAY') AS in_play, count(*) FILTER (WHERE fate='SEASON_FUTURE') AS season_futures FROM ({_slate})")
entry("games", "game:s kickoff_ts:i sides:i best_market:i best_outcome:i", lambda w: board.games(board.sports_slate(w.board, AS_OF, within_hours=400)[0]),
      f"""SELECT event_id::VARCHAR AS game, min(kickoff_ts) AS kickoff_ts, count(*) AS sides, arg_min(market_id, {{'h': -hor_score, 'm': market_id, 'o': outcome_index}}) AS best_market, arg_min(outcome_index, {{'h': -hor_score, 'm': market_id, 'o': outcome_index}}) AS best_outcome
      FROM ({_slate}) WHERE fate='KEPT' GROUP BY 1 ORDER BY 2, 1 LIMIT 40""")
entry("category_counts", "category:s sides:i", lambda w: board.category_counts(w.board), "SELECT category, count(*) AS sides FROM board GROUP BY 1")
entry("dashboard", "tracked:i active:i listed:i strong:i fills_24h:i volume_24h:d", lambda w: board.dashboard(w.traders, w.board, w.consensus, w.activity, AS_OF, 40.0),
      f"SELECT (SELECT count(*) FROM trader) AS tracked, (SELECT count(*) FROM trader WHERE active) AS active, (SELECT count(*) FROM board) AS listed, (SELECT count(*) FROM cons_f WHERE cons_score >= 40) AS strong, (SELECT count(*) FROM fills WHERE ts >= {AS_OF}-86400) AS fills_24h, (SELECT sum(usd) FROM fills WHERE ts >= {AS_OF}-86400) AS volume_24h")
entry("short_term_stats", "settling_today:i settling_this_week:i best_return_per_day:d upcoming_games:i", lambda w: board.short_term_stats(w.board, AS_OF),
      f"SELECT count(*) FILTER (WHERE settles_ts > {AS_OF} AND settles_ts <= {AS_OF}+86400) AS settling_today, count(*) FILTER (WHERE settles_ts > {AS_OF} AND settles_ts <= {AS_OF}+604800) AS settling_this_week, max(return_per_day) FILTER (WHERE settles_ts > {AS_OF} AND settles_ts <= {AS_OF}+604800 AND net_edge_points > 0) AS best_return_per_day, count(DISTINCT event_id) FILTER (WHERE kickoff_ts > {AS_OF}) AS upcoming_games FROM board")
entry("consensus_list", "market_id:i outcome_index:i exposure_usd:d listed:b", lambda w: board.consensus_list(w.consensus, w.board), "SELECT c.*, b.market_id IS NOT NULL AS listed FROM (SELECT * FROM cons_f ORDER BY exposure_usd DESC, market_id, outcome_index LIMIT 80) c LEFT JOIN (SELECT market_id, outcome_index FROM board) b USING (market_id, outcome_index)")
entry("consensus_totals", "exposure_usd:d sides:i", lambda w: board.consensus_totals(w.consensus), "SELECT sum(exposure_usd) AS exposure_usd, count(*) AS sides FROM cons_f")

# --- point in time --------------------------------------------------------------------------------
entry("testable_markets", "market_id:i resolved_ts:i", lambda w: w.universe, "SELECT * FROM universe")
entry("replay_positions", "market_id:i signal_ts:i trader_id:i outcome_index:i shares:d cost_usd:d avg_price:d first_buy_ts:i recent_net_usd:d", lambda w: replay.replay_positions(w.activity, w.moments), "SELECT * FROM pos_then")
entry("observed_price", "market_id:i signal_ts:i outcome_index:i price:d liquidity:d spread:d source:s observed_ts:i", lambda w: replay.observed_price(w.moments, w.curves, w.snapshots, w.activity), "SELECT * FROM px")
entry("trader_scores_asof", "trader_id:i as_of_day:i smart_score:d", lambda w: traders.trader_scores_asof(
    w.closed.withColumn("resolved_ts", F.coalesce("resolved_ts", "end_ts")), w.traders.select("trader_id", F.explode(F.array(*[F.lit(d) for d in (10300, 10900, 11400)])).alias("as_of_day"))),
      "SELECT n.*, coalesce(a.asofs_score, 0e0) AS smart_score FROM need3 n LEFT JOIN asofs_f a USING (trader_id, as_of_day)")
entry("signals", "horizon_days:i market_id:i outcome_index:i signal_ts:i price:d source:s age_seconds:i opportunity:d consensus:d qualified_count:i trader_count:i weighted_entry_price:d entry_gap:d won:b pnl:d", lambda w: w.signals, "SELECT * FROM signal")
entry("reject_counts", "horizon_days:i reject_reason:s rejected:i", lambda w: w.run[1],
      "SELECT horizon_days, reason AS reject_reason, count(*) AS rejected FROM (SELECT horizon_days, reason FROM judged WHERE reason IS NOT NULL UNION ALL SELECT horizon_days, side_reason FROM pside0 WHERE side_reason IS NOT NULL) GROUP BY 1,2")
_wl, _wh = wilson("wins", "signals")
entry("score_bands", "horizon_days:i band:s signals:i wins:i implied:d roi:d win_rate:d win_low:d win_high:d edge_points:d", lambda w: evaluation.score_bands(w.signals),
      f"""SELECT *, wins/nullif(signals,0) AS win_rate, {_wl} AS win_low, {_wh} AS win_high, (wins/nullif(signals,0) - implied)*100e0 AS edge_points FROM (SELECT h.horizon_days, b.band, count(s.band) AS signals, count(*) FILTER (WHERE won) AS wins, avg(price) AS implied, avg(pnl) AS roi
      FROM (SELECT DISTINCT horizon_days FROM signal) h CROSS JOIN (VALUES {','.join(f"('{n}')" for n, _, _ in V.SIGNAL_BANDS)}) b(band) LEFT JOIN signal s ON s.horizon_days=h.horizon_days AND s.band=b.band GROUP BY 1,2)""")
_dd = """SELECT horizon_days, least(0e0, min(cum - greatest(0e0, peak))) AS max_drawdown FROM (SELECT *, max(cum) OVER (PARTITION BY horizon_days ORDER BY resolved_ts, market_id, outcome_index ROWS UNBOUNDED PRECEDING) AS peak
 FROM (SELECT *, sum(pnl) OVER (PARTITION BY horizon_days ORDER BY resolved_ts, market_id, outcome_index ROWS UNBOUNDED PRECEDING) AS cum FROM signal)) GROUP BY 1"""
entry("max_drawdown", "horizon_days:i max_drawdown:d", lambda w: evaluation.max_drawdown(w.signals), _dd)
_rank = "(rank() OVER (PARTITION BY horizon_days ORDER BY {0}) + (count(*) OVER (PARTITION BY horizon_days, {0}) - 1)/2e0)"
entry("rank_correlation", "horizon_days:i rank_correlation:d", lambda w: prefix.spearman(w.signals.withColumn("y", F.col("won").cast("int")), "opportunity", "y", ["horizon_days"], "rank_correlation"),
      f"SELECT horizon_days, corr(rx, ry) AS rank_correlation FROM (SELECT horizon_days, {_rank.format('opportunity')} AS rx, {_rank.format('won')} AS ry FROM signal) GROUP BY 1")
entry("average_rank", "horizon_days:i opportunity:d average_rank:d tied:i", lambda w: prefix.average_rank(w.signals, "opportunity", ["horizon_days"]),
      f"SELECT horizon_days, opportunity, any_value(r) AS average_rank, count(*) AS tied FROM (SELECT horizon_days, opportunity, {_rank.format('opportunity')} AS r FROM signal) GROUP BY 1,2")
entry("run_headline", "horizon_days:i signals:i wins:i losses:i win_rate:d implied:d roi:d edge_points:d from_series:i from_snapshot:i from_trade:i median_age_hours:d p90_age_hours:d markets_tested:i", lambda w: w.headline,
      """SELECT *, wins/signals AS win_rate, signals - wins AS losses, (wins/signals - implied)*100e0 AS edge_points, ages[least(n-1, floor(n*0.5e0))::BIGINT+1]/3600e0 AS median_age_hours, ages[least(n-1, floor(n*0.9e0))::BIGINT+1]/3600e0 AS p90_age_hours
      FROM (SELECT horizon_days, count(*) AS signals, count(*) AS n, count(*) FILTER (WHERE won) AS wins, avg(price) AS implied, avg(pnl) AS roi, count(*) FILTER (WHERE source='series') AS from_series, count(*) FILTER (WHERE source='snapshot') AS from_snapshot,
      count(*) FILTER (WHERE source='trade') AS from_trade, count(DISTINCT market_id) AS markets_tested, list(age_seconds ORDER BY age_seconds) AS ages FROM signal GROUP BY 1)""")
_u = "4294967296"
_imul = lambda a, b: f"((({a})::HUGEINT * ({b})::HUGEINT) % {_u})::BIGINT"
_draw = f"""SELECT *, xor(t3, t3 >> 14)::DOUBLE/4294967296e0 AS u FROM (SELECT *, xor(t, ((t + {_imul('xor(t, t >> 7)', 't | 61')}) % {_u})) AS t3
 FROM (SELECT *, {_imul('xor(st, st >> 15)', 'st | 1')} AS t FROM (SELECT *, ((({{k}})::HUGEINT + 1)*1831565813 + 20260910) % {_u} AS st0, (((({{k}})::HUGEINT + 1)*1831565813 + 20260910) % {_u})::BIGINT AS st FROM {{src}})))"""
entry("seeded_draws", "event_id:i u:d", lambda w: w.raw("events").select("event_id", ST.uniform_draw(20260910, F.col("event_id")).alias("u")), _draw.format(k="event_id", src="events"))
_obs = f"""SELECT s.*, row_number() OVER (PARTITION BY horizon_days ORDER BY market_id, outcome_index) - 1 AS i, count(*) OVER (PARTITION BY horizon_days) AS n, {_rank.format('opportunity')} AS rx FROM signal s"""
_sim = _draw.format(k="it*n + i", src=f"(SELECT * FROM ({_obs}) o, range(2000) r(it))")
_bandp = """SELECT horizon_days, it, max(e) AS best, sum(sw) AS sw, sum(sr) AS sr, sum(c) AS n, sum(imp) AS imp FROM (SELECT horizon_days, it, band, count(*) AS c, sum(hit) AS sw, sum(hit*rx) AS sr, sum(price) AS imp,
 CASE WHEN count(*) >= 20 THEN (sum(hit)/count(*) - sum(price)/count(*))*100e0 END AS e FROM {0} GROUP BY ALL) GROUP BY ALL"""
_r01 = "(sr - sw*(n+1e0)/2e0)*n/2e0 / sqrt(dx * (sw*(n-sw)*n/4e0))"
entry("calibration", "horizon_days:i signals:i best_band_edge:d best_band_p:d rank_correlation_p:d overall_edge:d overall_edge_p:d significance:s", lambda w: w.calibration,
      f"""SELECT *, CASE WHEN best_band_p IS NULL THEN 'Not testable' WHEN best_band_p <= 0.01e0 THEN 'Unlikely to be chance' WHEN best_band_p <= 0.05e0 THEN 'Possibly real' WHEN best_band_p <= 0.2e0 THEN 'Consistent with chance' ELSE 'Indistinguishable from chance' END AS significance FROM (SELECT o.horizon_days, any_value(o.n) AS signals, any_value(o.best) AS best_band_edge, CASE WHEN count(o.best) > 0 THEN (count(*) FILTER (WHERE s.best >= o.best - 1e-9) + 1)/2001e0 END AS best_band_p, CASE WHEN count(o.r) > 0 THEN (count(*) FILTER (WHERE s.r >= o.r - 1e-12)+1)/2001e0 END AS rank_correlation_p,
      any_value(o.edge) AS overall_edge, (count(*) FILTER (WHERE s.edge >= o.edge - 1e-9)+1)/2001e0 AS overall_edge_p FROM
      (SELECT *, {_r01} AS r, (sw/n - imp/n)*100e0 AS edge FROM ({_bandp.format(f"(SELECT *, 0 AS it, won::INT AS hit FROM ({_obs}))")}) JOIN (SELECT horizon_days, sum(rx*rx) - count(*)*(count(*)+1e0)*(count(*)+1e0)/4e0 AS dx FROM ({_obs}) GROUP BY 1) USING (horizon_days)) o JOIN
      (SELECT *, CASE WHEN sw > 0 AND sw < n THEN {_r01} END AS r, (sw/n - imp/n)*100e0 AS edge FROM ({_bandp.format(f"(SELECT *, (u < price)::INT AS hit FROM ({_sim}))")}) JOIN (SELECT horizon_days, sum(rx*rx) - count(*)*(count(*)+1e0)*(count(*)+1e0)/4e0 AS dx FROM ({_obs}) GROUP BY 1) USING (horizon_days)) s
      ON s.horizon_days = o.horizon_days WHERE o.n >= 10 GROUP BY 1)""")
_bestband = f"""SELECT horizon_days, arg_max(band, {{'e': e, 'p': -p}}) AS best_band FROM (SELECT horizon_days, band, count(*) AS c, (sum(won::INT)/count(*) - avg(price))*100e0 AS e,
 list_position([{','.join(f"'{n}'" for n, _, _ in V.SIGNAL_BANDS)}], band) AS p FROM signal GROUP BY 1,2) WHERE c >= 20 GROUP BY 1"""
_outcomes = f"""SELECT h.horizon_days, h.signals, h.wins/h.signals AS win_rate, b.best_band, c.best_band_p, r.rank_correlation, c.best_band_p <= 0.05e0 AND h.signals >= 100 AS significant_alone
 FROM (SELECT horizon_days, count(*) AS signals, count(*) FILTER (WHERE won) AS wins FROM signal GROUP BY 1) h LEFT JOIN ({_bestband}) b USING (horizon_days) LEFT JOIN ({ENTRIES['calibration'][2]}) c USING (horizon_days) LEFT JOIN ({ENTRIES['rank_correlation'][2]}) r USING (horizon_days)"""
entry("horizon_outcomes", "horizon_days:i signals:i win_rate:d best_band:s best_band_p:d significant_alone:b", lambda w: evaluation.horizon_outcomes(w.headline, w.calibration), _outcomes)
entry("robustness", "usable_horizons:i significant_horizons:i positive_correlations:i replicated_bands:i verdict:s", lambda w: evaluation.robustness(evaluation.horizon_outcomes(w.headline, w.calibration)),
      f"""SELECT u AS usable_horizons, s AS significant_horizons, pos AS positive_correlations, rb AS replicated_bands, CASE WHEN u < 2 THEN 'TOO LITTLE DATA' WHEN most/u >= 0.6e0 THEN 'REPLICATES' WHEN rb > 0 THEN 'INCONSISTENT' WHEN s > 0 THEN 'DOES NOT REPLICATE' ELSE 'NOTHING FOUND' END AS verdict
      FROM (SELECT count(*) FILTER (WHERE signals >= 100) AS u, count(*) FILTER (WHERE significant_alone) AS s, count(*) FILTER (WHERE rank_correlation > 0) AS pos FROM ({_outcomes})),
      (SELECT count(*) AS rb, max(n) AS most FROM (SELECT best_band, count(*) AS n FROM ({_outcomes}) WHERE significant_alone GROUP BY 1 HAVING count(*) >= 2))""")
_bandpos = f"list_position([{','.join(f"'{n}'" for n, _, _ in V.SIGNAL_BANDS)}], band)"
entry("run_warnings", "horizon_days:i warnings:s", lambda w: evaluation.warning_codes(w.headline, evaluation.score_bands(w.signals), w.calibration, w.run[1]).withColumn("warnings", F.array_join("warnings", ",")),
      f"""SELECT horizon_days, concat_ws(',', CASE WHEN h.signals < 30 THEN 'FEW_SIGNALS' END, CASE WHEN c.best_band_p > 0.05e0 THEN 'BEST_BAND_IS_CHANCE' WHEN c.best_band_p IS NOT NULL THEN 'BEST_BAND_SURVIVES' END,
      CASE WHEN r.rank_correlation <= 0.02e0 THEN 'SCORE_DOES_NOT_RANK' END, CASE WHEN s.n >= 2 AND s.top < s.bottom THEN 'NOT_MONOTONIC' END, CASE WHEN h.median_age_hours > 6 THEN 'STALE_PRICES' END,
      CASE WHEN h.from_trade > h.from_series + h.from_snapshot THEN 'PRICES_FROM_FILLS' END, CASE WHEN m.rejected > h.markets_tested THEN 'MANY_WITHOUT_PRICE' END, 'WATCHLIST_HINDSIGHT') AS warnings
      FROM ({ENTRIES['run_headline'][2]}) h LEFT JOIN ({ENTRIES['calibration'][2]}) c USING (horizon_days) LEFT JOIN ({ENTRIES['rank_correlation'][2]}) r USING (horizon_days)
      LEFT JOIN (SELECT horizon_days, count(*) AS n, arg_max(edge_points, {_bandpos}) AS top, arg_min(edge_points, {_bandpos}) AS bottom FROM ({ENTRIES['score_bands'][2]}) WHERE signals >= 20 AND edge_points IS NOT NULL GROUP BY 1) s USING (horizon_days)
      LEFT JOIN (SELECT horizon_days, rejected FROM ({ENTRIES['reject_counts'][2]}) WHERE reject_reason = 'NO_PRICE') m USING (horizon_days)""")

# The remaining areas register themselves on import.
from checks import registry_ingest, registry_market  # noqa: E402,F401
