"""Registered queries: prices, books, tape, bets, events, watchlist."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.oracle import AS_OF, TAPE_AS_OF, C, H, S, clip, day
from checks.registry import KEY, Workspace, entry
from tidemark import fixed_values as V
from tidemark.functions import numeric as N
from tidemark.functions import pricing as PR
from tidemark.operators import allocation, asof, bets, board, books, events, watchlist

# --- scalar functions over whole tables ---------------------------------------------------------
_x = "l_extendedprice / cast(1000 as double) - cast(40 as double)"
entry("numeric_functions", "dedupe_key:s half:d scaled:d liq:d tight:d ratio:d band:s", lambda w: w.raw("lineitem").select(
    F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("dedupe_key"), N.half_up(F.expr(_x), 1).alias("half"), N.scale_to_score(F.expr(_x), -20.0, 30.0).alias("scaled"),
    N.liquidity_score("l_extendedprice", (1000.0, 500000.0)).alias("liq"), N.spread_score("l_tax", (0.001, 0.08)).alias("tight"),
    N.safe_divide("l_tax", "l_discount").alias("ratio"), N.band_label("l_discount", V.ENTRY_BANDS).alias("band")),
    f"""SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS dedupe_key, {H('(l_extendedprice/1000e0 - 40e0)', 1)} AS half, {S('(l_extendedprice/1000e0 - 40e0)', -20.0, 30.0)} AS scaled,
    {clip('(log10(greatest(l_extendedprice,1e0)) - log10(1000e0))/(log10(500000e0)-log10(1000e0))*100e0', '0e0', '100e0')} AS liq, 100e0 - {S('l_tax', 0.001, 0.08)} AS tight, l_tax/nullif(l_discount,0e0) AS ratio,
    CASE WHEN l_discount < 0.1e0 THEN '0-10' ELSE '10-25' END AS band FROM lineitem""")


def pricing(w: Workspace):
    f = w.activity.withColumns(PR.payout("size", "price") | PR.expected_value(F.col("size") / 50.0, "price") | PR.entry_gap("price", F.col("size") / 64.0, {"entry_gap": {"good": 0.05, "fair": 0.1, "poor": 0.2}}))
    return f.withColumn("effective", PR.effective_price("price", F.col("size") / 40.0, F.col("price") / 8.0, 0.01))


_ent = "(size/64e0)"
_g = f"(price - {_ent})"
_gs = f"CASE WHEN {_g} <= 0 THEN CASE WHEN abs({_g}) > 0.2e0 THEN 75e0 ELSE least(100e0, 90e0 + least(10e0, abs({_g})/0.2e0*10e0)) END ELSE greatest(0e0, 100e0 - {_g}/0.2e0*85e0) END"
_gq = f"CASE WHEN {_g} < -0.05e0 THEN 'BETTER_THAN_ELITE' WHEN abs({_g}) <= 0.05e0 THEN 'GOOD' WHEN abs({_g}) <= 0.1e0 THEN 'FAIR' WHEN abs({_g}) <= 0.2e0 THEN 'POOR' ELSE 'STALE' END"
entry("pricing_functions", "dedupe_key:s shares:d profit:d return_pct:d break_even:d ev_per_share:d edge_points:d entry_gap:d entry_quality:s entry_score:d effective:d", pricing,
      f"""SELECT dedupe_key, size/price AS shares, size/price - size AS profit, (size/price - size)/size AS return_pct, price AS break_even, size/50e0 - price AS ev_per_share, (size/50e0 - price)*100e0 AS edge_points, {_g} AS entry_gap, {_gq} AS entry_quality, {H(_gs, 1)} AS entry_score,
      CASE WHEN b*(1e0+0.01e0) < 1 THEN b*(1e0+0.01e0) END AS effective FROM (SELECT *, CASE WHEN size/40e0 < 1 THEN size/40e0 ELSE price + price/8e0/2e0 END AS b FROM activity)""")
entry("stake_outcome", "bet_id:i shares:d profit:d lost:d", lambda w: w.bets.withColumns(PR.stake_outcome("stake", "entry_price")), "SELECT bet_id, stake/entry_price AS shares, stake/entry_price - stake AS profit, stake AS lost FROM bets")
entry("quotes", "market_id:i outcome_index:i bid:d ask:d", lambda w: board.market_sides(w.markets).withColumns(PR.quotes("outcome_index", "best_bid", "best_ask")),
      "SELECT market_id, o AS outcome_index, CASE WHEN o=0 THEN best_bid ELSE 1e0-best_ask END AS bid, CASE WHEN o=0 THEN best_ask ELSE 1e0-best_bid END AS ask FROM market, (VALUES (0),(1)) v(o)")
entry("market_sides", "market_id:i outcome_index:i current_price:d token_id:s outcome_label:s", lambda w: board.market_sides(w.markets),
      "SELECT market_id, o AS outcome_index, CASE WHEN o=0 THEN price0 ELSE price1 END AS current_price, 't' || (market_id*10+o) AS token_id, CASE WHEN o=0 THEN 'Yes' ELSE 'No' END AS outcome_label FROM market, (VALUES (0),(1)) v(o)")

# --- as-of --------------------------------------------------------------------------------------
entry("asof_price", "market_id:i outcome_index:i captured_ts:i seq:i p:d", lambda w: asof.asof_last(
    w.snapshots.select("market_id", (F.col("seq") % 2).cast("int").alias("outcome_index"), "captured_ts", "seq"), w.curves.withColumnRenamed("seq", "cs"), KEY, "captured_ts", "t", {"p": "p"}, tie=["cs"]),
      """SELECT q.market_id, q.outcome_index, q.captured_ts, q.seq, max({'t': c.t, 'seq': c.seq, 'p': c.p}).p AS p FROM (SELECT market_id, seq % 2 AS outcome_index, captured_ts, seq FROM snap) q LEFT JOIN curve c
      ON c.market_id=q.market_id AND c.outcome_index=q.outcome_index AND c.t <= q.captured_ts GROUP BY 1,2,3,4""")
entry("latest_snapshot", "market_id:i captured_ts:i liquidity:d", lambda w: asof.latest_before(w.snapshots, ["market_id"], "captured_ts", AS_OF, ["seq"]),
      f"SELECT market_id, r.t AS captured_ts, r.l AS liquidity FROM (SELECT market_id, max({{'t': captured_ts, 'seq': seq, 'l': liquidity}}) AS r FROM snap WHERE captured_ts <= {AS_OF} GROUP BY 1)")

# --- books, tape, overround ---------------------------------------------------------------------
entry("book_summary", "token_id:s best_bid:d best_ask:d spread:d mid:d bid_depth_usd:d ask_depth_usd:d", lambda w: books.book_summary(w.book),
      """SELECT *, best_ask - best_bid AS spread, (best_bid+best_ask)/2e0 AS mid FROM (SELECT token_id, max(price) FILTER (WHERE kind='BID') AS best_bid, min(price) FILTER (WHERE kind='ASK') AS best_ask,
      sum(price*size) FILTER (WHERE kind='BID') AS bid_depth_usd, sum((1e0-price)*size) FILTER (WHERE kind='ASK') AS ask_depth_usd FROM book GROUP BY 1)""")
C["ladder"] = """SELECT token_id, stake, st.f AS filled_usd, st.n AS shares, st.w AS worst_price, st.k AS levels_consumed, best_ask, depth AS total_depth_usd, top AS best_ask_depth_usd FROM (SELECT token_id, stake, min(price) AS best_ask, sum(price*size) AS depth, arg_min(price*size, price) AS top,
 list_reduce(list({'p': price, 's': size} ORDER BY price), lambda acc, x: CASE WHEN stake - acc.f <= 1e-9 THEN acc WHEN x.p*x.s >= stake - acc.f THEN {'f': stake, 'n': acc.n + (stake-acc.f)/x.p, 'w': x.p, 'k': acc.k+1}
  ELSE {'f': acc.f + x.p*x.s, 'n': acc.n + x.s, 'w': x.p, 'k': acc.k+1} END, {'f': 0e0, 'n': 0e0, 'w': 0e0, 'k': 0}) AS st FROM book, (VALUES (1e0),(10e0),(50e0)) v(stake) WHERE kind='ASK' GROUP BY 1,2)"""
entry("ladder_fill", "token_id:s stake:d filled_usd:d unfilled_usd:d shares:d average_price:d worst_price:d slippage_points:d levels_consumed:i best_ask_depth_usd:d total_depth_usd:d", lambda w: books.ladder_fill(w.book),
      "SELECT *, stake - filled_usd AS unfilled_usd, filled_usd/shares AS average_price, (filled_usd/shares - best_ask)*100e0 AS slippage_points FROM ladder")
C["flow"] = f"""SELECT s.market_id, s.outcome_index, h AS hours, count(t.ts) AS fills, coalesce(sum(usd) FILTER (WHERE t.outcome_index = s.outcome_index),0e0) AS for_usd, coalesce(sum(usd) FILTER (WHERE t.outcome_index <> s.outcome_index),0e0) AS against_usd,
 sum(usd) FILTER (WHERE t.outcome_index = s.outcome_index) / sum(size) FILTER (WHERE t.outcome_index = s.outcome_index) AS vwap, max(usd) FILTER (WHERE t.outcome_index = s.outcome_index) AS largest FROM (SELECT DISTINCT market_id, outcome_index FROM tape) s CROSS JOIN (VALUES (1),(6),(24)) v(h)
 LEFT JOIN (SELECT *, size*price AS usd FROM tape WHERE size*price > 0) t ON t.market_id = s.market_id AND t.ts >= {TAPE_AS_OF} - h*3600 GROUP BY 1,2,3"""
entry("tape_flow", "market_id:i outcome_index:i hours:i fills:i for_usd:d against_usd:d net_usd:d for_share:d vwap:d", lambda w: books.tape_flow(w.tape, TAPE_AS_OF), "SELECT *, for_usd - against_usd AS net_usd, CASE WHEN for_usd+against_usd > 0 THEN for_usd/(for_usd+against_usd) END AS for_share FROM flow")
C["reading"] = """SELECT market_id, outcome_index, min(hours) FILTER (WHERE fills >= 3 AND for_usd+against_usd >= 250) AS window_hours, arg_min(for_usd-against_usd, hours) FILTER (WHERE fills >= 3 AND for_usd+against_usd >= 250) AS window_net_usd,
 (max(vwap) FILTER (WHERE hours=1) - max(vwap) FILTER (WHERE hours=24))*100e0 AS pressure_points, max(largest) FILTER (WHERE hours=24) AS largest_for_usd, max(fills) FILTER (WHERE hours=24) < 5 AS too_quiet FROM flow GROUP BY 1,2"""
entry("tape_reading", "market_id:i outcome_index:i window_hours:i window_net_usd:d pressure_points:d largest_for_usd:d too_quiet:b", lambda w: books.tape_reading(books.tape_flow(w.tape, TAPE_AS_OF)), "SELECT * FROM reading")
C["vig"] = """SELECT event_id, CASE WHEN bool_and(neg_risk) THEN 'NEG_RISK' ELSE 'MATCH_RESULT' END AS kind, count(*) AS legs, sum(CASE WHEN no_first THEN p1 ELSE p0 END) AS mid_sum,
 CASE WHEN bool_and(NOT no_first AND best_ask IS NOT NULL AND spread <= 0.1e0) THEN sum(best_ask) END AS ask_sum FROM legs GROUP BY 1 HAVING count(*) >= 2 AND (bool_and(neg_risk) OR (bool_and(moneyline) AND count(*) <= 3))"""
entry("overround", "event_id:i kind:s legs:i mid_sum:d mid_points:d ask_sum:d ask_points:d", lambda w: books.overround(w.legs), "SELECT *, (mid_sum-1e0)*100e0 AS mid_points, (ask_sum-1e0)*100e0 AS ask_points FROM vig")


def findings(w: Workspace):
    reading = books.tape_reading(books.tape_flow(w.tape, TAPE_AS_OF))
    return books.pre_trade_findings(w.board, books.ladder_fill(w.book), books.overround(w.legs), reading)


C["checked"] = """SELECT b.market_id, b.outcome_index, b.effective_price, b.model_mid, b.net_edge_points, one.filled_usd/one.shares AS lv, one.best_ask_depth_usd AS depth, (fifty.filled_usd/fifty.shares - fifty.best_ask)*100e0 AS slip,
 (coalesce(v.ask_sum, v.mid_sum) - 1e0)*100e0 AS vg, r.window_hours, r.window_net_usd FROM board b LEFT JOIN ladder one ON one.token_id = 't' || (b.market_id*10+b.outcome_index) AND one.stake = 1
 LEFT JOIN ladder fifty ON fifty.token_id = one.token_id AND fifty.stake = 50 LEFT JOIN vig v ON v.event_id = b.event_id LEFT JOIN reading r ON r.market_id=b.market_id AND r.outcome_index=b.outcome_index"""
_found = [("no-book", "STOP", "lv IS NULL"), ("price-moved", "WARNING", "(lv - effective_price)*100e0 >= 1"), ("price-moved", "GOOD", "(lv - effective_price)*100e0 <= -1"), ("edge-gone", "STOP", "(model_mid-lv)*100e0 <= 0"),
          ("edge-shrunk", "WARNING", "(model_mid-lv)*100e0 > 0 AND (model_mid-lv)*100e0 < net_edge_points - 0.5e0"), ("thin-top", "WARNING", "depth < 25"), ("depth-ok", "GOOD", "depth >= 25"), ("shallow-book", "WARNING", "slip > 2"),
          ("vig-exceeds-edge", "STOP", "vg > 0 AND vg >= net_edge_points"), ("vig", "NEUTRAL", "vg > 0 AND (net_edge_points IS NULL OR vg < net_edge_points)"), ("underround", "GOOD", "vg <= 0"), ("quiet-tape", "NEUTRAL", "window_hours IS NULL"),
          ("flow-with", "GOOD", "window_net_usd > 0"), ("flow-against", "WARNING", "window_net_usd <= 0")]
entry("pre_trade_findings", "market_id:i outcome_index:i live_edge_points:d finding:s tone:s", findings, " UNION ALL ".join(f"SELECT market_id, outcome_index, (model_mid-lv)*100e0 AS live_edge_points, '{f}' AS finding, '{t}' AS tone FROM checked WHERE {c}" for f, t, c in _found))

# --- bets ---------------------------------------------------------------------------------------
entry("close_bets", "bet_id:i closing_price:d clv_points:d clv_source:s", lambda w: w.measured_bets, "SELECT * FROM clv")
def partly_settled(w: Workspace):
    """Bets of which every fifth was settled by an earlier pass."""
    return w.bets.withColumn("won", F.when(F.col("bet_id") % 5 == 0, F.col("bet_id") % 2 == 0))


entry("settle_manual", "bet_id:i won:b pnl:d", lambda w: bets.settle_manual(partly_settled(w), w.markets), "SELECT bet_id, outcome_index = winner AS won, CASE WHEN outcome_index = winner THEN stake/entry_price - stake ELSE -stake END AS pnl FROM bets JOIN market USING (market_id) WHERE source='MANUAL' AND bet_id % 5 <> 0 AND resolved AND winner IS NOT NULL")


def one_wallet(w: Workspace):
    return w.closed.groupBy("asset").agg(F.first("won", ignorenulls=True).alias("won"), F.sum("realized_pnl").alias("realized_pnl"))


C["settled_asset"] = "SELECT asset, any_value(won) FILTER (WHERE won IS NOT NULL) AS won, sum(realized_pnl) AS realized_pnl FROM closed GROUP BY 1"
C["imported"] = "SELECT b.bet_id, b.stake, s.won, s.realized_pnl * (b.stake/sum(b.stake) OVER (PARTITION BY asset)) AS pnl FROM bets b JOIN settled_asset s USING (asset) WHERE b.source='WALLET' AND b.bet_id % 5 <> 0 AND s.won IS NOT NULL"
entry("settle_imported", "bet_id:i won:b pnl:d", lambda w: bets.settle_imported(partly_settled(w), one_wallet(w)), "SELECT * FROM imported")
entry("logged_positions", "market_id:i outcome_index:i bets:i total_stake:d average_price:d", lambda w: bets.logged_positions(w.bets), "SELECT market_id, outcome_index, count(*) AS bets, sum(stake) AS total_stake, sum(stake*entry_price)/sum(stake) AS average_price FROM bets GROUP BY 1,2")
entry("logged_on_board", "market_id:i outcome_index:i bets:i total_stake:d", lambda w: bets.logged_on_board(w.bets, w.board), "SELECT b.market_id, b.outcome_index, count(x.bet_id) AS bets, coalesce(sum(stake),0e0) AS total_stake FROM board b LEFT JOIN bets x ON x.market_id=b.market_id AND x.outcome_index=b.outcome_index GROUP BY 1,2")
entry("bet_totals", "bets:i staked:d settled:i wins:i pnl:d", lambda w: bets.bet_totals(bets.settle_imported(partly_settled(w), one_wallet(w))), "SELECT count(*) AS bets, sum(stake) AS staked, count(won) AS settled, count(*) FILTER (WHERE won) AS wins, sum(pnl) AS pnl FROM imported")


def decided(w: Workspace):
    won = w.markets.where(F.col("winner").isNotNull()).select("market_id", "winner")
    return w.measured_bets.join(won, "market_id", "left").withColumn("won", F.col("outcome_index") == F.col("winner"))


def _slice_sql(label: str, names: list[str] | None) -> str:
    inner = f"SELECT {label} AS label, clv_points, winner IS NOT NULL AND outcome_index = winner AS w, winner IS NOT NULL AND outcome_index <> winner AS l FROM clv LEFT JOIN (SELECT market_id, winner FROM market) USING (market_id)"
    agg = f"SELECT label, count(*) AS bets, count(clv_points) AS measured, CASE WHEN count(clv_points) >= 8 THEN avg(clv_points) END AS mean_clv, count(*) FILTER (WHERE w) AS wins, count(*) FILTER (WHERE l) AS losses FROM ({inner}) WHERE label IS NOT NULL GROUP BY 1"
    if names is None:
        return agg
    return f"SELECT n.label, coalesce(bets,0) AS bets, coalesce(measured,0) AS measured, mean_clv, coalesce(wins,0) AS wins, coalesce(losses,0) AS losses FROM (VALUES {','.join(f'({chr(39)}{x}{chr(39)})' for x in names)}) n(label) LEFT JOIN ({agg}) USING (label)"


SL = "label:s bets:i measured:i mean_clv:d wins:i losses:i"
entry("slice_by_price", SL, lambda w: bets.slice_by_price(decided(w)), _slice_sql("CASE WHEN entry_price < 0.2e0 THEN 'Under 20c' WHEN entry_price < 0.4e0 THEN '20-40c' WHEN entry_price < 0.6e0 THEN '40-60c' WHEN entry_price < 0.8e0 THEN '60-80c' ELSE '80c and up' END", [b[0] for b in V.PRICE_SLICES]))
entry("slice_by_score", SL, lambda w: bets.slice_by_score(decided(w)), _slice_sql("CASE WHEN horizon_score < 40 THEN 'Under 40' WHEN horizon_score < 60 THEN '40-60' WHEN horizon_score < 80 THEN '60-80' WHEN horizon_score >= 80 THEN '80+' END", [b[0] for b in V.SCORE_SLICES]))
entry("slice_by_category", SL, lambda w: bets.slice_by_category(decided(w)), _slice_sql("category", None))
C["clvsum"] = "SELECT count(clv_points) AS n, avg(clv_points) AS mu, stddev_samp(clv_points) AS sd, count(*) FILTER (WHERE clv_points > 0) AS up FROM clv"
_verdict = "CASE WHEN n < 5 THEN 'TOO_FEW' WHEN mu - 1.96e0*sd/sqrt(n) > 0 THEN 'BEATING_THE_CLOSE' WHEN mu + 1.96e0*sd/sqrt(n) < 0 THEN 'PAYING_UP' ELSE 'INCONCLUSIVE' END"
entry("clv_summary", "count:i mean_points:d stddev_points:d standard_error:d interval_low:d interval_high:d positive_rate:d verdict:s bets_needed:i", lambda w: bets.clv_summary(w.measured_bets),
      f"SELECT n AS count, mu AS mean_points, sd AS stddev_points, sd/sqrt(n) AS standard_error, mu - 1.96e0*sd/sqrt(n) AS interval_low, mu + 1.96e0*sd/sqrt(n) AS interval_high, up/n AS positive_rate, {_verdict} AS verdict, CASE WHEN ceil(pow(1.96e0*sd/abs(mu),2)) <= 5000 THEN ceil(pow(1.96e0*sd/abs(mu),2)) END AS bets_needed FROM clvsum")
entry("score_vs_clv", "n:i correlation:d low:d high:d verdict:s", lambda w: bets.score_vs_clv(w.measured_bets),
      """SELECT n, r AS correlation, lo AS low, hi AS high, CASE WHEN lo > 0 THEN 'POSITIVE' WHEN hi < 0 THEN 'NEGATIVE' ELSE 'NO_RELATION' END AS verdict FROM (SELECT n, r, tanh(atanh(r) - 1.96e0/sqrt(n-3)) AS lo, tanh(atanh(r) + 1.96e0/sqrt(n-3)) AS hi
      FROM (SELECT count(*) AS n, corr(horizon_score, clv_points) AS r FROM clv WHERE horizon_score IS NOT NULL AND clv_points IS NOT NULL))""")


def requests(w: Workspace):
    return w.board.select(*KEY).withColumn("stake", F.element_at(F.array(F.lit(1.0), F.lit(10.0), F.lit(50.0)), (F.col("market_id") % 3 + 1).cast("int")))


entry("record_bets", "market_id:i outcome_index:i stake:d entry_price:d closes_ts:i clv_source:s", lambda w: bets.record_bets(requests(w), w.board, books.ladder_fill(w.book)),
      """SELECT *, CASE WHEN lv IS NULL THEN 'ENTRY_FROM_SNAPSHOT' END AS clv_source FROM (SELECT b.market_id, b.outcome_index, q.stake, l.filled_usd/l.shares AS lv, coalesce(l.filled_usd/l.shares, b.effective_price, b.current_price) AS entry_price, coalesce(kickoff_ts, end_ts) AS closes_ts
      FROM board b JOIN (SELECT market_id AS qm, outcome_index AS qo, [1e0,10e0,50e0][market_id % 3 + 1] AS stake FROM board) q ON qm=b.market_id AND qo=b.outcome_index LEFT JOIN ladder l ON l.token_id='t' || (b.market_id*10+b.outcome_index) AND l.stake=q.stake) WHERE entry_price > 0 AND entry_price < 1""")
entry("import_bets", "external_id:s market_id:i outcome_index:i entry_price:d stake:d closes_ts:i horizon_score:d", lambda w: bets.import_bets(w.activity, w.markets, w.board, w.activity.where("market_id % 3 = 0").select(F.col("dedupe_key").alias("external_id"))),
      "SELECT a.dedupe_key AS external_id, a.market_id, a.outcome_index, a.price AS entry_price, a.usd AS stake, coalesce(m.kickoff_ts, m.end_ts) AS closes_ts, b.hor_score AS horizon_score FROM activity a JOIN market m USING (market_id) LEFT JOIN (SELECT market_id, outcome_index, hor_score FROM board) b USING (market_id, outcome_index) WHERE a.side='BUY' AND a.market_id % 3 <> 0")

# --- events and alerts --------------------------------------------------------------------------
def before(w: Workspace):
    k = F.col("market_id") * 7 + F.col("trader_id") * 3
    old = w.positions.where(k % 11 != 0).withColumns({"size": F.col("size") * (1.0 + (k % 7 - 3) / F.lit(8.0)), "current_value": F.col("current_value") * (1.0 + (k % 7 - 3) / F.lit(8.0))})
    gone = w.positions.where(k % 13 == 0).withColumn("asset", F.concat("asset", F.lit("x")))
    return old.unionByName(gone)


C["was"] = """SELECT trader_id, market_id, outcome_index, asset, size*(1e0+((market_id*7+trader_id*3) % 7 - 3)/8e0) AS size, current_value*(1e0+((market_id*7+trader_id*3) % 7 - 3)/8e0) AS current_value FROM open_p WHERE (market_id*7+trader_id*3) % 11 <> 0
 UNION ALL SELECT trader_id, market_id, outcome_index, asset || 'x', size, current_value FROM open_p WHERE (market_id*7+trader_id*3) % 13 = 0"""
EVENT_CFG = {"feed": {"min_usd": 20.0}}
C["moves"] = f"""SELECT coalesce(n.trader_id, o.trader_id) AS trader_id, coalesce(n.asset, o.asset) AS asset, coalesce(n.market_id,o.market_id) AS market_id, coalesce(n.outcome_index,o.outcome_index) AS outcome_index, n.asset IS NULL AS gone, o.asset IS NULL AS fresh, n.current_value AS nv, o.current_value AS ov,
 (n.size-o.size)/o.size AS change, abs(n.current_value-o.current_value) AS moved FROM was o FULL JOIN open_p n ON n.trader_id=o.trader_id AND n.asset=o.asset"""
C["pevents"] = """SELECT *, CASE WHEN gone AND ov >= 20 THEN 'POSITION_CLOSED' WHEN fresh AND nv >= 20 THEN 'POSITION_OPENED' WHEN NOT gone AND NOT fresh AND abs(change) >= 0.15e0 AND moved >= 20 THEN CASE WHEN change > 0 THEN 'POSITION_INCREASED' ELSE 'POSITION_REDUCED' END END AS type FROM moves"""
entry("position_events", "type:s dedupe_key:s trader_id:i market_id:i outcome_index:i magnitude_usd:d importance:i", lambda w: events.position_events(before(w), w.positions, w.markets, AS_OF, EVENT_CFG),
      f"""SELECT type, CASE type WHEN 'POSITION_OPENED' THEN 'open' WHEN 'POSITION_CLOSED' THEN 'close' WHEN 'POSITION_INCREASED' THEN 'inc' ELSE 'dec' END || ':' || trader_id || ':' || asset || CASE WHEN type='POSITION_OPENED' THEN '' ELSE ':' || {day(str(AS_OF))} END AS dedupe_key, trader_id, market_id, outcome_index,
      CASE type WHEN 'POSITION_OPENED' THEN nv WHEN 'POSITION_CLOSED' THEN ov ELSE moved END AS magnitude_usd, CASE WHEN type='POSITION_CLOSED' THEN 2 ELSE 1 END AS importance FROM pevents WHERE type IS NOT NULL""")


def earlier(w: Workspace):
    return w.consensus.select(*KEY, (F.col("consensus") + (F.col("market_id") % 5) * 8.0 - 16.0).alias("consensus"))


entry("side_events", "market_id:i outcome_index:i type:s dedupe_key:s importance:i", lambda w: events.side_events(w.board, earlier(w), events.recent_entrants(w.holders, AS_OF + 0), AS_OF),
      f"""SELECT market_id, outcome_index, 'CONSENSUS_SHIFT' AS type, 'consensus:' || market_id || ':' || outcome_index || ':2001-08-01T00' AS dedupe_key, 2 AS importance FROM board WHERE abs((market_id % 5)*8e0 - 16e0) >= 15
      UNION ALL SELECT market_id, outcome_index, 'PRICE_CROSSED_ELITE_ENTRY', 'crossed:' || market_id || ':' || outcome_index || ':2001-08-01', 2 FROM board WHERE current_price - weighted_entry_price >= 0.1e0
      UNION ALL SELECT b.market_id, b.outcome_index, 'CLUSTER_ENTRY', 'cluster:' || b.market_id || ':' || b.outcome_index || ':2001-08-01', 3 FROM board b JOIN (SELECT market_id, outcome_index, count(*) AS n FROM holders WHERE opened_ts >= {AS_OF} - 86400 GROUP BY 1,2) e USING (market_id, outcome_index) WHERE n >= 3""")
entry("resolved_events", "market_id:i dedupe_key:s magnitude_usd:d", lambda w: events.resolved_events(w.markets, w.markets.where("resolved and market_id % 4 = 0"), w.positions.withColumn("market_id", F.col("market_id") - 1)),
      "SELECT m.market_id, 'resolved:' || m.market_id AS dedupe_key, coalesce(sum(p.current_value),0e0) AS magnitude_usd FROM market m LEFT JOIN open_p p ON p.market_id - 1 = m.market_id WHERE m.resolved AND m.market_id % 4 <> 0 GROUP BY 1")
ALERT_CFG = {"alerts": {"max_hours": 700.0, "min_win": 0.2, "min_edge_points": 0.5, "min_score": 20.0, "min_liquidity": 500.0, "kickoff_hours": 500.0}}
C["opp_alert"] = f"""SELECT CASE WHEN kickoff_ts > {AS_OF} AND kickoff_ts - {AS_OF} <= 1800000 THEN 'KICKOFF_SOON' ELSE 'OPPORTUNITY' END AS kind, CASE WHEN kickoff_ts > {AS_OF} AND kickoff_ts - {AS_OF} <= 1800000 THEN 'kickoff:' ELSE 'opp:' END || market_id || '-' || outcome_index || ':2001-08-01' AS dedupe_key
 FROM board WHERE settles_ts > {AS_OF} AND settles_ts - {AS_OF} <= 2520000 AND net_edge_points >= 0.5e0 AND model_mid >= 0.2e0 AND hor_score >= 20 AND qualified_count >= 2 AND liquidity >= 500 AND effective_price > 0"""
entry("opportunity_alerts", "kind:s dedupe_key:s", lambda w: events.opportunity_alerts(w.board, AS_OF, ALERT_CFG), "SELECT * FROM opp_alert")
C["set_alert"] = f"SELECT 'BET_SETTLED' AS kind, 'settled:' || bet_id AS dedupe_key FROM (SELECT b.bet_id FROM bets b JOIN imported i USING (bet_id) WHERE b.placed_ts >= {AS_OF} - 2592000)"
entry("settlement_alerts", "kind:s dedupe_key:s", lambda w: events.settlement_alerts(bets.settle_imported(partly_settled(w), one_wallet(w)), AS_OF), "SELECT * FROM set_alert")
entry("freshness", "last_ts:i age_hours:d stale:b", lambda w: events.freshness(w.markets, "last_synced_ts", AS_OF), f"SELECT max(last_synced_ts) AS last_ts, ({AS_OF} - max(last_synced_ts))/3600e0 AS age_hours, ({AS_OF} - max(last_synced_ts))/3600e0 >= 3 AS stale FROM market")


def all_alerts(w: Workspace):
    settled = bets.settle_imported(partly_settled(w), one_wallet(w))
    old = events.freshness(w.snapshots.where(F.col("captured_ts") <= AS_OF - 40000), "captured_ts", AS_OF)
    kinds = [events.opportunity_alerts(w.board, AS_OF, ALERT_CFG), events.settlement_alerts(settled, AS_OF), events.clv_alert(bets.clv_summary(w.measured_bets)), events.stale_alert(old, AS_OF)]
    raised = w.bets.where("bet_id % 4 = 0").select(F.concat_ws(":", F.lit("settled"), "bet_id").alias("dedupe_key"))
    return events.new_alerts(kinds, raised)


entry("new_alerts", "kind:s dedupe_key:s", all_alerts, f"""SELECT * FROM (SELECT * FROM opp_alert UNION ALL SELECT * FROM set_alert UNION ALL SELECT 'CLV_VERDICT', 'clv:' || {_verdict} FROM clvsum WHERE {_verdict} IN ('BEATING_THE_CLOSE','PAYING_UP')
 UNION ALL SELECT 'SYNC_STALE', 'stale:2001-08-01T00') WHERE dedupe_key NOT IN (SELECT 'settled:' || bet_id FROM bets WHERE bet_id % 4 = 0)""")
entry("feed", "dedupe_key:s display_name:s question:s", lambda w: events.feed(events.position_events(before(w), w.positions, w.markets, AS_OF, EVENT_CFG).withColumn("ts", F.lit(AS_OF) - F.col("trader_id")), w.traders, w.markets),
      f"""SELECT e.dedupe_key, t.display_name, m.question FROM (SELECT *, CASE type WHEN 'POSITION_OPENED' THEN 'open' WHEN 'POSITION_CLOSED' THEN 'close' WHEN 'POSITION_INCREASED' THEN 'inc' ELSE 'dec' END || ':' || trader_id || ':' || asset || CASE WHEN type='POSITION_OPENED' THEN '' ELSE ':' || {day(str(AS_OF))} END AS dedupe_key
      FROM pevents WHERE type IS NOT NULL ORDER BY trader_id, dedupe_key LIMIT 120) e LEFT JOIN trader t USING (trader_id) LEFT JOIN market m USING (market_id)""")

# --- watchlist and retention --------------------------------------------------------------------
def public_holders(w: Workspace):
    return w.tape.select("market_id", "wallet", F.col("size").alias("shares"), F.when(F.col("ts") % 3 == 0, F.concat(F.lit("n"), F.col("wallet"))).alias("name"))


C["found_h"] = """SELECT wallet, market_id, category, sum(size) AS shares, max('n' || wallet) FILTER (WHERE ts % 3 = 0) AS name FROM (SELECT wallet, size, ts, market_id FROM tape WHERE size >= 100 AND wallet NOT IN (SELECT wallet FROM trader)) t
 JOIN (SELECT market_id, category FROM market WHERE volume > 0) m USING (market_id) GROUP BY 1,2,3"""
C["found_c"] = "SELECT wallet, category, count(*) AS n, rank() OVER (PARTITION BY wallet ORDER BY count(*) DESC) AS r FROM found_h GROUP BY 1,2"
entry("discover_holders", "wallet:s display_name:s specialty:s markets:i shares:d", lambda w: watchlist.discover_holders(w.markets, public_holders(w), w.traders),
      """SELECT h.wallet, coalesce(max(name), substr(h.wallet,1,6) || '...' || right(h.wallet,4)) AS display_name, any_value(c.specialty) AS specialty, count(*) AS markets, sum(shares) AS shares FROM found_h h
      JOIN (SELECT wallet, CASE WHEN count(*) > 1 THEN 'UNKNOWN' ELSE any_value(category) END AS specialty FROM found_c WHERE r = 1 GROUP BY 1) c ON c.wallet=h.wallet GROUP BY 1 HAVING count(*) >= 2""")
entry("discover_tape", "wallet:s markets:i notional:d", lambda w: watchlist.discover_tape(w.tape, w.traders),
      "SELECT wallet, count(DISTINCT market_id) AS markets, sum(size*price) AS notional FROM tape WHERE size*price >= 50 AND wallet NOT IN (SELECT wallet FROM trader) GROUP BY 1 HAVING count(DISTINCT market_id) >= 2")
entry("leaderboard_new", "wallet:s", lambda w: watchlist.new_leaderboard_wallets(w.tape.select("wallet"), w.traders), "SELECT DISTINCT wallet FROM tape WHERE wallet NOT IN (SELECT wallet FROM trader)")
C["tiered"] = f"""SELECT *, CASE WHEN last_synced_ts IS NULL THEN 'NEW' WHEN last_activity_ts IS NULL OR {AS_OF}-last_activity_ts > 7776000 THEN 'DORMANT' WHEN has_sync_error THEN 'COLD' WHEN coalesce(stored_score,0) >= 60 AND {AS_OF}-last_activity_ts <= 172800 THEN 'HOT'
 WHEN {AS_OF}-last_activity_ts <= 1209600 OR coalesce(stored_score,0) >= 45 THEN 'WARM' ELSE 'COLD' END AS tier FROM trader"""
C["duelist"] = f"""SELECT *, last_synced_ts IS NULL OR {AS_OF}-last_synced_ts >= 3600*(CASE tier WHEN 'HOT' THEN 2 WHEN 'WARM' THEN 8 WHEN 'COLD' THEN 24 ELSE 96 END) AS due, CASE tier WHEN 'NEW' THEN 0 WHEN 'HOT' THEN 1 WHEN 'WARM' THEN 2 WHEN 'COLD' THEN 3 ELSE 4 END AS priority FROM tiered"""
C["chosen"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier='NEW' ORDER BY priority, coalesce(last_synced_ts,0), trader_id) AS rn, count(*) FILTER (WHERE tier='NEW') OVER () AS nf, count(*) FILTER (WHERE tier<>'NEW') OVER () AS nk FROM duelist WHERE due)
 WHERE rn <= CASE WHEN tier='NEW' THEN least(nf, 30 - least(nk, 30 - least(nf, 8))) ELSE least(nk, 30 - least(nf, 8)) END"""
_cand = lambda w: watchlist.refresh_candidates(w.traders.withColumnRenamed("stored_score", "smart_score"), 30, AS_OF)
entry("refresh_candidates", "trader_id:i tier:s closed_depth:i fill_depth:i", lambda w: _cand(w)[0], "SELECT trader_id, tier, CASE tier WHEN 'NEW' THEN 1000 WHEN 'HOT' THEN 300 WHEN 'WARM' THEN 150 ELSE 100 END AS closed_depth, CASE tier WHEN 'NEW' THEN 3000 WHEN 'HOT' THEN 1000 WHEN 'WARM' THEN 600 ELSE 300 END AS fill_depth FROM chosen")
entry("refresh_counts", "selected:i deferred:i not_due:i", lambda w: _cand(w)[1], "SELECT (SELECT count(*) FROM chosen) AS selected, count(*) FILTER (WHERE due) - (SELECT count(*) FROM chosen) AS deferred, count(*) FILTER (WHERE NOT due) AS not_due FROM duelist")
entry("cap_watchlist", "trader_id:i", lambda w: watchlist.cap_watchlist(w.traders, w.traders.select("trader_id", F.col("stored_score").alias("smart_score")), 60), "SELECT trader_id FROM trader WHERE source='MANUAL' OR trader_id IN (SELECT trader_id FROM trader WHERE source<>'MANUAL' ORDER BY stored_score DESC NULLS LAST, last_activity_ts DESC NULLS LAST, trader_id LIMIT 60)")
entry("keep_recent", "dedupe_key:s", lambda w: watchlist.keep_recent(w.activity, "ts", 365, AS_OF), f"SELECT dedupe_key FROM activity WHERE ts >= {AS_OF} - 365*86400")
entry("keep_markets", "market_id:i", lambda w: watchlist.keep_markets(w.markets, w.positions, w.closed, w.bets, 300, AS_OF),
      f"SELECT market_id FROM market WHERE NOT coalesce(resolved AND resolved_ts < {AS_OF} - 300*86400 AND market_id NOT IN (SELECT market_id FROM open_p) AND market_id NOT IN (SELECT market_id FROM closed) AND market_id NOT IN (SELECT market_id FROM bets), false)")
entry("stale_markets", "market_id:i", lambda w: watchlist.stale_markets(w.markets, w.positions, AS_OF), f"SELECT market_id FROM market WHERE NOT resolved AND (last_synced_ts IS NULL OR last_synced_ts < {AS_OF}-3600) AND market_id IN (SELECT market_id FROM open_p)")
_orph = lambda w: w.activity.select("dedupe_key", F.concat(F.lit("c"), F.col("market_id") * (1 + F.col("trader_id") % 2)).alias("condition_id"), F.when(F.col("trader_id") % 3 == 0, F.col("market_id")).alias("market_id"))
C["orphan"] = "SELECT a.dedupe_key, 'c' || (a.market_id*(1 + a.trader_id % 2)) AS condition_id, CASE WHEN a.trader_id % 3 = 0 THEN a.market_id END AS market_id FROM activity a"
entry("relink", "dedupe_key:s market_id:i", lambda w: watchlist.relink(_orph(w), w.markets), "SELECT o.dedupe_key, coalesce(o.market_id, m.market_id) AS market_id FROM orphan o LEFT JOIN market m USING (condition_id)")
entry("unknown_conditions", "still_unknown:i", lambda w: watchlist.unknown_conditions(watchlist.relink(_orph(w), w.markets)), "SELECT count(DISTINCT condition_id) AS still_unknown FROM orphan WHERE market_id IS NULL AND condition_id NOT IN (SELECT condition_id FROM market)")
_stamped = lambda w: w.markets.withColumns({"resolved_ts": F.when(F.col("market_id") % 7 == 0, F.lit(AS_OF + 9)).otherwise(F.col("resolved_ts")), "end_ts": F.when(F.col("market_id") % 9 == 0, F.lit(AS_OF + 9)).otherwise(F.col("end_ts"))})
entry("repair_resolved_at", "market_id:i resolved_ts:i", lambda w: watchlist.repair_resolved_at(_stamped(w), w.closed, AS_OF),
      f"""SELECT m.market_id, CASE WHEN resolved AND (rt IS NULL OR rt > {AS_OF} OR et > {AS_OF}) THEN CASE WHEN f.first <= {AS_OF} THEN f.first END ELSE rt END AS resolved_ts FROM (SELECT *, CASE WHEN market_id % 7 = 0 THEN {AS_OF}+9 ELSE resolved_ts END AS rt, CASE WHEN market_id % 9 = 0 THEN {AS_OF}+9 ELSE end_ts END AS et FROM market) m
      LEFT JOIN (SELECT market_id, min(resolved_ts) AS first FROM closed WHERE won IS NOT NULL AND resolved_ts IS NOT NULL GROUP BY 1) f USING (market_id)""")
entry("price_backfill", "market_id:i outcome_index:i token_id:s", lambda w: watchlist.price_backfill(w.universe, w.curves.groupBy("market_id", "outcome_index").agg(F.max("t").alias("fetched_ts")).select(F.concat(F.lit("t"), F.col("market_id") * 10 + F.col("outcome_index")).alias("token_id"), "fetched_ts"), 990000000),
      "SELECT u.market_id, o AS outcome_index, 't' || (u.market_id*10+o) AS token_id FROM universe u, (VALUES (0),(1)) v(o) WHERE NOT EXISTS (SELECT 1 FROM curve c WHERE c.market_id=u.market_id AND c.outcome_index=o AND c.t > 990000000)")
entry("curve_summary", "market_id:i outcome_index:i points:i first_t:i last_t:i", lambda w: watchlist.curve_summary(w.curves, KEY), "SELECT market_id, outcome_index, count(*) AS points, min(t) AS first_t, max(t) AS last_t FROM curve GROUP BY 1,2")


def plans(w: Workspace):
    asked = w.traders.select(F.col("trader_id").alias("plan_id"), (F.col("trader_id") % 40 + 3.0).alias("bankroll"), F.when(F.col("trader_id") % 2 == 0, "EQUAL").otherwise("SCORE_WEIGHTED").alias("method"),
                             (F.col("trader_id") % 6 + 1).alias("max_positions"), F.lit(1.0).alias("min_ticket"), F.lit(0.4).alias("max_share"))
    offered = w.activity.where("side = 'BUY'").select(F.col("trader_id").alias("plan_id"), F.col("dedupe_key").alias("candidate_id"), "price", (F.col("size") * 2.0).alias("score"))
    return allocation.allocation_plans(asked, offered)


C["asked_plan"] = """SELECT trader_id AS plan_id, trader_id % 40 + 3e0 AS bankroll, trader_id % 2 = 0 AS equal, trader_id % 6 + 1 AS max_positions FROM trader"""
C["plan_line"] = """SELECT * FROM (SELECT p.*, a.dedupe_key AS candidate_id, a.price, a.size*2e0 AS score, row_number() OVER (PARTITION BY plan_id ORDER BY a.size*2e0 DESC, a.dedupe_key) AS i
 FROM asked_plan p JOIN activity a ON a.trader_id = p.plan_id WHERE a.side = 'BUY' AND a.price > 0 AND a.price < 1) WHERE i <= least(max_positions, floor(bankroll))"""
# Weights as lists per plan: the limit is found by trying every number of held-back lines, the funded lines by trying every length.
C["plan_list"] = """SELECT plan_id, bankroll, count(*) AS n, list(candidate_id ORDER BY i) AS ids, list(price ORDER BY i) AS prices,
 CASE WHEN any_value(equal) THEN list(1e0/n0 ORDER BY i) ELSE list(score/total ORDER BY i) END AS w, greatest(0.4e0, 1e0/count(*)) AS cap
 FROM (SELECT *, count(*) OVER (PARTITION BY plan_id) AS n0, sum(score) OVER (PARTITION BY plan_id) AS total FROM plan_line) GROUP BY 1,2"""
C["plan_cut"] = """SELECT *, list_filter(range(0, n), lambda k: (1e0 - k*cap) / list_sum(w[k+1:]) * w[k+1] <= cap + 1e-9)[1] AS k FROM plan_list"""
C["plan_share"] = """SELECT *, list_transform(range(1, n+1), lambda j: CASE WHEN j <= k THEN cap ELSE (1e0 - k*cap) / list_sum(w[k+1:]) * w[j] END) AS s FROM plan_cut"""
C["plan_row"] = """SELECT plan_id, bankroll, ids[j] AS candidate_id, prices[j] AS price, s[j] AS share, j,
 row_number() OVER (PARTITION BY plan_id ORDER BY s[j] DESC, j DESC) AS place FROM (SELECT *, unnest(range(1, n+1)) AS j FROM plan_share)"""
C["plan_kept"] = """SELECT r.* FROM plan_row r JOIN (SELECT plan_id, max(place) AS m FROM (SELECT a.plan_id, a.place, a.bankroll*a.share/sum(b.share) AS stake FROM plan_row a JOIN plan_row b ON a.plan_id=b.plan_id AND b.place <= a.place
 GROUP BY a.plan_id, a.place, a.bankroll, a.share) WHERE stake >= 1e0 - 1e-9 OR place = 1 GROUP BY 1) USING (plan_id) WHERE place <= m"""
_c2 = "(floor(({0} + 2.220446049250313e-16)*100e0 + 0.5e0)/100e0)"
C["plan_stake"] = f"""SELECT *, {_c2.format('bankroll - sum(st) OVER (PARTITION BY plan_id)')} AS drift, row_number() OVER (PARTITION BY plan_id ORDER BY st DESC, j) AS f
 FROM (SELECT *, {_c2.format('(bankroll*share/sum(share) OVER (PARTITION BY plan_id))')} AS st FROM plan_kept)"""
C["plan_done"] = f"SELECT *, CASE WHEN f = 1 AND abs(drift) >= 0.01e0 AND {_c2.format('(st + drift)')} >= 1 THEN {_c2.format('(st + drift)')} ELSE st END AS stake_usd FROM plan_stake"
entry("allocation_plans", "plan_id:i candidate_id:s price:d stake_usd:d shares:d profit_if_wins:d pct_of_bankroll:d chance_all_win:d chance_any_wins:d", plans,
      f"""SELECT plan_id, candidate_id, price, stake_usd, {_c2.format('stake_usd/price')} AS shares, {_c2.format('(stake_usd/price - stake_usd)')} AS profit_if_wins, {_c2.format('(stake_usd/bankroll*100e0)')} AS pct_of_bankroll,
      product(price) OVER (PARTITION BY plan_id) AS chance_all_win, 1e0 - product(1e0 - price) OVER (PARTITION BY plan_id) AS chance_any_wins FROM plan_done""")
entry("allocation_totals", "plan_id:i staked:d", lambda w: plans(w).groupBy("plan_id").agg(F.sum("stake_usd").alias("staked")), "SELECT t.trader_id AS plan_id, t.trader_id % 40 + 3e0 AS staked FROM trader t WHERE trader_id IN (SELECT trader_id FROM activity WHERE side='BUY')")
