"""DuckDB SQL for the registered queries: shared tables as CTEs, written from the definitions.

The SQL takes the direct route wherever the Spark operators take a scalable one (pairwise joins,
list folds, row numbers over whole partitions), so that the two check each other.
"""

from __future__ import annotations

import re

AS_OF = 996624000
TAPE_AS_OF = 1706659200


def H(x: str, digits: int = 0) -> str:
    s = f"{10 ** digits}e0"
    return f"(floor(({x})*{s}+0.5e0)/{s})"


def clip(x: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, ({x}))) END)"


def S(x: str, lo: float, hi: float) -> str:
    return clip(f"(({x}) - ({lo}e0)) / {hi - lo}e0 * 100e0", "0e0", "100e0")


def price(seed: str) -> str:
    return f"((({seed}) % 125 + 2) / 128e0)"


def pick(values: list[str], index: str) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + f"][(({index}) % {len(values)}) + 1]"


def month(sec: str) -> str:
    return f"strftime(make_timestamp(({sec})::BIGINT*1000000), '%Y-%m')"


def day(sec: str) -> str:
    return f"strftime(make_timestamp(({sec})::BIGINT*1000000), '%Y-%m-%d')"


def wilson(k: str, n: str) -> tuple[str, str]:
    z = "1.959964e0"
    p = f"(({k})::DOUBLE/({n}))"
    d = f"(1e0 + {z}*{z}/({n}))"
    c = f"(({p} + {z}*{z}/(2e0*({n})))/{d})"
    h = f"({z}*sqrt({p}*(1e0-{p})/({n}) + {z}*{z}/(4e0*({n})*({n})))/{d})"
    ok = f"({n}) > 0"
    return (f"CASE WHEN {ok} THEN greatest(0e0, {c}-{h}) END",
            f"CASE WHEN {ok} THEN least(1e0, {c}+{h}) END")


def liq(x: str, lo: float, hi: float) -> str:
    v = f"log10(greatest({x}, 1e0))"
    a, b = f"log10({float(lo)}e0)", f"log10({float(hi)}e0)"
    return (f"(CASE WHEN {x} <= 0 THEN 0e0 WHEN {x} IS NOT NULL THEN "
            + clip(f"({v} - {a}) / ({b} - {a}) * 100e0", "0e0", "100e0") + " END)")


def score(name: str, src: str, comps: dict[str, tuple[float, str]], pens: dict[str, str]) -> dict[str, str]:
    """CTEs computing a weighted score over ``src``; the last is called ``name``."""
    vals = ", ".join(clip(v, "0e0", "100e0") + f" AS v_{k}" for k, (_, v) in comps.items())
    points = ", ".join(f"coalesce(({p})::DOUBLE, 0e0) AS p_{k}" for k, p in pens.items())
    avail = " + ".join(f"(CASE WHEN v_{k} IS NOT NULL THEN {float(w)}e0 ELSE 0e0 END)" for k, (w, _) in comps.items())
    contrib = " + ".join(
        "(CASE WHEN v_%s IS NOT NULL THEN %s ELSE 0e0 END)" % (k, H(f"v_{k} * ({float(w)}e0 / av * 100e0) / 100e0", 1))
        for k, (w, _) in comps.items())
    taken = " + ".join(f"p_{k}" for k in pens)
    shown = ", ".join(f"{H('v_' + k, 1)} AS {name}_{k}" for k in comps)
    return {
        f"{name}_1": f"SELECT *, {vals}, {points} FROM {src}",
        f"{name}_2": f"SELECT *, {avail} AS av, 0e0 + {taken} AS taken FROM {name}_1",
        f"{name}_3": f"SELECT *, {H(clip(contrib, '0e0', '100e0'), 1)} AS {name}_base FROM {name}_2",
        f"{name}_f": f"SELECT * EXCLUDE (av, taken, {', '.join('v_' + k for k in comps)}, {', '.join('p_' + k for k in pens)}), "
                     f"{H(clip(f'{name}_base - taken', '0e0', '100e0'), 1)} AS {name}_score, "
                     f"{H('-taken', 1)} AS {name}_penalty, {shown} FROM {name}_3",
    }


CATS = ["POLITICS", "ECONOMICS", "SPORTS", "CRYPTO", "ENTERTAINMENT", "GEOPOLITICS"]
KINDS = ["moneyline", "spreads", "totals", "q1_spreads", "team_totals", "safety"]
LEAGUES = ["nfl", "nba", "epl", "chess"]

C: dict[str, str] = {}

C["trader"] = f"""SELECT s_suppkey AS trader_id, '0x' || lpad(s_suppkey::VARCHAR, 40, '0') AS wallet,
 s_name AS display_name, s_acctbal > 0 AS active, CASE WHEN s_nationkey = 7 THEN 'MANUAL' ELSE 'LEADERBOARD' END AS source,
 CASE WHEN s_suppkey % 8 <> 3 THEN (s_suppkey*37 % 1001)/10e0 END AS stored_score,
 CASE WHEN s_suppkey % 9 <> 4 THEN {AS_OF} - (s_suppkey*7919 % 300)*3600 END AS last_synced_ts,
 CASE WHEN s_suppkey % 13 <> 6 THEN {AS_OF} - (s_suppkey*104729 % 3000)*3600 END AS last_activity_ts,
 s_suppkey % 17 = 5 AS has_sync_error FROM supplier"""
C["market0"] = """SELECT p_partkey // 10 AS m, sum(round(p_retailprice*100)::BIGINT * p_size)::BIGINT AS cents,
 sum(p_size)::BIGINT AS sz, min(p_name) AS question FROM part GROUP BY 1"""
C["market"] = f"""SELECT m AS market_id, 'c' || m AS condition_id, m // 3 AS event_id, question,
 {pick(CATS, 'm // 2')} AS category, {price('m*37')} AS price0, 1e0 - {price('m*37')} AS price1,
 cents / 100e0 / (CASE WHEN m % 7 = 3 THEN 500e0 WHEN m % 7 = 5 THEN 50e0 ELSE 1e0 END) AS liquidity,
 sz * 100e0 AS volume, CASE WHEN m % 11 <> 3 THEN (m % 24 + 1)/128e0 END AS spread,
 {price('m*37')} - CASE WHEN m % 11 <> 3 THEN (m % 24 + 1)/128e0 END/2e0 AS best_bid,
 {price('m*37')} + CASE WHEN m % 11 <> 3 THEN (m % 24 + 1)/128e0 END/2e0 AS best_ask,
 m % 2 = 0 AS resolved, m % 29 <> 1 AS accepting_orders,
 CASE WHEN m % 2 = 0 AND m % 31 <> 2 THEN (m // 2) % 2 END AS winner,
 836000000 + (m*7919 % 1800)*86400 + (m % 24)*3600 AS settled,
 CASE WHEN m % 2 = 0 AND m % 37 <> 4 THEN 836000000 + (m*7919 % 1800)*86400 + (m % 24)*3600 END AS resolved_ts,
 CASE WHEN m % 2 = 0 THEN 836000000 + (m*7919 % 1800)*86400 + (m % 24)*3600 + (m % 5 - 2)*3600
      WHEN m % 13 <> 5 THEN {AS_OF} + ((m*31 % 1000) - 50)*3600 END AS end_ts,
 CASE WHEN m % 19 <> 6 THEN 836000000 + (m*7919 % 1800)*86400 + (m % 24)*3600 - ((m*17 % 200)+1)*86400 END AS start_ts,
 CASE WHEN m % 10 <> 7 THEN (m*13 % 101)::DOUBLE END AS clarity_score,
 CASE WHEN (m // 2) % 6 = 2 AND m % 5 <> 0 AND m % 2 <> 0 AND m % 13 <> 5 THEN {AS_OF} + ((m*31 % 1000) - 50)*3600 END AS kickoff_ts,
 CASE WHEN (m // 2) % 6 = 2 THEN {pick(KINDS, 'm // 12')} END AS sports_market_type,
 CASE WHEN (m // 2) % 6 = 2 THEN {pick(LEAGUES, 'm // 24')} END AS league,
 CASE WHEN m % 23 <> 9 THEN {AS_OF} - (m*11 % 7200) END AS last_synced_ts FROM market0"""
C["activity1"] = """SELECT *, l_suppkey % 10 = 1 AND l_orderkey % 4 <> 0 AS rapid,
 CASE WHEN l_suppkey % 10 = 1 AND l_orderkey % 4 <> 0 THEN (l_partkey // 100)*10 ELSE l_partkey // 10 END AS mk FROM lineitem"""
C["activity"] = f"""SELECT l_suppkey AS trader_id, mk AS market_id,
 CASE WHEN l_suppkey % 4 = 0 AND l_linenumber % 3 <> 0 THEN (mk // 2) % 2 ELSE l_linenumber % 2 END AS outcome_index,
 CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS size,
 {price('l_orderkey*7 + l_partkey*13')} AS price, l_quantity * {price('l_orderkey*7 + l_partkey*13')} AS usd,
 CASE WHEN rapid THEN {AS_OF} - 86400*(l_orderkey % 3 + 1) + l_linenumber*600 + (l_orderkey % 7)*60
  ELSE floor(epoch(l_shipdate))::BIGINT + (l_orderkey*37 + l_linenumber) % 86400 END AS ts,
 l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS dedupe_key FROM activity1"""
C["fills"] = f"SELECT * FROM activity WHERE ts <= {AS_OF}"
C["closed1"] = """SELECT a.trader_id, a.market_id, a.outcome_index, m.category, m.winner, m.resolved_ts, m.end_ts,
 sum(a.size) AS shares, sum(a.usd) AS cost_basis_usd FROM activity a JOIN market m USING (market_id)
 WHERE m.resolved AND a.side = 'BUY' AND a.ts < coalesce(m.resolved_ts, m.end_ts) GROUP BY ALL"""
C["closed2"] = """SELECT *, CASE WHEN NOT (market_id % 17 = 3 OR winner IS NULL) THEN outcome_index = winner END AS won FROM closed1"""
C["closed"] = """SELECT trader_id, market_id, outcome_index, category, cost_basis_usd / shares AS avg_price, shares, cost_basis_usd,
 (CASE WHEN won THEN shares WHEN NOT won THEN 0e0 ELSE shares*0.5e0 END) - cost_basis_usd AS realized_pnl, won, resolved_ts, end_ts,
 't' || (market_id*10 + outcome_index) AS asset FROM closed2"""
C["open1"] = """SELECT a.trader_id, a.market_id, a.outcome_index,
 sum(CASE WHEN side='BUY' THEN size ELSE -size END) AS size, sum(size) FILTER (WHERE side='BUY') AS bought,
 sum(usd) FILTER (WHERE side='BUY') AS cost, min(ts) FILTER (WHERE side='BUY') AS opened_ts,
 any_value(CASE WHEN a.outcome_index = 0 THEN m.price0 ELSE m.price1 END) AS unit_price
 FROM fills a JOIN market m USING (market_id) WHERE NOT m.resolved GROUP BY 1,2,3"""
C["open_p"] = """SELECT trader_id, market_id, outcome_index, size, cost/bought AS avg_price, size*unit_price AS current_value,
 size*unit_price - size*(cost/bought) AS cash_pnl, opened_ts, 't' || (market_id*10 + outcome_index) AS asset FROM open1 WHERE size > 0"""
C["portfolio"] = "SELECT trader_id, sum(current_value) AS portfolio_value FROM open_p GROUP BY 1"
C["snap"] = f"""SELECT o_custkey // 10 AS market_id, floor(epoch(o_orderdate))::BIGINT + (o_orderkey*13 % 86400) AS captured_ts,
 o_orderkey AS seq, {price('o_orderkey*11')} AS p0, o_totalprice AS liquidity, (o_orderkey % 12 + 1)/128e0 AS spread FROM orders"""
C["curve"] = f"""SELECT user_id AS market_id, event_id % 2 AS outcome_index,
 836000000 + (floor(epoch(ts))::BIGINT - 1704067200)*60 AS t, {price('event_id*31')} AS p, event_id AS seq FROM events"""
C["tape"] = f"""SELECT '0x' || lpad(user_id::VARCHAR, 40, '0') AS wallet, user_id // 10 AS market_id, event_id % 2 AS outcome_index,
 round(value*100)::BIGINT::DOUBLE AS size, {price('event_id*31')} AS price, floor(epoch(ts))::BIGINT AS ts,
 event_id || ':' || user_id AS dedupe_key FROM events"""
C["book"] = f"""SELECT 't' || p_partkey AS token_id, kind, {price('p_partkey*37')} + sgn*(lv+1)/128e0 AS price,
 (p_size*(lv+1))::DOUBLE AS size FROM part, range(5) r(lv), (VALUES ('BID',-1),('ASK',1)) k(kind,sgn)
 WHERE {price('p_partkey*37')} + sgn*(lv+1)/128e0 > 0 AND {price('p_partkey*37')} + sgn*(lv+1)/128e0 < 1"""
C["legs"] = f"""SELECT p_partkey AS leg_id, p_partkey // 3 AS event_id, p_partkey % 7 = 0 AS no_first,
 {price('p_partkey*37')} AS p0, 1e0 - {price('p_partkey*37')} AS p1,
 CASE WHEN p_partkey % 10 <> 9 THEN {price('p_partkey*37')} + (p_partkey % 16 + 1)/128e0/2e0 END AS best_ask,
 (p_partkey % 16 + 1)/128e0 AS spread, (p_partkey // 3) % 3 = 1 AS moneyline,
 (p_partkey // 3) % 3 = 0 AND p_partkey % 20 <> 0 AS neg_risk FROM part"""
C["bets"] = f"""SELECT o_orderkey AS bet_id, o_custkey // 10 AS market_id, o_orderkey % 2 AS outcome_index,
 't' || ((o_custkey // 10)*10 + o_orderkey % 2) AS asset, {price('o_orderkey*17')} AS entry_price, (o_orderkey % 5 + 1)::DOUBLE AS stake,
 floor(epoch(o_orderdate))::BIGINT AS placed_ts,
 CASE WHEN o_orderkey % 6 <> 1 THEN floor(epoch(o_orderdate))::BIGINT + (o_orderkey % 40)*86400 + 43200 END AS closes_ts,
 CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'WALLET' ELSE 'MANUAL' END AS source,
 CASE WHEN o_orderkey % 9 <> 2 THEN (o_custkey*7 % 1001)/10e0 END AS horizon_score, m.category
 FROM orders JOIN market m ON m.market_id = o_custkey // 10"""

# --- wallet scores ----------------------------------------------------------------------------
C["known_closed"] = f"SELECT * FROM closed WHERE resolved_ts IS NULL OR resolved_ts <= {AS_OF}"
C["seen"] = "SELECT * FROM fills"
C["fifo1"] = """SELECT *, abs(usd) AS amt, sum(CASE WHEN side='BUY' THEN abs(usd) ELSE 0 END) OVER w AS bought,
 sum(CASE WHEN side='SELL' THEN abs(usd) ELSE 0 END) OVER w AS sold FROM seen
 WINDOW w AS (PARTITION BY trader_id, market_id, outcome_index ORDER BY ts, dedupe_key ROWS UNBOUNDED PRECEDING)"""
C["fifo2"] = """SELECT *, greatest(0e0, -min(bought-sold) OVER (PARTITION BY trader_id, market_id, outcome_index ORDER BY ts, dedupe_key ROWS UNBOUNDED PRECEDING)) AS lost FROM fifo1"""
C["fifo_sell"] = """SELECT trader_id, market_id, outcome_index, ts, sold-lost AS hi,
 coalesce(lag(sold-lost) OVER (PARTITION BY trader_id, market_id, outcome_index ORDER BY ts, dedupe_key), 0) AS lo FROM fifo2 WHERE side='SELL'"""
C["lots"] = """SELECT b.trader_id, b.market_id, b.outcome_index, b.ts AS buy_ts, s.ts AS sell_ts, s.ts - b.ts AS hold_seconds
 FROM fifo2 b JOIN fifo_sell s ON b.trader_id=s.trader_id AND b.market_id=s.market_id AND b.outcome_index=s.outcome_index
 AND s.hi > b.bought - b.amt AND s.lo < b.bought WHERE b.side='BUY' AND s.hi > s.lo"""
C["both_bought"] = """SELECT trader_id, count(*) AS both_sides_markets FROM (SELECT trader_id, market_id FROM seen WHERE side='BUY'
 GROUP BY 1,2 HAVING count(DISTINCT outcome_index) >= 2) GROUP BY 1"""
C["beh1"] = f"""SELECT s.trader_id, count(*) AS trade_count, count(*) FILTER (WHERE {AS_OF}-ts <= 604800) AS trades_7d,
 count(*) FILTER (WHERE {AS_OF}-ts <= 2592000) AS trades_30d,
 count(*) FILTER (WHERE usd > 0 AND usd < 25)::DOUBLE / nullif(count(*) FILTER (WHERE usd > 0),0) AS small_trade_share,
 coalesce(sum(usd) FILTER (WHERE {AS_OF}-ts <= 2592000),0) AS n30, count(DISTINCT market_id) AS distinct_markets FROM seen s GROUP BY 1"""
C["beh2"] = """SELECT b.*, coalesce(o.both_sides_markets,0) AS both_sides_markets, l.h AS median_hold_seconds,
 coalesce(c.n,0) AS settled_count, c.held::DOUBLE / nullif(c.n,0) AS held_share, b.n30 / nullif(p.portfolio_value,0) AS turnover_ratio
 FROM beh1 b LEFT JOIN both_bought o USING (trader_id) LEFT JOIN (SELECT trader_id, median(hold_seconds) AS h FROM lots GROUP BY 1) l USING (trader_id)
 LEFT JOIN (SELECT trader_id, count(*) AS n, count(won) AS held FROM known_closed GROUP BY 1) c USING (trader_id)
 LEFT JOIN portfolio p USING (trader_id)"""
C["beh3"] = """SELECT *,
 1e0 + CASE WHEN median_hold_seconds >= 604800 THEN 2 ELSE 0 END + CASE WHEN settled_count >= 10 AND held_share >= 0.6e0 THEN 2 ELSE 0 END
  + CASE WHEN trade_count/distinct_markets <= 4 THEN 1 ELSE 0 END AS s_d,
 CASE WHEN trades_7d >= 1000 THEN 3e0 WHEN trades_7d >= 300 THEN 1.5e0 ELSE 0e0 END + CASE WHEN median_hold_seconds <= 1800 THEN 1 ELSE 0 END
  + CASE WHEN small_trade_share >= 0.6e0 AND trade_count >= 100 THEN 2 ELSE 0 END AS s_b,
 CASE WHEN trades_7d >= 1000 THEN 2e0 WHEN trades_7d >= 300 THEN 1.5e0 ELSE 0e0 END + CASE WHEN median_hold_seconds <= 1800 THEN 3 ELSE 0 END
  + CASE WHEN turnover_ratio >= 5 THEN 1.5e0 ELSE 0e0 END + CASE WHEN settled_count >= 10 AND held_share <= 0.2e0 THEN 1.5e0 ELSE 0e0 END
  + CASE WHEN trade_count/distinct_markets >= 20 THEN 1.5e0 ELSE 0e0 END AS s_s,
 CASE WHEN both_sides_markets >= 8 THEN 3e0 ELSE 0e0 END + CASE WHEN small_trade_share >= 0.6e0 AND trade_count >= 100 THEN 1 ELSE 0 END
  + CASE WHEN turnover_ratio >= 5 THEN 1 ELSE 0 END + CASE WHEN trade_count/distinct_markets >= 20 THEN 1 ELSE 0 END AS s_m FROM beh2"""
C["beh4"] = """SELECT *, list_reverse_sort([s_d, s_b, s_s, s_m]) AS r FROM beh3"""
C["behaviour"] = """SELECT *, CASE WHEN trade_count < 5 THEN 'UNKNOWN' WHEN r[1] <= 1 THEN 'DISCRETIONARY' WHEN s_d = r[1] THEN 'DISCRETIONARY'
  WHEN s_b = r[1] THEN 'POSSIBLE_BOT' WHEN s_s = r[1] THEN 'SCALPER' ELSE 'MARKET_MAKER' END AS behaviour_class,
 CASE WHEN trade_count < 5 THEN 0e0 WHEN r[1] >= 5 AND r[1]-r[2] >= 2 THEN 0.9e0 WHEN r[1] >= 3 AND r[1]-r[2] >= 1 THEN 0.6e0 ELSE 0.3e0 END AS behaviour_confidence FROM beh4"""


def record(src: str, keys: str, now: str, prefix: str) -> None:
    """CTEs of trader metrics over ``src`` grouped by ``keys`` with the clock expression ``now``."""
    C[f"{prefix}_mon"] = f"""SELECT {keys}, {month('resolved_ts')} AS month, sum(realized_pnl) AS pnl, sum(cost_basis_usd) AS staked,
 count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses,
 CASE WHEN sum(cost_basis_usd) > 0 THEN sum(realized_pnl)/sum(cost_basis_usd) END AS roi FROM {src} WHERE resolved_ts IS NOT NULL GROUP BY ALL"""
    C[f"{prefix}_all"] = f"""SELECT {keys}, count(*) AS closed_count, count(won) AS decided, count(*) FILTER (WHERE won) AS win_count,
 count(*) FILTER (WHERE NOT won) AS loss_count, sum(realized_pnl) AS realized_pnl, sum(cost_basis_usd) AS total_staked,
 CASE WHEN sum(cost_basis_usd) > 0 THEN sum(realized_pnl)/sum(cost_basis_usd) END AS roi, avg(avg_price) AS avg_entry_price,
 avg(cost_basis_usd) AS avg_position_usd, max(cost_basis_usd) AS largest_position_usd,
 max(realized_pnl) FILTER (WHERE realized_pnl > 0) AS largest_win_usd, min(realized_pnl) FILTER (WHERE realized_pnl < 0) AS largest_loss_usd,
 sum(realized_pnl) FILTER (WHERE resolved_ts >= {now} - 2592000) / sum(cost_basis_usd) FILTER (WHERE resolved_ts >= {now} - 2592000) AS roi_30d,
 sum(realized_pnl) FILTER (WHERE resolved_ts >= {now} - 7776000) / sum(cost_basis_usd) FILTER (WHERE resolved_ts >= {now} - 7776000) AS roi_90d,
 max(realized_pnl) FILTER (WHERE realized_pnl > 0) / sum(realized_pnl) FILTER (WHERE realized_pnl > 0) AS top_win_share,
 count(*) FILTER (WHERE avg_price >= 0.95e0)::DOUBLE / count(*) AS high_price_share,
 CASE WHEN count(won) >= 5 THEN avg(cost_basis_usd) FILTER (WHERE won) / avg(cost_basis_usd) FILTER (WHERE NOT won) END AS conviction_ratio
 FROM {src} GROUP BY ALL"""
    C[f"{prefix}_cat1"] = f"""SELECT {keys}, category, count(*) AS closed_count, count(won) AS decided, count(*) FILTER (WHERE won) AS win_count,
 sum(realized_pnl) AS realized_pnl, sum(cost_basis_usd) AS total_staked, sum(realized_pnl)/sum(cost_basis_usd) AS roi FROM {src} GROUP BY ALL"""
    skill = S("(c.roi*c.closed_count + coalesce(a.roi, 0e0)*8e0)/(c.closed_count + 8e0)", -0.5, 1.0)
    C[f"{prefix}_cat"] = f"""SELECT c.*, {skill} AS skill_score, c.win_count::DOUBLE/nullif(c.decided,0) AS win_rate
 FROM {prefix}_cat1 c JOIN {prefix}_all a USING ({keys})"""
    C[f"{prefix}_m"] = f"""SELECT a.*, a.win_count::DOUBLE/nullif(a.decided,0) AS win_rate, coalesce(m.months,0) AS months, m.monthly_win_rate, m.profit_volatility,
 CASE WHEN m.profit_volatility > 0 THEN m.mean_month/m.profit_volatility END AS risk_adjusted_return, k.weighted_skill,
 a.decided >= 10 AND a.loss_count = 0 AS only_winners FROM {prefix}_all a
 LEFT JOIN (SELECT {keys}, count(*) AS months, count(*) FILTER (WHERE pnl > 0)::DOUBLE/count(*) AS monthly_win_rate, avg(roi) AS mean_month,
  CASE WHEN count(roi) >= 2 THEN stddev_samp(roi) END AS profit_volatility FROM {prefix}_mon GROUP BY ALL) m USING ({keys})
 LEFT JOIN (SELECT {keys}, sum(skill_score*total_staked)/sum(total_staked) AS weighted_skill FROM {prefix}_cat GROUP BY ALL) k USING ({keys})"""


TRADER_PARTS = {
    "long_term": (25, S("roi", -0.5, 1.5)),
    "consistency": (20, "CASE WHEN months >= 2 THEN greatest(0e0, monthly_win_rate*100e0 - coalesce(least(25e0, profit_volatility*25e0), 0e0)) WHEN closed_count >= 5 THEN win_rate*80e0 END"),
    "recent_form": (15, S("coalesce(roi_30d, roi_90d)", -0.5, 1.0)),
    "category_skill": (15, "weighted_skill"),
    "risk_adjusted": (10, S("risk_adjusted_return", -1.0, 3.0)),
    "sample_quality": (10, "least(100e0, sqrt(closed_count/50e0)*100e0)"),
    "conviction": (5, S("conviction_ratio", 0.5, 2.0)),
}


def trader_penalties(hhi: str, hold: str, maker: str, bot: str) -> dict[str, str]:
    return {
        "a": f"CASE WHEN closed_count < 10 THEN {H('12e0*(1e0 - closed_count/10e0)')} END",
        "b": f"CASE WHEN {hhi} > 0.4e0 THEN 6 END", "c": "CASE WHEN only_winners THEN 20 END",
        "d": "CASE WHEN high_price_share > 0.6e0 THEN 10 END", "e": f"CASE WHEN {hold} < 900 THEN 8 END",
        "f": "CASE WHEN top_win_share > 0.6e0 THEN 8 END", "g": "CASE WHEN roi_30d < -0.1e0 THEN 6 END",
        "h": f"CASE WHEN {maker} THEN 10 END", "i": f"CASE WHEN {bot} THEN 8 END"}


record("known_closed", "trader_id", str(AS_OF), "rec")
C["wallet0"] = """SELECT t.trader_id, coalesce(r.closed_count,0) AS closed_count, coalesce(r.win_count,0) AS win_count, coalesce(r.loss_count,0) AS loss_count,
 coalesce(r.decided,0) AS decided, r.* EXCLUDE (trader_id, closed_count, win_count, loss_count, decided, months), coalesce(r.months,0) AS months, o.unrealized_pnl, o.concentration_hhi, b.behaviour_class,
 b.behaviour_confidence, b.median_hold_seconds FROM trader t LEFT JOIN rec_m r USING (trader_id)
 LEFT JOIN (SELECT trader_id, sum(cash_pnl) AS unrealized_pnl, sum(current_value*current_value)/(sum(current_value)*sum(current_value)) AS concentration_hhi
  FROM open_p WHERE current_value > 0 GROUP BY 1) o USING (trader_id) LEFT JOIN behaviour b USING (trader_id)"""
C.update(score("smart", "wallet0", TRADER_PARTS, trader_penalties(
    "concentration_hhi", "median_hold_seconds", "behaviour_confidence >= 0.6e0 AND behaviour_class = 'MARKET_MAKER'",
    "behaviour_confidence >= 0.6e0 AND behaviour_class IN ('POSSIBLE_BOT','SCALPER')")))

# --- holders and consensus --------------------------------------------------------------------
C["live"] = "SELECT * FROM market WHERE NOT resolved AND accepting_orders AND market_id IN (SELECT market_id FROM open_p)"
C["recent"] = f"""SELECT market_id, trader_id, outcome_index, sum(CASE WHEN side='BUY' THEN usd ELSE -usd END) AS net FROM fills
 WHERE ts >= {AS_OF} - 86400 GROUP BY 1,2,3"""
C["holders"] = """SELECT p.market_id, p.outcome_index, p.trader_id, t.wallet, w.smart_score AS smart, c.skill_score AS skill, p.current_value AS size_usd,
 p.avg_price, p.opened_ts, w.avg_position_usd AS typical, coalesce(r.net, 0e0) AS net, coalesce(w.behaviour_class IN ('POSSIBLE_BOT','SCALPER','MARKET_MAKER') AND w.behaviour_confidence >= 0.6e0, false) AS bot
 FROM open_p p JOIN live m USING (market_id) JOIN trader t USING (trader_id) LEFT JOIN smart_f w USING (trader_id)
 LEFT JOIN rec_cat c ON c.trader_id = p.trader_id AND c.category = m.category
 LEFT JOIN recent r ON r.market_id=p.market_id AND r.trader_id=p.trader_id AND r.outcome_index=p.outcome_index"""


def agree(prefix: str, holders: str, sides: str, key: str) -> None:
    """CTEs of the consensus of ``holders`` over ``sides`` (price, liquidity, spread, now_ts)."""
    h, side = f"{prefix}_h", f"{key}, outcome_index"
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    C[h] = f"""SELECT x.*, sqrt(greatest(coalesce(size_usd,0e0),0e0)) * pow(greatest(0e0, least(100e0, coalesce(smart,0e0)))/100e0, 1.5e0) * CASE WHEN bot THEN 0.35e0 ELSE 1e0 END AS w,
 s.now_ts FROM {holders} x JOIN {sides} s USING ({side})"""
    C[f"{prefix}_agg"] = f"""SELECT {side}, count(*) AS trader_count, count(*) FILTER (WHERE coalesce(smart,0) >= 60) AS qualified_count,
 count(*) FILTER (WHERE bot) AS bot_count, sum(coalesce(size_usd,0e0)) AS exposure_usd, sum(greatest(0e0,net)) AS bought_24h, sum(greatest(0e0,-net)) AS sold_24h,
 count(*) FILTER (WHERE net > 0) AS increasing_count, count(*) FILTER (WHERE net < 0) AS decreasing_count, avg(avg_price) AS avg_entry_price,
 sum(avg_price*w) FILTER (WHERE w > 0) / nullif(sum(w) FILTER (WHERE w > 0 AND avg_price IS NOT NULL),0) AS weighted_entry_price,
 CASE WHEN sum(w) > 0 THEN max(w)/sum(w) END AS top_wallet_share, CASE WHEN sum(w) > 0 THEN sum(coalesce(smart,0)*w)/sum(w) END AS quality,
 sum(skill*w) FILTER (WHERE w > 0) / nullif(sum(w) FILTER (WHERE w > 0 AND skill IS NOT NULL),0) AS skill,
 avg(CASE WHEN typical > 0 THEN size_usd/typical END) AS relative, median(now_ts - opened_ts) FILTER (WHERE now_ts >= opened_ts)/3600e0 AS median_age_hours
 FROM {h} GROUP BY {side}"""
    C[f"{prefix}_opp"] = f"""SELECT {side}, count(*) AS opposing_count, count(*) FILTER (WHERE coalesce(smart,0) >= 60) AS qualified_opposing_count, sum(sz) AS opposing_exposure_usd
 FROM (SELECT {', '.join('a.' + k.strip() for k in key.split(','))}, a.outcome_index, b.wallet, max(b.smart) AS smart, max(coalesce(b.size_usd,0e0)) AS sz
  FROM {sides} a JOIN {holders} b ON {on} AND a.outcome_index <> b.outcome_index GROUP BY ALL) GROUP BY {side}"""
    C[f"{prefix}_clu"] = f"""SELECT {side}, least(5, max(n)) AS largest_cluster FROM (SELECT {', '.join('a.' + k.strip() for k in key.split(','))}, a.outcome_index, a.trader_id, count(*) AS n
 FROM {h} a JOIN {h} b ON {on} AND a.outcome_index=b.outcome_index AND (b.trader_id = a.trader_id OR ((b.opened_ts > a.opened_ts OR (b.opened_ts = a.opened_ts AND b.trader_id > a.trader_id))
  AND b.opened_ts - a.opened_ts <= 7200 AND abs(b.avg_price - a.avg_price) <= 0.01e0)) GROUP BY ALL) GROUP BY {side}"""
    C[f"{prefix}_in"] = f"""SELECT s.*, g.* EXCLUDE ({side}), coalesce(o.opposing_count,0) AS opposing_count, coalesce(o.qualified_opposing_count,0) AS qualified_opposing_count,
 coalesce(o.opposing_exposure_usd,0e0) AS opposing_exposure_usd, c.largest_cluster FROM {sides} s JOIN {prefix}_agg g USING ({side})
 LEFT JOIN {prefix}_opp o USING ({side}) LEFT JOIN {prefix}_clu c USING ({side})"""
    C[f"{prefix}_gap"] = gap(f"{prefix}_in")
    flow = S("(bought_24h - sold_24h)/exposure_usd", -0.2, 0.3)
    C.update(score(prefix, f"{prefix}_gap", {
        "agreement": (28, S("sqrt(greatest(0e0, qualified_count - qualified_opposing_count*0.5e0))/sqrt(6e0)", 0.0, 1.0)),
        "trader_quality": (24, "quality"), "category_skill": (14, "skill"),
        "recency": (14, f"CASE WHEN exposure_usd > 0 THEN {flow}*0.6e0 + (increasing_count/trader_count*100e0)*0.4e0 END"),
        "conviction": (10, S("relative", 0.5, 3.0)), "entry_alignment": (10, "entry_score")}, {
        "a": "CASE WHEN top_wallet_share > 0.6e0 THEN 12 END", "b": "CASE WHEN largest_cluster >= 3 THEN least(10, largest_cluster*2) END",
        "c": "CASE WHEN median_age_hours > 504 THEN 10 END", "d": "CASE WHEN entry_gap > 0.15e0 THEN 12 END",
        "e": "CASE WHEN liquidity < 5000 THEN 8 END", "f": "CASE WHEN spread > 0.05e0 THEN 6 END",
        "g": f"CASE WHEN bot_count > 0 THEN {H('bot_count/trader_count*10e0')} END"}))


def gap(src: str) -> str:
    g = "(current_price - weighted_entry_price)"
    sc = (f"CASE WHEN {g} <= 0 THEN CASE WHEN abs({g}) > 0.2e0 THEN 75e0 ELSE least(100e0, 90e0 + least(10e0, abs({g})/0.2e0*10e0)) END "
          f"WHEN {g} > 0 THEN greatest(0e0, 100e0 - {g}/0.2e0*85e0) END")
    return f"""SELECT *, CASE WHEN weighted_entry_price > 0 THEN {g} END AS entry_gap, CASE WHEN weighted_entry_price > 0 THEN {H(sc, 1)} END AS entry_score,
 CASE WHEN current_price IS NULL OR weighted_entry_price IS NULL OR weighted_entry_price <= 0 THEN 'UNKNOWN' WHEN {g} < -0.05e0 THEN 'BETTER_THAN_ELITE' WHEN abs({g}) <= 0.05e0 THEN 'GOOD'
  WHEN abs({g}) <= 0.1e0 THEN 'FAIR' WHEN abs({g}) <= 0.2e0 THEN 'POOR' ELSE 'STALE' END AS entry_quality FROM {src}"""


C["sides"] = f"""SELECT m.*, o AS outcome_index, CASE WHEN o=0 THEN price0 ELSE price1 END AS current_price, {AS_OF} AS now_ts FROM live m, (VALUES (0),(1)) v(o)"""
agree("cons", "holders", "sides", "market_id")


def model(src: str, cons: str) -> str:
    st = f"(({cons} - 50e0)/50e0)"
    head = f"(CASE WHEN {st} >= 0 THEN 1e0 - current_price ELSE current_price END)"
    shift = f"(sign({st}) * least(abs({st})*0.5e0*{head}, 0.12e0))"
    mid = f"greatest(0.01e0, least(0.99e0, current_price + {shift}))"
    width = "least(0.15e0, greatest(0.02e0, 0.04e0 + greatest(0, 6 - qualified_count)*0.012e0))"
    return f"""SELECT *, CASE WHEN qualified_count > 0 AND current_price > 0 AND current_price < 1 THEN {mid} END AS model_mid, {width} AS width,
 (end_ts - now_ts)/3600e0 AS hours_left, (now_ts - last_activity_ts)/3600e0 AS idle_hours FROM {src}"""


def opportunity(prefix: str, src: str, cons: str) -> None:
    C[f"{prefix}_mod"] = model(src, f"{cons}_score")
    C[f"{prefix}_mod2"] = f"""SELECT *, CASE WHEN model_mid IS NOT NULL THEN greatest(0.01e0, model_mid - width) END AS model_low,
 CASE WHEN model_mid IS NOT NULL THEN least(0.99e0, model_mid + width) END AS model_high, (model_mid - current_price)*100e0 AS edge_points,
 (CASE WHEN current_price < 0.15e0 THEN 2 WHEN current_price < 0.35e0 THEN 1 ELSE 0 END + CASE WHEN liquidity < 10000 THEN 1 ELSE 0 END
  + CASE WHEN hours_left < 24 THEN 1 ELSE 0 END + CASE WHEN clarity_score < 45 THEN 1 ELSE 0 END) AS risk_points FROM {prefix}_mod"""
    pts = "least(20e0, (entry_gap - 0.05e0)*80e0)"
    C.update(score(prefix, f"{prefix}_mod2", {
        "consensus": (30, f"{cons}_score"), "trader_quality": (20, f"{cons}_trader_quality"), "entry_quality": (15, "entry_score"),
        "liquidity": (10, liq("liquidity", 1000, 500000)), "execution": (10, "100e0 - " + S("spread", 0.001, 0.08)),
        "recency": (10, f"CASE WHEN idle_hours IS NOT NULL THEN greatest(0e0, 100e0 - idle_hours/336e0*100e0) ELSE {cons}_recency END"),
        "clarity": (5, "clarity_score")}, {
        "a": "CASE WHEN liquidity < 2000 THEN 10 END", "b": "CASE WHEN spread > 0.05e0 THEN 8 END", "c": "CASE WHEN idle_hours > 336 THEN 8 END",
        "d": f"CASE WHEN entry_gap > 0.05e0 THEN {H(pts, 1)} END", "e": "CASE WHEN top_wallet_share > 0.6e0 THEN 10 END",
        "f": "CASE WHEN clarity_score < 45 THEN 6 END", "g": "CASE WHEN hours_left < 12 THEN 6 END", "h": "CASE WHEN current_price < 0.15e0 THEN 12 END",
        "i": "CASE WHEN edge_points <= 0 THEN 18 END", "j": "CASE WHEN qualified_count = 0 THEN 30 WHEN qualified_count < 2 THEN 10 END"}))


C["gated"] = """SELECT *, CASE WHEN current_price <= 0 OR current_price >= 1 THEN 'NO_PRICE' WHEN current_price < 0.02e0 OR current_price > 0.98e0 THEN 'UNTRADEABLE_PRICE'
 WHEN qualified_count < 1 THEN 'NO_QUALIFIED_TRADER' END AS reject_reason FROM cons_f"""
C["listed"] = """SELECT g.*, l.last_activity_ts FROM gated g LEFT JOIN (SELECT market_id, max(ts) AS last_activity_ts FROM fills GROUP BY 1) l USING (market_id)
 WHERE reject_reason IS NULL"""
opportunity("opp", "listed", "cons")
C["late"] = """SELECT h.market_id, h.outcome_index, coalesce(sum(size_usd) FILTER (WHERE opened_ts >= kickoff_ts - 86400),0e0) AS late_usd,
 coalesce(sum(size_usd) FILTER (WHERE opened_ts < kickoff_ts - 86400),0e0) AS early_usd FROM holders h JOIN live m USING (market_id)
 WHERE m.kickoff_ts IS NOT NULL AND size_usd > 0 GROUP BY 1,2"""
HOURS = "(CASE league WHEN 'nfl' THEN 3.2e0 WHEN 'nba' THEN 2.5e0 WHEN 'epl' THEN 2e0 ELSE 3e0 END)"
C["sport1"] = f"""SELECT o.*, coalesce(l.late_usd,0e0) AS late_usd, coalesce(l.early_usd,0e0) AS early_usd,
 CASE WHEN l.late_usd + l.early_usd > 0 THEN l.late_usd/(l.late_usd+l.early_usd) END AS late_share, (kickoff_ts - now_ts)/3600e0 AS hours_to_kickoff,
 kickoff_ts + round({HOURS}*3600e0)::BIGINT AS sports_settles_ts, (current_price - weighted_entry_price)*100e0 AS line_move_points,
 CASE WHEN sports_market_type IN ('moneyline','spreads','totals') THEN 'CORE' WHEN sports_market_type = 'team_totals' THEN 'DERIVATIVE' ELSE 'EXOTIC' END AS tier,
 CASE sports_market_type WHEN 'moneyline' THEN 'Moneyline' WHEN 'spreads' THEN 'Spread' WHEN 'totals' THEN 'Total' WHEN 'team_totals' THEN 'Team total' WHEN 'q1_spreads' THEN '1Q spread' WHEN 'safety' THEN 'Safety' ELSE 'Other' END AS kind_label,
 CASE WHEN spread > 0.15e0 THEN 'UNQUOTED_SPREAD' WHEN liquidity < 500 THEN 'PLACEHOLDER_LIQUIDITY' WHEN liquidity IS NULL AND spread IS NULL THEN 'NOTHING_REPORTED' END AS untradeable_reason
 FROM opp_f o LEFT JOIN late l USING (market_id, outcome_index)"""
C["sport"] = f"""SELECT *, CASE WHEN hours_to_kickoff IS NULL THEN 'NOT_A_GAME' WHEN hours_to_kickoff > 168 THEN 'EARLY' WHEN hours_to_kickoff > 6 THEN 'APPROACHING'
 WHEN hours_to_kickoff > 0 THEN 'IMMINENT' WHEN -hours_to_kickoff < {HOURS} THEN 'IN_PLAY' ELSE 'ENDED' END AS game_phase,
 CASE WHEN line_move_points IS NULL THEN 'UNKNOWN' WHEN abs(line_move_points) < 0.5e0 THEN 'FLAT' WHEN line_move_points > 0 AND increasing_count > decreasing_count THEN 'STEAM'
  WHEN line_move_points > 0 THEN 'CONFIRMED' WHEN decreasing_count > increasing_count THEN 'CAPITULATING' WHEN increasing_count > decreasing_count THEN 'DOUBLING_DOWN' ELSE 'UNKNOWN' END AS line_verdict FROM sport1"""
C["hor0"] = """SELECT * REPLACE (CASE WHEN outcome_index = 0 THEN best_ask ELSE 1e0 - best_bid END AS best_ask) FROM sport"""
C["hor1"] = """SELECT *, (CASE WHEN best_ask > 0 AND best_ask < 1 THEN best_ask WHEN spread IS NOT NULL THEN current_price + spread/2e0 ELSE current_price END) * (1e0+0.01e0) AS ep0,
 coalesce(sports_settles_ts, end_ts) AS settles_ts FROM hor0"""
C["hor2"] = """SELECT *, CASE WHEN ep0 > 0 AND ep0 < 1 THEN ep0 END AS effective_price, CASE WHEN settles_ts > now_ts THEN (settles_ts-now_ts)/3600e0 END AS hours_to_settle FROM hor1"""
C["hor3"] = """SELECT *, CASE WHEN hours_to_settle IS NOT NULL THEN greatest(hours_to_settle/24e0, 1e0) END AS capital_days, model_mid - current_price AS gross, model_mid - effective_price AS net FROM hor2"""
C["hor4"] = """SELECT *, CASE WHEN net IS NOT NULL AND gross > 0 THEN greatest(0e0, least(1e0, net/gross)) END AS edge_retention,
 (net/effective_price)/capital_days AS return_per_day, ((model_low - effective_price)/effective_price)/capital_days AS downside_per_day, net*100e0 AS net_edge_points,
 CASE WHEN kickoff_ts IS NOT NULL THEN 100e0 WHEN end_ts IS NOT NULL THEN 65e0 ELSE 0e0 END AS timing FROM hor3"""
_d = liq("liquidity", 500, 100000)
C.update(score("hor", "hor4", {
    "capital_efficiency": (40, S("return_per_day", 0.0, 0.1)), "downside_tested": (20, S("downside_per_day", 0.0, 0.1)), "signal_confidence": (20, "cons_score"),
    "executability": (12, f"CASE WHEN {_d} IS NULL THEN edge_retention*100e0 WHEN edge_retention IS NULL THEN {_d} ELSE edge_retention*100e0*0.5e0 + {_d}*0.5e0 END"),
    "settlement_certainty": (8, "CASE WHEN clarity_score IS NULL THEN timing ELSE timing*0.5e0 + clarity_score*0.5e0 END")}, {
    "a": "CASE WHEN hours_to_settle IS NULL THEN 25 END", "b": "CASE WHEN net <= 0 THEN 35 END", "c": "CASE WHEN effective_price < 0.15e0 THEN 12 END",
    "d": "CASE WHEN liquidity < 1000 THEN 15 END", "e": "CASE WHEN qualified_count < 2 THEN 15 END", "f": "CASE WHEN clarity_score < 45 THEN 6 END"}))
C["board"] = """SELECT *, row_number() OVER (ORDER BY opp_score DESC, market_id, outcome_index) AS rank FROM hor_f"""

# --- point in time ----------------------------------------------------------------------------
C["universe"] = f"""SELECT * FROM market WHERE resolved AND resolved_ts BETWEEN 0 AND {AS_OF} AND market_id IN (SELECT market_id FROM activity)"""
C["moment"] = f"""SELECT u.*, h AS horizon_days, resolved_ts - h*86400 AS signal_ts, CASE WHEN winner IS NULL THEN 'NO_OUTCOME' WHEN resolved_ts - h*86400 < start_ts THEN 'BEFORE_START'
 WHEN resolved_ts - h*86400 >= {AS_OF} THEN 'NOT_YET_PAST' END AS r0 FROM universe u, (VALUES (1),(2),(3),(5),(7),(14)) v(h)"""
C["asked"] = "SELECT market_id, signal_ts FROM moment WHERE r0 IS NULL"
C["fold"] = """SELECT q.market_id, q.signal_ts, a.trader_id, a.outcome_index, min(a.ts) FILTER (WHERE side='BUY') AS first_buy_ts,
 coalesce(sum(CASE WHEN side='BUY' THEN usd ELSE -usd END) FILTER (WHERE a.ts >= q.signal_ts - 86400),0e0) AS recent_net_usd,
 list_reduce(list({'s': CASE WHEN side='BUY' THEN size ELSE -size END, 'c': usd} ORDER BY a.ts, dedupe_key),
  lambda acc, x: CASE WHEN x.s > 0 THEN {'s': acc.s + x.s, 'c': acc.c + x.c}
   WHEN acc.s > 0 THEN {'s': greatest(0e0, acc.s + x.s), 'c': acc.c * (1e0 - least(1e0, -x.s/acc.s))} ELSE {'s': 0e0, 'c': 0e0} END, {'s': 0e0, 'c': 0e0}) AS st
 FROM asked q JOIN activity a ON a.market_id = q.market_id AND a.ts <= q.signal_ts GROUP BY 1,2,3,4"""
C["pos_then"] = """SELECT market_id, signal_ts, trader_id, outcome_index, st.s AS shares, st.c AS cost_usd, st.c/st.s AS avg_price, first_buy_ts, recent_net_usd FROM fold WHERE st.s > 0.5e0 AND st.c > 0.5e0"""
C["q2"] = "SELECT q.*, o AS outcome_index FROM asked q, (VALUES (0),(1)) v(o)"
C["px_curve"] = """SELECT market_id, signal_ts, outcome_index, CASE WHEN r.p > 0 AND r.p < 1 THEN r.p END AS p, CASE WHEN r.p > 0 AND r.p < 1 THEN r.t END AS t
 FROM (SELECT q.market_id, q.signal_ts, q.outcome_index, max({'t': c.t, 'seq': c.seq, 'p': c.p}) AS r FROM q2 q JOIN curve c ON c.market_id=q.market_id AND c.outcome_index=q.outcome_index AND c.t <= q.signal_ts GROUP BY 1,2,3)"""
C["px_fill"] = """SELECT q.market_id, q.signal_ts, q.outcome_index, max({'t': c.ts, 'k': c.dedupe_key, 'p': c.price}) AS r FROM q2 q JOIN activity c ON c.market_id=q.market_id AND c.outcome_index=q.outcome_index AND c.ts <= q.signal_ts GROUP BY 1,2,3"""
C["px_snap"] = """SELECT q.market_id, q.signal_ts, max({'t': s.captured_ts, 'seq': s.seq, 'p0': s.p0, 'l': s.liquidity, 'sp': s.spread}) AS r FROM asked q JOIN snap s ON s.market_id=q.market_id AND s.captured_ts <= q.signal_ts GROUP BY 1,2"""
C["px1"] = """SELECT q.*, c.p AS cp, c.t AS ct, f.r.p AS fp, f.r.t AS ft, s.r AS s, max(c.t) OVER w AS cmax, max(f.r.t) OVER w AS fmax, sum(c.p) OVER w AS csum, sum(f.r.p) OVER w AS fsum,
 count(c.p) OVER w AS cn, count(f.r.p) OVER w AS fn FROM q2 q LEFT JOIN px_curve c USING (market_id, signal_ts, outcome_index) LEFT JOIN px_fill f USING (market_id, signal_ts, outcome_index)
 LEFT JOIN px_snap s ON s.market_id=q.market_id AND s.signal_ts=q.signal_ts WINDOW w AS (PARTITION BY q.market_id, q.signal_ts)"""
C["px"] = """SELECT market_id, signal_ts, outcome_index, CASE WHEN cmax IS NOT NULL THEN 'series' WHEN s IS NOT NULL THEN 'snapshot' ELSE 'trade' END AS source,
 CASE WHEN cmax IS NOT NULL THEN coalesce(cp, CASE WHEN cn = 1 THEN 1e0 - csum END) WHEN s IS NOT NULL THEN CASE WHEN outcome_index=0 THEN s.p0 ELSE 1e0 - s.p0 END
  ELSE coalesce(fp, CASE WHEN fn = 1 THEN 1e0 - fsum END) END AS price,
 CASE WHEN cmax IS NULL AND s IS NOT NULL THEN s.l END AS liquidity, CASE WHEN cmax IS NULL AND s IS NOT NULL THEN s.sp END AS spread,
 CASE WHEN cmax IS NOT NULL THEN cmax WHEN s IS NOT NULL THEN s.t ELSE fmax END AS observed_ts FROM px1 WHERE cmax IS NOT NULL OR s IS NOT NULL OR fmax IS NOT NULL"""
C["judged"] = """SELECT m.*, greatest(0, m.signal_ts - p.obs) AS age_seconds, coalesce(r0, CASE WHEN h.n IS NULL THEN 'NO_HOLDERS' WHEN p.obs IS NULL THEN 'NO_PRICE' WHEN m.signal_ts - p.obs > 2592000 THEN 'STALE' END) AS reason
 FROM moment m LEFT JOIN (SELECT market_id, signal_ts, count(*) AS n FROM pos_then GROUP BY 1,2) h USING (market_id, signal_ts)
 LEFT JOIN (SELECT market_id, signal_ts, max(observed_ts) AS obs FROM px GROUP BY 1,2) p USING (market_id, signal_ts)"""
C["pside0"] = """SELECT j.* EXCLUDE (liquidity, spread), h.outcome_index, p.price AS current_price, p.liquidity, p.spread, p.source, j.signal_ts AS now_ts,
 CASE WHEN p.price IS NULL OR p.price <= 0 OR p.price >= 1 THEN 'NO_PRICE' WHEN p.price < 0.05e0 OR p.price > 0.95e0 THEN 'OUT_OF_BAND' END AS side_reason
 FROM judged j JOIN (SELECT DISTINCT market_id, signal_ts, outcome_index FROM pos_then) h USING (market_id, signal_ts) LEFT JOIN px p USING (market_id, signal_ts, outcome_index) WHERE j.reason IS NULL"""
C["pside"] = "SELECT * FROM pside0 WHERE side_reason IS NULL"
C["need"] = "SELECT DISTINCT trader_id, signal_ts // 86400 AS as_of_day FROM pos_then"
C["known_then"] = """SELECT n.as_of_day, c.* REPLACE (coalesce(c.resolved_ts, c.end_ts) AS resolved_ts) FROM need n JOIN closed c USING (trader_id) WHERE coalesce(c.resolved_ts, c.end_ts) < n.as_of_day*86400"""
record("known_then", "trader_id, as_of_day", "as_of_day*86400", "pit")
C.update(score("pits", "pit_m", TRADER_PARTS, trader_penalties("NULL::DOUBLE", "NULL::DOUBLE", "false", "false")))
C["need3"] = "SELECT trader_id, d AS as_of_day FROM trader, (VALUES (10300),(10900),(11400)) v(d)"
C["known3"] = C["known_then"].replace("need n", "need3 n")
record("known3", "trader_id, as_of_day", "as_of_day*86400", "asof")
C.update(score("asofs", "asof_m", TRADER_PARTS, trader_penalties("NULL::DOUBLE", "NULL::DOUBLE", "false", "false")))
C["pholders"] = """SELECT h.market_id, h.signal_ts, h.outcome_index, h.trader_id, t.wallet, coalesce(s.pits_score, 0e0) AS smart, NULL::DOUBLE AS skill, h.shares*p.price AS size_usd, h.avg_price,
 h.first_buy_ts AS opened_ts, NULL::DOUBLE AS typical, h.recent_net_usd AS net, false AS bot FROM pos_then h JOIN trader t USING (trader_id)
 LEFT JOIN pits_f s ON s.trader_id=h.trader_id AND s.as_of_day = h.signal_ts // 86400 LEFT JOIN px p USING (market_id, signal_ts, outcome_index)"""
agree("pcons", "pholders", "pside", "market_id, signal_ts")
C["pact"] = """SELECT c.*, l.last_activity_ts FROM pcons_f c LEFT JOIN (SELECT q.market_id, q.signal_ts, q.outcome_index, max(a.ts) AS last_activity_ts FROM q2 q JOIN activity a
 ON a.market_id=q.market_id AND a.outcome_index=q.outcome_index AND a.ts <= q.signal_ts GROUP BY 1,2,3) l USING (market_id, signal_ts, outcome_index)"""
opportunity("popp", "pact", "pcons")
C["signal"] = """SELECT horizon_days, market_id, outcome_index, signal_ts, category, current_price AS price, source, age_seconds, popp_score AS opportunity, pcons_score AS consensus, qualified_count, trader_count,
 weighted_entry_price, entry_gap, outcome_index = winner AS won, CASE WHEN outcome_index = winner THEN 1e0/current_price - 1e0 ELSE -1e0 END AS pnl, resolved_ts,
 CASE WHEN popp_score < 20 THEN '0-20' WHEN popp_score < 40 THEN '20-40' WHEN popp_score < 55 THEN '40-55' WHEN popp_score < 70 THEN '55-70' WHEN popp_score < 85 THEN '70-85' ELSE '85-100' END AS band FROM popp_f"""
C["clv"] = f"""SELECT b.*, c.p AS closing_price, CASE WHEN closes_ts <= {AS_OF} - 600 THEN CASE WHEN c.p IS NULL THEN 'UNAVAILABLE' ELSE 'CLOB_HISTORY' END END AS clv_source,
 (c.p - entry_price)*100e0 AS clv_points FROM bets b LEFT JOIN (SELECT b.bet_id, max({{'t': c.t, 'seq': c.seq, 'p': c.p}}).p AS p FROM bets b JOIN curve c ON c.market_id=b.market_id
 AND c.outcome_index=b.outcome_index AND c.t <= b.closes_ts WHERE b.closes_ts <= {AS_OF} - 600 GROUP BY 1) c USING (bet_id)"""


def with_ctes(body: str) -> str:
    """``body`` preceded by every CTE it needs, dependencies first."""
    order: list[str] = []
    open_: set[str] = set()
    names = sorted(C, key=len, reverse=True)
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, names)) + r")\b")

    def visit(text: str, own: str | None) -> None:
        for name in pattern.findall(re.sub(r"'[^']*'", "", text)):
            if name == own or name in order or name in open_:
                continue
            open_.add(name)
            visit(C[name], name)
            if name not in order:
                order.append(name)

    visit(body, None)
    head = ",\n".join(f"{n} AS MATERIALIZED ({C[n]})" for n in order)
    return (f"WITH {head}\n" if head else "") + body


# Six decimals. The offset is not a binary fraction, so values that are exact multiples of a power of
# two are never split between two results by the last bit.
TYPES = {"i": "CAST({0} AS BIGINT)", "d": "floor(CAST({0} AS DOUBLE)*1e6+0.37e0)/1e6", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}


def typed(cols: str, body: str) -> str:
    """Final SELECT with the registered column types around ``body``."""
    out = ", ".join(f"{TYPES[k].format('_r.' + n)} AS {n}" for n, k in (c.split(":") for c in cols.split()))
    return with_ctes(f"SELECT {out} FROM ({body}) _r")
