"""Registered queries: ingest, text, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks.oracle import AS_OF, C, pick, price
from checks.registry import ENTRIES, Workspace, entry, oracle
from tidemark import fixed_values as V
from tidemark import schemas
from tidemark.functions import parse as P
from tidemark.functions import pricing as PR
from tidemark.functions import sports as SP
from tidemark.functions import text as TX
from tidemark.session import cut_lineage, release, run_folder, without_leftovers
from tidemark.plans import from_landed
from tidemark.sources import landed, normalize, sinks, stored
from tidemark.streaming import fills as streams
from tidemark.views import pick as choose
from tidemark.views import price_of

TAGS = ["Politics", "Crypto Prices", "NFL", "Fed Rates", "esports", "League of Legends", "Middle East", "Box Office", "Gardening", "World"]

def land(w: Workspace, records: DataFrame) -> str:
    """Write records as landed JSON files and return their folder. They are packed: names of fields make up most of them."""
    path = f"{run_folder(w.spark)}/landed-{uuid.uuid4().hex}"
    with without_leftovers(w.spark):
        records.write.option("compression", "gzip").json(path)
    return path


# --- wire records built from the parts: three markets to an event ---------------------------------
def wire_events(w: Workspace) -> DataFrame:
    """Event JSON as it lands, one line per three parts."""
    k = F.col("p_partkey")
    closed, p = k % 2 == 0, price_of(k * 37)
    won = closed & (k % 4 == 0)
    prices = F.when(won, F.lit('["1", "0"]')).when(k % 50 == 7, "broken").otherwise(F.concat(F.lit('["'), p, F.lit('", "'), 1.0 - p, F.lit('"]')))
    market = F.struct(
        k.cast("string").alias("id"), F.concat(F.lit("c"), k).alias("conditionId"),
        F.concat("p_name", F.lit(" vs "), choose(["bitcoin", "president", "anything", "stock market"], k), F.lit("?")).alias("question"),
        F.lit('["Yes", "No"]').alias("outcomes"), prices.alias("outcomePrices"),
        F.concat(F.lit('["t'), k * 2, F.lit('", "t'), k * 2 + 1, F.lit('"]')).alias("clobTokenIds"),
        F.when(k % 3 == 0, F.col("p_retailprice")).alias("liquidityNum"), F.col("p_size").cast("string").alias("liquidity"),
        closed.alias("closed"), (k % 7 != 0).alias("acceptingOrders"),
        F.when(k % 4 == 1, F.lit("2001-09-13 17:00:00+00")).when(k % 4 == 2, F.lit("2001-09-13 17:00:00")).alias("gameStartTime"),
        F.concat(F.lit("2001-08-0"), k % 9 + 1, F.lit("T10:00:00Z")).alias("endDate"))
    event = F.floor(k / 3)
    nested = w.raw("part").groupBy(event.alias("e")).agg(F.collect_list(market).alias("markets"))
    tag = F.struct(choose(TAGS, F.col("e")).alias("label"))
    more = F.struct(choose(TAGS, F.floor(F.col("e") / 10)).alias("label"))
    return landed.events(w.spark, land(w, nested.select(
        F.concat(F.lit("e"), F.col("e")).alias("id"), F.concat(F.lit("title "), F.col("e")).alias("title"),
        F.when(F.col("e") % 8 != 0, F.array(tag, more)).alias("tags"), "markets")))


C["wire"] = f"""SELECT *, p_partkey AS k, p_partkey // 3 AS e, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 = 0 THEN 1e0 WHEN p_partkey % 50 = 7 THEN NULL ELSE {price('p_partkey*37')} END AS w0,
 CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 = 0 THEN 0e0 WHEN p_partkey % 50 = 7 THEN NULL ELSE 1e0 - {price('p_partkey*37')} END AS w1,
 CASE WHEN (p_partkey // 3) % 8 <> 0 THEN [{pick(TAGS, '(p_partkey // 3)')}, {pick(TAGS, '(p_partkey // 30)')}] ELSE [] END AS tags,
 p_name || ' vs ' || {pick(["bitcoin", "president", "anything", "stock market"], 'p_partkey')} || '?' AS question FROM part"""
_words = ",".join(f"('{c}','{w}')" for c, t in V.CATEGORY_WORDS.items() for w in t)
_order = "list_position([" + ",".join(f"'{c}'" for c in V.CATEGORY_ORDER) + "], category)"
C["word_list"] = f"SELECT * FROM (VALUES {_words}) v(category, word)"
_slug = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_match = "(slug = word OR slug LIKE word || '-%' OR slug LIKE '%-' || word OR slug LIKE '%-' || word || '-%')"


def categories(src: str, key: str, tags: str, text: str, name: str) -> None:
    C[f"{name}_tag"] = f"SELECT {key}, {_slug.format('tag')} AS slug, pos FROM (SELECT {key}, unnest({tags}) AS tag, generate_subscripts({tags}, 1) AS pos FROM {src})"
    C[f"{name}_tagwin"] = f"""SELECT {key}, arg_max(category, {{'s': s, 'o': -{_order}}}) AS c FROM (SELECT {key}, category, sum(wt) AS s FROM (SELECT DISTINCT {key}, pos, category, CASE WHEN slug IN ({','.join(f"'{g}'" for g in V.GENERIC_TAGS)}) THEN 1 ELSE 3 END AS wt
 FROM {name}_tag JOIN word_list ON {_match}) GROUP BY 1,2) GROUP BY 1"""
    C[f"{name}_textwin"] = f"""SELECT {key}, arg_max(category, {{'s': s, 'o': -{_order}}}) AS c FROM (SELECT {key}, category, count(*) AS s FROM (SELECT {key}, {_slug.format(text)} AS slug FROM {src}) JOIN word_list ON length(word) >= 4 AND {_match} GROUP BY 1,2) GROUP BY 1"""
    C[f"{name}_cat"] = f"SELECT s.{key}, coalesce(t.c, x.c, CASE WHEN len({tags}) > 0 THEN 'OTHER' ELSE 'UNKNOWN' END) AS category FROM {src} s LEFT JOIN {name}_tagwin t USING ({key}) LEFT JOIN {name}_textwin x USING ({key})"


categories("wire", "k", "tags", "question", "wirec")
entry("normalize_markets", "condition_id:s event_id:s question:s category:s price0:d price1:d n_prices:i token1:s liquidity:d end_ts:i closed:b resolved:b winner:i accepting_orders:b kickoff_ts:i league:s clarity_score:d", lambda w: normalize.ingestible(
    normalize.normalize_markets(landed.event_markets(wire_events(w)))).select("*", F.get("prices", F.lit(0)).alias("price0"), F.get("prices", F.lit(1)).alias("price1"), F.size("prices").alias("n_prices"), F.get("token_ids", F.lit(1)).alias("token1")),
      """SELECT 'c' || k AS condition_id, 'e' || e AS event_id, question, c.category, w0 AS price0, w1 AS price1, CASE WHEN w0 IS NULL THEN 0 ELSE 2 END AS n_prices, 't' || (k*2+1) AS token1, CASE WHEN k % 3 = 0 THEN p_retailprice ELSE p_size END AS liquidity,
      epoch(make_timestamp(2001, 8, (k % 9 + 1)::INT, 10, 0, 0.0))::BIGINT AS end_ts, k % 2 = 0 AS closed, k % 4 = 0 AS resolved, CASE WHEN k % 4 = 0 THEN 0 END AS winner, k % 7 <> 0 AS accepting_orders, CASE WHEN k % 4 IN (1,2) THEN 1000400400 END AS kickoff_ts,
      CASE WHEN list_contains(tags, 'NFL') THEN 'nfl' WHEN list_contains(tags, 'esports') THEN 'esports' END AS league, 35e0 AS clarity_score FROM wire JOIN wirec_cat c USING (k)""")
entry("dedupe_markets", "condition_id:s event_id:s", lambda w: normalize.dedupe_markets(w.raw("orders").select(F.concat(F.lit("c"), F.floor(F.col("o_custkey") / 4)).alias("condition_id"), F.concat(F.lit("e"), F.col("o_orderkey")).alias("event_id"), F.col("o_orderkey").alias("arrival"))),
      "SELECT 'c' || (o_custkey // 4) AS condition_id, 'e' || max(o_orderkey) AS event_id FROM orders GROUP BY 1")
# --- text ---------------------------------------------------------------------------------------
_t = "regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')"
_pts = "70 + CASE WHEN length(t) < 80 THEN -15 WHEN length(t) > 400 THEN 5 ELSE 0 END + 10" + "".join(f" + CASE WHEN regexp_matches(t, '(?i){p}') THEN {n} ELSE 0 END" for p, _, n in V.AMBIGUITY_TERMS) + "".join(f" + CASE WHEN regexp_matches(t, '(?i){p}') THEN {n} ELSE 0 END" for p, n in V.CLARITY_TERMS)
_flags = "concat_ws(',', CASE WHEN length(t) < 80 THEN 'VERY_SHORT' END, " + ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{f}' END" for p, f, _ in V.AMBIGUITY_TERMS) + ")"


def clarity(w: Workspace) -> DataFrame:
    scored = w.raw("documents").select("doc_id", *[c.alias(n) for n, c in TX.resolution_clarity("text", "source").items()])
    return scored.withColumn("flags", F.array_join("clarity_flags", ","))


entry("resolution_clarity", "doc_id:i clarity_score:d flags:s", clarity, f"SELECT doc_id, CASE WHEN length(t) = 0 THEN 35e0 ELSE greatest(0, least(100, {_pts})) END AS clarity_score, CASE WHEN length(t) = 0 THEN 'UNPUBLISHED' ELSE {_flags} END AS flags FROM (SELECT doc_id, {_t} AS t FROM documents)")
C["docs_in"] = "SELECT doc_id, text, []::VARCHAR[] AS tags FROM documents"
categories("docs_in", "doc_id", "tags", "text", "docc")
entry("category_from_text", "doc_id:i category:s", lambda w: TX.resolve_category(w.raw("documents").select("doc_id", "text", F.array().cast("array<string>").alias("tags")), "tags", "text").select("doc_id", "category"), "SELECT * FROM docc_cat")
entry("quoted_lines", "p_partkey:i line:d team:s", lambda w: w.raw("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Spread: "), "p_name", F.lit(" ("), F.lit("-"), F.col("p_size"), F.lit(".5)"))).otherwise(F.concat("p_name", F.lit(" 1H O/U "), "p_size")).alias("q"))
      .select("p_partkey", TX.quoted_line("q").alias("line"), TX.spread_team("q").alias("team")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN -p_size - 0.5e0 ELSE p_size END AS line, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS team FROM part")


def parsed(w: Workspace) -> DataFrame:
    """Wallet texts, unix seconds, price pairs and stored curves, good and bad, one set per supplier."""
    k = F.col("s_suppkey")
    address = F.when(k % 3 == 0, F.concat(F.lit("0x"), F.lpad(k.cast("string"), 40, "0"))).when(
        k % 3 == 1, F.concat(F.lit(" 0xAB"), F.lpad(k.cast("string"), 38, "0"), F.lit(" "))).otherwise(F.concat(F.lit("0x"), k))
    seconds = F.when(k % 8 == 0, 0).when(k % 4 == 0, -k).otherwise(k * 100)
    stored = F.when(k % 2 == 0, F.concat(
        F.lit('[{"t": '), k, F.lit(', "p": 0.5}, {"t": null, "p": 0.2}, {"t": '), k + 1, F.lit(', "p": 0.25}]'))).otherwise("[broken")
    curve = P.curve_of(stored)
    return w.raw("supplier").select(
        "s_suppkey", P.is_wallet(address).alias("wallet"), F.unix_seconds(P.unix_timestamp_of(seconds)).alias("ts"),
        PR.complement(F.lit(None).cast("double"), (k % 64) / F.lit(64.0), F.when(k % 5 != 0, 2)).alias("other_price"),
        F.size(curve).alias("points"), F.get(curve, F.lit(0))["t"].cast("long").alias("first_t"))


C["kind_list"] = "SELECT * FROM (VALUES " + ",".join(f"('{k}','{t}','{n}')" for k, (t, n) in V.SPORTS_KINDS.items()) + ") v(market_type, tier, kind_label)"
_types = [*V.SPORTS_KINDS, "never_seen_before", ""]
entry("sports_kinds", "p_partkey:i tier:s kind_label:s", lambda w: w.raw("part").withColumn("t", choose(_types, F.col("p_partkey"))).select("p_partkey", *[c.alias(n) for n, c in SP.market_kind("t").items()]),
      f"SELECT p_partkey, coalesce(tier, 'EXOTIC') AS tier, coalesce(kind_label, CASE WHEN t = '' THEN 'Other' ELSE 'Never seen before' END) AS kind_label FROM (SELECT p_partkey, {pick(_types, 'p_partkey')} AS t FROM part) LEFT JOIN kind_list ON t = market_type")
entry("parse_functions", "s_suppkey:i wallet:b ts:i other_price:d points:i first_t:i", parsed, """SELECT s_suppkey, s_suppkey % 3 <> 2 AS wallet, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 100 END AS ts, CASE WHEN s_suppkey % 5 <> 0 THEN 1e0 - (s_suppkey % 64)/64e0 END AS other_price,
      CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 0 END AS points, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS first_t FROM supplier""")


# --- landed positions, settled rows, fills ------------------------------------------------------
def wire_activity(w: Workspace) -> DataFrame:
    a = w.activity
    return landed.activity(w.spark, land(w, a.select(
        F.concat(F.lit(" 0xAB"), "trader_id").alias("proxyWallet"), F.when(F.col("trader_id") % 19 != 3, F.col("ts")).otherwise(0).alias("timestamp"), F.concat(F.lit("c"), "market_id").alias("conditionId"),
        F.when(F.col("market_id") % 8 == 1, "BOGUS").otherwise("TRADE").alias("type"),
        F.when(F.col("trader_id") % 7 == 2, F.col("size") * 1e6 + 0.5).when(F.col("trader_id") % 7 == 4, F.col("size") / 16384.0).otherwise(F.col("size")).alias("size"), F.col("usd").alias("usdcSize"), "price", "asset", "side", F.col("outcome_index").alias("outcomeIndex"),
        F.when(F.col("trader_id") % 5 != 1, F.col("dedupe_key")).alias("transactionHash"))))


entry("normalize_activity", "dedupe_key:s wallet:s ts:i type:s side:s size:d usd:d", lambda w: normalize.normalize_activity(wire_activity(w)),
      """SELECT '0xab' || trader_id || ':' || CASE WHEN trader_id % 5 <> 1 THEN dedupe_key ELSE 'no-tx' END || ':t' || (market_id*10+outcome_index) || ':' || CASE WHEN market_id % 8 = 1 THEN 'OTHER' ELSE 'TRADE' END || ':' || side || ':' || ts || ':' || CASE WHEN trader_id % 7 = 2 THEN (size::BIGINT*1000000) || '.5' WHEN trader_id % 7 = 4 THEN rtrim(printf('%.14f', size/16384e0), '0') ELSE size::BIGINT::VARCHAR END AS dedupe_key, '0xab' || trader_id AS wallet, ts,
      CASE WHEN market_id % 8 = 1 THEN 'OTHER' ELSE 'TRADE' END AS type, side, CASE WHEN trader_id % 7 = 2 THEN size*1e6 + 0.5e0 WHEN trader_id % 7 = 4 THEN size/16384e0 ELSE size END AS size, usd FROM activity WHERE trader_id % 19 <> 3""")
entry("new_activity", "dedupe_key:s", lambda w: landed.new_activity(w.activity, w.activity.where("ts <= 950000000"), "trader_id", "ts"), "SELECT dedupe_key FROM activity a LEFT JOIN (SELECT trader_id, max(ts) AS mk2 FROM activity WHERE ts <= 950000000 GROUP BY 1) USING (trader_id) WHERE mk2 IS NULL OR ts >= mk2")


def new_activity_by_day(w: Workspace) -> DataFrame:
    """The same from a landing in folders by bucket and month, of which only those past the marks are read."""
    path = f"{run_folder(w.spark)}/activity-{uuid.uuid4().hex}"
    landed.store_activity(w.activity.select("trader_id", "ts", "dedupe_key"), path, "trader_id", "ts", 4, 30)
    marks = landed.high_water(w.activity, w.activity.where("ts <= 950000000"), "trader_id", "ts")
    return landed.activity_since(w.spark, path, marks, "trader_id", "ts", 4, 30)


entry("new_activity_by_day", "dedupe_key:s", new_activity_by_day, ENTRIES["new_activity"][2])


def wire_closed(w: Workspace) -> DataFrame:
    c = w.closed
    return landed.closed_positions(w.spark, land(w, c.select(
        F.concat(F.lit("0xAB"), "trader_id").alias("proxyWallet"), "asset", F.concat(F.lit("c"), "market_id").alias("conditionId"), F.col("avg_price").alias("avgPrice"), F.col("shares").alias("totalBought"), F.col("realized_pnl").alias("realizedPnl"),
        F.when(F.col("won"), 1.0).when(~F.col("won"), 0.0).otherwise(0.5).alias("curPrice"), F.col("outcome_index").alias("outcomeIndex"), F.col("resolved_ts").alias("timestamp"))))


entry("normalize_closed", "wallet:s asset:s outcome:s shares:d cost_basis_usd:d realized_pnl:d won:b resolved_ts:i", lambda w: normalize.normalize_closed(wire_closed(w)),
      "SELECT '0xab' || trader_id AS wallet, asset, CASE WHEN outcome_index = 0 THEN 'Yes' ELSE 'No' END AS outcome, shares, shares*avg_price AS cost_basis_usd, realized_pnl, won, resolved_ts FROM closed")


def wire_positions(w: Workspace) -> DataFrame:
    return landed.positions(w.spark, land(w, w.positions.select(F.concat(F.lit("0xAB"), "trader_id").alias("proxyWallet"), "asset", F.concat(F.lit("c"), "market_id").alias("conditionId"), F.when(F.col("trader_id") % 9 != 2, F.col("size")).alias("size"),
                              F.col("avg_price").alias("avgPrice"), F.col("current_value").alias("currentValue"), F.col("outcome_index").alias("outcomeIndex"))))


entry("normalize_positions", "wallet:s asset:s outcome:s size:d avg_price:d current_value:d redeemable:b", lambda w: normalize.normalize_positions(wire_positions(w)),
      "SELECT '0xab' || trader_id AS wallet, asset, CASE WHEN outcome_index = 0 THEN 'Yes' ELSE 'No' END AS outcome, size, avg_price, current_value, false AS redeemable FROM open_p WHERE trader_id % 9 <> 2")
entry("markets_by_ids", "conditionId:s copy:s", lambda w: landed.markets_by_ids(
    w.markets.where("market_id % 3 <> 0").select(F.col("condition_id").alias("conditionId"), F.lit("open").alias("copy")), w.markets.where("market_id % 2 = 0").select(F.col("condition_id").alias("conditionId"), F.lit("closed").alias("copy")),
    w.bets.select(F.concat(F.lit("c"), "market_id").alias("conditionId"))), "SELECT condition_id AS \"conditionId\", CASE WHEN market_id % 3 <> 0 THEN 'open' ELSE 'closed' END AS copy FROM market WHERE (market_id % 3 <> 0 OR market_id % 2 = 0) AND market_id IN (SELECT market_id FROM bets)")
entry("closed_markets", "market_id:i volume:d", lambda w: landed.closed_markets(w.markets, 900000000, AS_OF, 40), f"SELECT market_id, volume FROM market WHERE resolved AND end_ts BETWEEN 900000000 AND {AS_OF} ORDER BY volume DESC, market_id LIMIT 40")

# --- from landed files to the board ---------------------------------------------------------------
CATEGORY_TAGS = {"POLITICS": "Elections", "ECONOMICS": "Inflation", "SPORTS": "Tennis", "CRYPTO": "Bitcoin", "ENTERTAINMENT": "Oscars", "GEOPOLITICS": "Ceasefire"}


def board_from_landed(w: Workspace) -> DataFrame:
    """Every table of the workspace as its wire records, landed, normalized, scored and ranked under text ids."""
    m = w.markets
    iso = lambda ts: F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tag = F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORY_TAGS.items() for x in pair]), F.col("category"))
    tags = F.filter(F.array(tag, F.col("league")), lambda t: t.isNotNull())
    market = F.struct(
        F.col("condition_id").alias("conditionId"), F.concat(F.lit("q"), "market_id").alias("question"), F.lit('["Yes", "No"]').alias("outcomes"),
        F.to_json(F.transform("prices", lambda p: p.cast("string"))).alias("outcomePrices"), F.to_json("token_ids").alias("clobTokenIds"),
        F.col("liquidity").alias("liquidityNum"), F.col("volume").alias("volumeNum"), "spread", F.col("best_bid").alias("bestBid"), F.col("best_ask").alias("bestAsk"),
        "closed", F.col("accepting_orders").alias("acceptingOrders"), iso("end_ts").alias("endDate"), iso("kickoff_ts").alias("gameStartTime"),
        F.col("sports_market_type").alias("sportsMarketType"))
    # A market arrives twice; the second copy, on a later line, has the right prices.
    stale = market.withField("outcomePrices", F.lit('["0.5", "0.5"]'))
    events = m.select(F.col("event_id").cast("string").alias("id"), F.transform(tags, lambda t: F.struct(t.alias("label"))).alias("tags"), F.array(stale, market).alias("markets"))
    condition = F.concat(F.lit("c"), "market_id").alias("conditionId")
    wallet = F.concat(F.lit(" 0X"), F.lpad(F.col("trader_id").cast("string"), 40, "0")).alias("proxyWallet")
    positions = w.positions.select(wallet, "asset", condition, "size", F.col("avg_price").alias("avgPrice"), F.col("current_value").alias("currentValue"), F.col("cash_pnl").alias("cashPnl"), F.col("outcome_index").alias("outcomeIndex"))
    closed = w.closed.select(wallet, "asset", condition, F.col("avg_price").alias("avgPrice"), F.col("shares").alias("totalBought"), F.col("realized_pnl").alias("realizedPnl"),
                             F.when(F.col("won"), 1.0).when(~F.col("won"), 0.0).otherwise(0.5).alias("curPrice"), F.col("outcome_index").alias("outcomeIndex"), iso("end_ts").alias("endDate"), F.col("resolved_ts").alias("timestamp"))
    fills = w.activity.select(wallet, condition, "asset", "side", "size", "price", F.col("usd").alias("usdcSize"), F.col("ts").alias("timestamp"), F.lit("TRADE").alias("type"), F.col("outcome_index").alias("outcomeIndex"), F.col("dedupe_key").alias("transactionHash"))
    fills = fills.unionByName(fills.where(F.col("timestamp") % 3 == 0))
    leaders = w.traders.select(F.concat(F.lit("0X"), F.substring("wallet", 3, 40)).alias("proxyWallet"), F.col("display_name").alias("userName"))
    found = from_landed.board(landed.events(w.spark, land(w, events)), landed.positions(w.spark, land(w, positions)), landed.closed_positions(w.spark, land(w, closed)),
                              landed.activity(w.spark, land(w, fills)), landed.leaderboard(w.spark, land(w, leaders)), AS_OF)[1]
    # Ranks of equal scores follow the text of the id, so the score's own order is compared.
    return found.withColumn("better", F.col("rank") - F.row_number().over(W.partitionBy("opportunity").orderBy("rank")))


# Landed markets have no description here, so their clarity is that of unpublished criteria.
_landed_board = oracle("board_rank").replace("CASE WHEN m % 10 <> 7 THEN (m*13 % 101)::DOUBLE END AS clarity_score", "35e0 AS clarity_score")
entry("board_from_landed", "market_id:s outcome_index:i opportunity:d better:i", board_from_landed,
      f"SELECT 'c' || market_id AS market_id, outcome_index, opportunity, rank() OVER (ORDER BY opportunity DESC) - 1 AS better FROM ({_landed_board}) ranked")

# --- other landed files -------------------------------------------------------------------------
def landed_holders(w: Workspace) -> DataFrame:
    """Holder pages: one line per market, its holders nested."""
    one = F.struct(F.col("wallet").alias("proxyWallet"), F.col("size").alias("amount"), (F.col("ts") % 2 == 0).alias("displayUsernamePublic"), F.concat(F.lit("n"), "wallet").alias("name"))
    pages = w.tape.groupBy("market_id", F.col("ts") % 64).agg(F.collect_list(one).alias("holders"))
    return landed.holders(w.spark, land(w, pages.select(F.concat(F.lit("c"), "market_id").alias("conditionId"), F.lit("t").alias("token"), "holders")))


entry("landed_holders", "conditionId:s wallet:s shares:d name:s", landed_holders, "SELECT 'c' || market_id AS \"conditionId\", wallet, size AS shares, CASE WHEN ts % 2 = 0 THEN 'n' || wallet END AS name FROM tape")
entry("landed_trades", "conditionId:s proxyWallet:s size:d timestamp:i", lambda w: landed.trades(w.spark, land(w, w.tape.select(F.col("wallet").alias("proxyWallet"), F.concat(F.lit("c"), "market_id").alias("conditionId"), "size", "price", F.col("ts").alias("timestamp"), (F.col("ts") % 3 != 0).alias("taker"))), taker_only=True),
      "SELECT 'c' || market_id AS \"conditionId\", wallet AS \"proxyWallet\", size, ts AS timestamp FROM tape WHERE ts % 3 <> 0")


def landed_curves(w: Workspace) -> DataFrame:
    points = F.collect_list(F.struct("t", F.when(F.col("seq") % 9 != 0, F.col("p")).alias("p")))
    days = w.curves.groupBy("market_id", "outcome_index", F.floor(F.col("t") / 8640000).alias("d")).agg(points.alias("history"))
    return landed.price_history(w.spark, land(w, days.select(F.concat(F.lit("t"), F.col("market_id") * 10 + F.col("outcome_index")).alias("token"), "history")))


entry("landed_curves", "token_id:s t:i p:d", landed_curves, "SELECT 't' || (market_id*10+outcome_index) AS token_id, t, p FROM curve WHERE seq % 9 <> 0")


def landed_books(w: Workspace) -> DataFrame:
    level = F.struct(F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"))
    rows = w.book.groupBy("token_id").agg(F.collect_list(F.when(F.col("kind") == "BID", level)).alias("bids"), F.collect_list(F.when(F.col("kind") == "ASK", level)).alias("asks"))
    return landed.books(w.spark, land(w, rows.select(F.col("token_id").alias("asset_id"), "bids", "asks")))


entry("landed_books", "token_id:s kind:s price:d size:d", landed_books, "SELECT * FROM book")
entry("landed_portfolios", "wallet:s portfolio_value:d traded_markets:i", lambda w: landed.portfolios(w.spark, land(w, w.portfolio.select(F.concat(F.lit("0xAB"), "trader_id").alias("user"), F.array(F.struct(F.col("portfolio_value").alias("value"))).alias("value"), F.col("trader_id").alias("traded")))),
      "SELECT '0xab' || trader_id AS wallet, portfolio_value, trader_id AS traded_markets FROM portfolio")
entry("landed_leaderboard", "wallet:s pnl:d", lambda w: landed.leaderboard(w.spark, land(w, w.raw("supplier").select(F.concat(F.lit("0x"), "s_suppkey").alias("proxyWallet"), F.col("s_acctbal").alias("pnl")))), "SELECT '0x' || s_suppkey AS wallet, s_acctbal AS pnl FROM supplier")
entry("landed_closed_capped", "proxyWallet:s asset:s", lambda w: landed.closed_positions(w.spark, land(w, w.closed.select(F.concat(F.lit("0x"), "trader_id").alias("proxyWallet"), "asset", F.col("resolved_ts").alias("timestamp"))), per_wallet=15),
      "SELECT '0x' || trader_id AS \"proxyWallet\", asset FROM (SELECT *, row_number() OVER (PARTITION BY trader_id ORDER BY resolved_ts DESC NULLS LAST, asset) AS rn FROM closed) WHERE rn <= 15")

# --- sinks --------------------------------------------------------------------------------------
_old = lambda w: w.markets.where("market_id % 5 <> 0").withColumns({"liquidity": F.col("liquidity") * (1.0 + (F.col("market_id") % 3 - 1) / F.lit(16.0)), "prices": F.transform("prices", lambda p: p + (F.col("market_id") % 4) / F.lit(512.0)), "resolved": F.col("resolved") & (F.col("market_id") % 8 != 0)})
C["old_market"] = "SELECT market_id, liquidity*(1e0+(market_id % 3 - 1)/16e0) AS liquidity, (market_id % 4)/512e0 AS shift, resolved AND market_id % 8 <> 0 AS resolved FROM market WHERE market_id % 5 <> 0"
entry("upsert", "market_id:i liquidity:d", lambda w: sinks.upsert(_old(w), w.markets.where("market_id % 3 = 0"), ["market_id"]), "SELECT market_id, liquidity FROM market WHERE market_id % 3 = 0 UNION ALL SELECT market_id, liquidity FROM old_market WHERE market_id % 3 <> 0")
entry("insert_ignore", "dedupe_key:s", lambda w: sinks.insert_ignore(w.activity.where("trader_id % 2 = 0"), w.activity.unionByName(w.activity.where("trader_id % 7 = 1")), ["dedupe_key"]), "SELECT DISTINCT dedupe_key FROM activity WHERE trader_id % 2 <> 0")
entry("changed_rows", "market_id:i", lambda w: sinks.changed_rows(_old(w), w.markets, ["market_id"], ["liquidity", "prices", "resolved", "winner"]),
      "SELECT m.market_id FROM market m LEFT JOIN old_market o USING (market_id) WHERE o.market_id IS NULL OR m.liquidity IS DISTINCT FROM o.liquidity OR o.shift <> 0 OR m.resolved <> o.resolved")
entry("replace_all", "market_id:i", lambda w: sinks.replace_all(_old(w), w.markets.where("market_id % 7 <> 0"), ["market_id"]), "SELECT market_id FROM old_market WHERE market_id % 7 <> 0")
_last = lambda w: w.markets.where("market_id % 9 <> 4").select("market_id", (F.lit(AS_OF) - F.col("market_id") * 173).alias("captured_ts"))
entry("market_snapshots", "market_id:i snapshot_reason:s", lambda w: sinks.market_snapshots(_old(w), w.markets, _last(w), AS_OF),
      """SELECT * FROM (SELECT m.market_id, CASE WHEN o.market_id IS NULL OR m.market_id % 9 = 4 THEN 'FIRST' WHEN m.market_id*173 > 21600 THEN 'AGE' WHEN o.shift >= 0.005e0 THEN 'PRICE' WHEN abs(m.liquidity-o.liquidity)/o.liquidity >= 0.05e0 THEN 'LIQUIDITY' WHEN m.resolved AND NOT o.resolved THEN 'RESOLVED' END AS snapshot_reason
      FROM market m LEFT JOIN old_market o USING (market_id)) WHERE snapshot_reason IS NOT NULL""")
_k3 = ["trader_id", "market_id", "outcome_index"]
entry("position_snapshots", "trader_id:i market_id:i outcome_index:i", lambda w: sinks.position_snapshots(w.positions, w.positions.where("market_id % 10 <> 3").select(*_k3, (F.col("size") * (1.0 + (F.col("trader_id") % 5) / F.lit(128.0))).alias("size"), (F.lit(AS_OF) - F.col("market_id") * 120).alias("captured_ts")), _k3, AS_OF),
      "SELECT trader_id, market_id, outcome_index FROM open_p WHERE market_id % 10 = 3 OR market_id*120 > 21600 OR (size*(1e0+(trader_id % 5)/128e0) - size)/(size*(1e0+(trader_id % 5)/128e0)) >= 0.02e0")
entry("trader_snapshots", "trader_id:i open_positions:i unrealized_pnl:d realized_pnl:d portfolio_value:d", lambda w: sinks.trader_snapshots(w.positions, w.closed, w.portfolio, AS_OF),
      "SELECT trader_id, coalesce(n,0) AS open_positions, u AS unrealized_pnl, r AS realized_pnl, v AS portfolio_value FROM (SELECT trader_id, count(*) AS n, sum(cash_pnl) AS u, sum(current_value) AS v FROM open_p GROUP BY 1) FULL JOIN (SELECT trader_id, sum(realized_pnl) AS r FROM closed GROUP BY 1) USING (trader_id)")
entry("close_vanished", "trader_id:i asset:s size:d is_open:b", lambda w: sinks.close_vanished(w.positions, w.positions.where("market_id % 6 <> 1"), ["trader_id", "asset"]), "SELECT trader_id, asset, 0e0 AS size, false AS is_open FROM open_p WHERE market_id % 6 = 1")
entry("resolution_stamp", "market_id:i resolved_ts:i", lambda w: sinks.resolution_stamp(w.markets, w.markets.where("market_id % 4 <> 0"), AS_OF), f"SELECT market_id, CASE WHEN resolved AND market_id % 4 = 0 THEN least(coalesce(end_ts, {AS_OF}), {AS_OF}) WHEN market_id % 4 <> 0 THEN resolved_ts END AS resolved_ts FROM market")


# The same writes on tables kept in buckets: each takes a first pass and one that changes part of it.
def kept(w: Workspace, rows: DataFrame, *keys: str) -> stored.Stored:
    """A stored table that holds ``rows``."""
    table = stored.Stored(f"{run_folder(w.spark)}/stored-{uuid.uuid4().hex}", rows.schema, keys, 16)
    stored.upsert(table, rows)
    return table


def stored_upsert(w: Workspace) -> DataFrame:
    table = kept(w, _old(w), "market_id")
    stored.upsert(table, w.markets.where("market_id % 3 = 0"))
    return stored.read(w.spark, table)


def stored_insert(w: Workspace) -> DataFrame:
    """The fills that insert-ignore added to those of even traders."""
    fills = w.activity.select("dedupe_key", "trader_id", "usd")
    table = kept(w, fills.where("trader_id % 2 = 0"), "dedupe_key")
    stored.insert_ignore(table, fills.unionByName(fills.where("trader_id % 7 = 1")))
    return stored.read(w.spark, table).where("trader_id % 2 <> 0")


def stored_changes(w: Workspace) -> DataFrame:
    """Markets after a pass that writes what differs in liquidity, and what that is."""
    table = kept(w, _old(w).select("market_id", "liquidity", F.lit("old").alias("written")), "market_id")
    stored.upsert(table, w.markets.select("market_id", "liquidity", F.lit("new").alias("written")), ["liquidity"])
    return stored.read(w.spark, table)


def stored_retain(w: Workspace) -> DataFrame:
    table = kept(w, _old(w), "market_id")
    stored.retain(table, w.markets.where("market_id % 7 <> 0"))
    return stored.read(w.spark, table)


def stored_vanished(w: Workspace) -> DataFrame:
    """Stored open positions of which a sixth is gone: all rows, the gone ones closed."""
    rows = w.positions.select("trader_id", "asset", "size", F.lit(True).alias("is_open"))
    table = kept(w, rows, "trader_id", "asset")
    stored.close_vanished(table, w.positions.where("market_id % 6 <> 1"))
    return stored.read(w.spark, table)


entry("stored_upsert", "market_id:i liquidity:d", stored_upsert, ENTRIES["upsert"][2])
entry("stored_insert", "dedupe_key:s", stored_insert, ENTRIES["insert_ignore"][2])
entry("stored_changes", "market_id:i liquidity:d written:s", stored_changes,
      """SELECT m.market_id, m.liquidity, CASE WHEN o.market_id IS NULL OR m.liquidity IS DISTINCT FROM o.liquidity
      THEN 'new' ELSE 'old' END AS written FROM market m LEFT JOIN old_market o USING (market_id)""")
entry("stored_retain", "market_id:i", stored_retain, ENTRIES["replace_all"][2])
entry("stored_vanished", "trader_id:i asset:s size:d is_open:b", stored_vanished,
      """SELECT trader_id, asset, CASE WHEN market_id % 6 = 1 THEN 0e0 ELSE size END AS size, market_id % 6 <> 1 AS is_open
      FROM open_p""")


def stored_runs(w: Workspace, delete: str | None = None) -> DataFrame:
    """Three stored runs of different size, less one that is deleted."""
    path = f"{run_folder(w.spark)}/runs-{uuid.uuid4().hex}"
    for run_id, kind, at, days in (("r1", "single", 100, 1), ("r2", "single", 200, 2), ("r3", "sweep", 150, 14)):
        sinks.store_run(w.signals.where(F.col("horizon_days") <= days), run_id, kind, at, path)
    if delete:
        sinks.delete_run(w.spark, path, delete)
    return w.spark.read.parquet(path)


C["stored_run"] = "SELECT * FROM signal s JOIN (VALUES ('r1','single',100,1),('r2','single',200,2),('r3','sweep',150,14)) r(run_id, kind, created_ts, days) ON s.horizon_days <= r.days"
entry("list_runs", "run_id:s kind:s created_ts:i signals:i", lambda w: sinks.list_runs(stored_runs(w)), "SELECT run_id, kind, created_ts, count(*) AS signals FROM stored_run GROUP BY ALL")
entry("latest_runs", "kind:s run_id:s", lambda w: sinks.latest_runs(stored_runs(w)), "SELECT kind, arg_max(run_id, created_ts) AS run_id FROM stored_run GROUP BY 1")
entry("delete_run", "run_id:s horizon_days:i market_id:i outcome_index:i", lambda w: stored_runs(w, "r2"), "SELECT run_id, horizon_days, market_id, outcome_index FROM stored_run WHERE run_id <> 'r2'")


# --- streams ------------------------------------------------------------------------------------
LATE = 6 * 3600
SLICES = 6


def landed_stream(w: Workspace, heartbeat: bool = False) -> tuple[DataFrame, str]:
    """All fills as landed files in time order, a slice of the time a trigger. Fills of a slice's last hours come
    again with the next one. A heartbeat, if asked for, is a fill without a market after all others."""
    base = f"{run_folder(w.spark)}/stream-{uuid.uuid4().hex}"
    typed = [F.col(c.split()[0]).cast(c.split()[1]) for c in schemas.FILLS.replace("\n", " ").split(", ")]
    fills = w.activity.withColumn("dedupe_key", F.concat_ws(":", "dedupe_key", "ts"))
    at = fills.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    width = -(-(at["high"] - at["low"] + 1) // SLICES)
    placed = fills.withColumn("slice", F.floor((F.col("ts") - at["low"]) / F.lit(width)))
    ending = F.lit(at["low"]) + (F.col("slice") + 1) * F.lit(width) - F.col("ts")
    again = placed.where(ending < F.lit(LATE // 2)).withColumn("slice", F.col("slice") + 1).where(F.col("slice") < SLICES)
    staged = cut_lineage(placed.unionByName(again))
    with without_leftovers(w.spark):
        for k in range(SLICES):  # later files are newer, so the stream reads them later
            staged.where(F.col("slice") == k).select(*typed).repartition(2).write.option("compression", "zstd").mode("append").parquet(f"{base}/in")
    if heartbeat:
        beat = staged.limit(1).withColumns({"ts": F.lit(at["high"] + 2 * LATE + 2 * 86400), "dedupe_key": F.lit("heartbeat"),
                                            "market_id": F.lit(None).cast("long")})
        beat.select(*typed).write.mode("append").parquet(f"{base}/in")
    release(staged)
    return streams.landed_fills(w.spark, f"{base}/in", 2), base


def stream_dedupe(w: Workspace) -> DataFrame:
    fills, base = landed_stream(w)
    streams.append_to(streams.deduped(fills, f"{LATE} seconds"), f"{base}/out", f"{base}/cp").awaitTermination()
    return w.spark.read.parquet(f"{base}/out")


def stream_windows(w: Workspace, length: str, slide: str | None) -> DataFrame:
    """Windows as append mode emits them: all, since the heartbeat takes the watermark past the last one."""
    fills, base = landed_stream(w, heartbeat=True)
    once = streams.deduped(fills, f"{LATE} seconds")
    streams.append_to(streams.tape_windows(once, length, slide, None), f"{base}/out", f"{base}/cp").awaitTermination()
    return w.spark.read.parquet(f"{base}/out").where("market_id is not null")


def stream_all_windows(w: Workspace, length: str, slide: str | None) -> DataFrame:
    """All windows, those that the watermark has not passed included."""
    fills, base = landed_stream(w)
    streams.store_windows(fills, f"{base}/windows", f"{base}/cp", LATE, length, slide).awaitTermination()
    return streams.windows(w.spark, f"{base}/windows")


def stream_positions(w: Workspace) -> DataFrame:
    fills, base = landed_stream(w)
    streams.store_positions(fills, f"{base}/state", f"{base}/cp", LATE).awaitTermination()
    return streams.positions(w.spark, f"{base}/state")


_tape = """SELECT market_id, outcome_index, window_start, count(*) AS fills, sum(size*price) AS usd
 FROM (SELECT *, unnest({starts}) AS window_start FROM activity) GROUP BY 1,2,3"""
_daily = _tape.format(starts="[ts // 86400 * 86400]")
_hourly = _tape.format(starts="list_transform(range(0, 12), lambda k: (ts // 300 - k) * 300)")
_columns = "market_id:i outcome_index:i window_start:i fills:i usd:d"
entry("stream_dedupe", "dedupe_key:s", stream_dedupe, "SELECT DISTINCT dedupe_key || ':' || ts AS dedupe_key FROM activity")
entry("stream_tape_windows", _columns, lambda w: stream_windows(w, "1 day", None), _daily)
entry("stream_tape_sliding", _columns, lambda w: stream_windows(w, "1 hour", "5 minutes"), _hourly)
entry("stream_tape_windows_all", _columns, lambda w: stream_all_windows(w, "1 day", None), _daily)
entry("stream_tape_sliding_all", _columns, lambda w: stream_all_windows(w, "1 hour", "5 minutes"), _hourly)
C["fold_all"] = C["fold"].replace("q.market_id, q.signal_ts, a.trader_id", "a.market_id, a.trader_id").replace("FROM asked q JOIN activity a ON a.market_id = q.market_id AND a.ts <= q.signal_ts GROUP BY 1,2,3,4", "FROM activity a GROUP BY 1,2,3").replace("FILTER (WHERE a.ts >= q.signal_ts - 86400)", "")
entry("stream_positions", "trader_id:i market_id:i outcome_index:i shares:d cost_usd:d first_buy_ts:i", stream_positions, "SELECT trader_id, market_id, outcome_index, st.s AS shares, st.c AS cost_usd, first_buy_ts FROM fold_all")
