"""Small literal cases of the rules, and invariants that must hold on any data."""

import glob
import math
import os
import random
import re
import time
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.config import DEFAULTS, merge_config
from tidemark.functions import numeric as N
from tidemark.functions import parse as P
from tidemark.functions import pricing as PR
from tidemark.functions import sports as SP
from tidemark.functions import stats as ST
from tidemark.functions import text as TX
from tidemark.operators import allocation, behaviour, board, books, holders, prefix, replay, traders
from tidemark.operators.asof import Pick, asof_each, asof_last
from tidemark.plans import evaluation
from tidemark.session import among, cut_lineage
from tidemark.sources import normalize
from tidemark.streaming import fills as streams

FILL = "trader_id long, market_id long, outcome_index int, side string, size double, price double, usd double, ts long, dedupe_key string"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def fills(spark, rows):
    return spark.createDataFrame([(1, 1, 0, side, float(size), usd / size, float(usd), ts, f"k{i:04d}")
                                  for i, (side, size, usd, ts) in enumerate(rows)], FILL)


def test_rounding_and_nulls(spark):
    row = one(spark, N.half_up(F.lit(-2.5)), N.half_up(F.lit(2.45), 1), N.finite(F.lit("Infinity")),
              N.finite(F.lit("")), N.clamp_score(F.lit(None)), N.scale_to_score(F.lit(7.0), 3.0, 3.0),
              N.safe_divide(F.lit(1.0), F.lit(0.0)))
    assert list(row) == [-2.0, 2.5, None, None, 0.0, 50.0, None]


def test_parsing(spark):
    row = one(spark, P.json_numbers(F.lit('["0.5", "x", "1"]')), P.json_strings(F.lit("nope")),
              N.epoch(P.kickoff_of(F.lit("2026-09-13 17:00:00+00"))), N.epoch(P.kickoff_of(F.lit("2026-09-13 17:00:00"))),
              P.slug_of(F.lit("  Fed Rates!! 2026 ")), P.is_wallet(F.lit("0x" + "aB" * 20)),
              P.league_of(F.array(F.lit("esports"), F.lit("league-of-legends"))),
              P.resolved_outcome(F.array(F.lit(0.0), F.lit(1.0)), F.lit(True)),
              P.resolved_outcome(F.array(F.lit(1.0), F.lit(1.0)), F.lit(True)), P.won_of(F.lit(0.5)))
    assert list(row) == [[0.5, 1.0], [], 1789318800, 1789318800, "fed-rates-2026", True,
                         "league-of-legends", 1, None, None]


def test_prices(spark):
    q = PR.quotes(F.lit(1), F.lit(0.30), F.lit(0.34))
    gap = PR.entry_gap(F.lit(0.32), F.lit(0.30), DEFAULTS)
    row = one(spark, q["bid"], q["ask"], PR.effective_price(F.lit(0.5), F.lit(None), F.lit(0.02), 0.01),
              PR.effective_price(F.lit(0.999), F.lit(None), F.lit(None), 0.01),
              PR.payout(F.lit(10.0), F.lit(0.25))["profit"], PR.payout(F.lit(1.0), F.lit(0.0))["invalid_reason"],
              gap["entry_quality"], gap["entry_score"], PR.clv_points(F.lit(0.4), F.lit(0.45)))
    assert row[0] == pytest.approx(0.66) and row[1] == pytest.approx(0.70)
    assert row[2] == pytest.approx(0.5151) and row[3] is None
    assert row[4] == 30.0 and row[5] == "PRICE_TOO_LOW"
    assert row[6] == "GOOD" and row[7] == pytest.approx(91.5) and row[8] == pytest.approx(5.0)


def test_model_moves_both_ways(spark):
    up = PR.model_estimate(F.lit(0.4), F.lit(80.0), F.lit(6), DEFAULTS)["model_mid"]
    down = PR.model_estimate(F.lit(0.4), F.lit(20.0), F.lit(6), DEFAULTS)["model_mid"]
    none = PR.model_estimate(F.lit(0.4), F.lit(80.0), F.lit(0), DEFAULTS)["model_mid"]
    row = one(spark, up, down, none)
    assert row[0] == pytest.approx(0.52) and row[1] == pytest.approx(0.28) and row[2] is None


def test_sports(spark):
    kind, odd = SP.market_kind(F.lit("q2_totals")), SP.market_kind(F.lit("team_offensive_yards"))
    row = one(spark, kind["tier"], kind["kind_label"], odd["kind_label"], SP.phase(F.lit(-1.0), F.lit("ufc"), DEFAULTS),
              SP.phase(F.lit(-2.0), F.lit("ufc"), DEFAULTS), SP.tradeability(F.lit(None), F.lit(None))["untradeable_reason"],
              SP.line_verdict(F.lit(0.5), F.lit(0.55), F.lit(0), F.lit(2), DEFAULTS)["line_verdict"])
    assert list(row) == ["EXOTIC", "2Q total", "Team offensive yards", "IN_PLAY", "ENDED", "NOTHING_REPORTED", "CAPITULATING"]


def test_text(spark):
    c = TX.resolution_clarity(F.lit("Resolves at the sole discretion of the referee."), F.lit(None))
    row = one(spark, c["clarity_score"], c["clarity_flags"], TX.quoted_line(F.lit("Spread: Bills (-1.5)")),
              TX.spread_team(F.lit("Spread: Bills (-1.5)")), TX.quoted_line(F.lit("Jets vs Bills: 1H O/U 22.5")))
    assert row[0] == 30.0 and row[1] == ["VERY_SHORT", "DISCRETION"]
    assert list(row)[2:] == [-1.5, "Bills", 22.5]


def test_categories(spark):
    rows = [(1, ["Politics", "Crypto Prices"], "q"), (2, [], "Will Bitcoin exceed a level"), (3, ["Gardening"], "Roses"), (4, [], "Roses")]
    df = spark.createDataFrame(rows, "id int, tags array<string>, q string")
    found = {r.id: r.category for r in TX.resolve_category(df, "tags", "q").collect()}
    assert found == {1: "CRYPTO", 2: "CRYPTO", 3: "OTHER", 4: "UNKNOWN"}


def test_draws_equal_the_sequential_generator(spark):
    state, expected = 20260910, []
    for _ in range(500):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        expected.append((t ^ (t >> 14)) / 4294967296)
    got = [r[0] for r in spark.range(500).select(ST.uniform_draw(20260910, "id")).collect()]
    assert got == expected


def test_wilson(spark):
    i = ST.wilson(F.lit(8), F.lit(10))
    row = one(spark, i["low"], i["high"], ST.wilson(F.lit(0), F.lit(0))["low"])
    assert row[0] == pytest.approx(0.4902, abs=1e-4) and row[1] == pytest.approx(0.9433, abs=1e-4) and row[2] is None


def test_config_merge():
    merged = merge_config({"trader": {"hhi_points": 9, "bot_points": None}})
    assert merged["trader"]["hhi_points"] == 9 and merged["trader"]["bot_points"] == 8
    assert merge_config("not a dict") == DEFAULTS


def fifo(rows):
    lots, held = [], []
    for side, _, usd, ts in sorted(rows, key=lambda r: r[3]):
        if side == "BUY":
            lots.append([ts, usd])
            continue
        while usd > 0 and lots:
            part = min(lots[0][1], usd)
            held.append(ts - lots[0][0])
            lots[0][1] -= part
            usd -= part
            if lots[0][1] <= 0:
                lots.pop(0)
    return sorted(held)


def test_fifo_matches_the_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["BUY", "SELL"]), 1, rng.randint(1, 9), 100 * i) for i in range(200)]
    got = sorted(r.hold_seconds for r in behaviour.fifo_lots(fills(spark, rows)).collect())
    assert got == fifo(rows)


def test_replay_matches_the_loop(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["BUY", "BUY", "SELL"]), rng.randint(1, 20), rng.randint(1, 9), 40000 * i) for i in range(120)]
    asked = [40000 * i + 5 for i in (3, 40, 41, 80, 119)]
    queries = spark.createDataFrame([(1, t) for t in asked], "market_id long, signal_ts long")
    got = {r.signal_ts: (r.shares, r.cost_usd) for r in replay.replay_positions(fills(spark, rows), queries, -1, -1).collect()}
    for t in asked:
        shares = cost = 0.0
        for side, size, usd, ts in rows:
            if ts > t:
                break
            if side == "BUY":
                shares, cost = shares + size, cost + usd
            else:
                cost *= 1 - (min(1, size / shares) if shares > 0 else 1)
                shares = max(0.0, shares - size)
        assert got[t] == (pytest.approx(shares), pytest.approx(cost))


def test_replay_ignores_what_comes_later(spark):
    rows = [("BUY", 100, 30, 1000), ("BUY", 50, 20, 2000)]
    later = [*rows, ("SELL", 120, 90, 9000)]
    queries = spark.createDataFrame([(1, 5000)], "market_id long, signal_ts long")
    a, b = (replay.replay_positions(fills(spark, r), queries).collect() for r in (rows, later))
    assert a == b and a[0].shares == 150.0


def test_prefix_operators_match_pandas(spark):
    rng = random.Random(3)
    data = [(k, rng.randint(0, 50), i, float(rng.randint(-9, 9))) for k in (1, 1, 1, 2) for i in range(300)]
    data = [(k, t, n, v) for n, (k, t, _, v) in enumerate(data)]
    df = spark.createDataFrame(data, "k int, t int, n int, v double")
    pdf = pd.DataFrame(data, columns=["k", "t", "n", "v"]).sort_values(["k", "t", "n"])
    run = prefix.running(df, ["k"], F.floor(F.col("t") / 7), ["t", "n"], sums={"s": F.col("v")}, index="i", large=400)
    got = run.toPandas().sort_values(["k", "t", "n"])
    assert got["s"].tolist() == pdf.groupby("k")["v"].cumsum().tolist()
    assert got["i"].tolist() == pdf.groupby("k").cumcount().tolist()
    low = prefix.running_extreme(df, ["k"], F.floor(F.col("t") / 7), ["t", "n"], "m", F.col("v"), largest=False, large=400)
    assert low.toPandas().sort_values(["k", "t", "n"])["m"].tolist() == pdf.groupby("k")["v"].cummin().tolist()
    median = prefix.exact_median(df.withColumn("v", F.col("v").cast("long")), ["k"], "v", "med", width=4)
    assert {r.k: r.med for r in median.collect()} == pdf.groupby("k")["v"].median().to_dict()
    newest = prefix.latest_n(df, ["k"], [F.desc("t"), F.asc("n")], 40, ["n"])
    want = pdf.sort_values(["k", "t", "n"], ascending=[True, False, True]).groupby("k").head(40)
    assert sorted(r.n for r in newest.collect()) == sorted(want["n"])


@pytest.mark.parametrize("large", [1, 150, 1 << 20])
def test_one_scan_keeps_all_states_of_all_keys(spark, large):
    rng = random.Random(9)
    data = [(rng.choice([None, 1, 2]), rng.choice([None, "", "b"]), rng.choice([None, *range(60)]), n,
             float(rng.randint(-9, 9)), rng.choice([None, 1, 2, 3])) for n in range(900)]
    df = spark.createDataFrame(data, "k long, g string, t int, n int, v double, w int").repartition(5)
    order = ["t", "n"]
    kept = prefix.scan(df, ["k", "g"], F.floor(F.col("t") / 7), order, prefix.total("s", F.col("v")), prefix.lowest("net", "low", F.col("v")),
                       prefix.extreme("top", F.col("w"), True), prefix.latest("seen", F.col("w")), prefix.place("i"), large=large, keep=True)
    out = prefix.affine(kept, order, F.when(F.col("v") > 0, F.lit(0.5)).otherwise(0.0), F.col("v"), "x").collect()
    assert len(out) == len(data) and set(out[0].asDict()) == {"k", "g", "t", "n", "v", "w", "s", "net", "low", "top", "seen", "i", "x"}
    by = {}
    for r in data:
        by.setdefault(r[:2], []).append(r)
    got = {r["n"]: r for r in out}
    for rows in by.values():
        s, low, top, seen, x = 0.0, math.inf, None, None, 0.0
        for i, (_, _, t, n, v, w) in enumerate(sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3]))):
            s, x = s + v, (0.5 if v > 0 else 0.0) * x + v
            low, top, seen = min(low, s), max((y for y in (top, w) if y is not None), default=None), seen if w is None else w
            r = got[n]
            assert (r["s"], r["net"], r["low"], r["top"], r["seen"], r["i"]) == (s, s, low, top, seen, i) and abs(r["x"] - x) < 1e-9


def test_thinning_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, t, 0) for t in range(50)] + [(1, t, 0) for t in range(5)], "k long, t long, n int")
    kept = prefix.thin(df, ["k"], F.floor(F.col("t") / 10), ["t", "n"], 10).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in kept} == {None: 11, 1: 5}


def test_asof_is_at_or_before(spark):
    left = spark.createDataFrame([(1, 10), (1, 99999), (1, 500000), (2, 5)], "k int, t long")
    right = spark.createDataFrame([(1, 10, 0.1), (1, 90000, 0.2), (1, 600000, 0.9)], "k int, u long, p double")
    got = {(r.k, r.t): r.p for r in asof_last(left, right, ["k"], "t", "u", {"p": "p"}).collect()}
    assert got == {(1, 10): 0.1, (1, 99999): 0.2, (1, 500000): 0.2, (2, 5): None}


def test_asof_of_several_tables_at_once(spark):
    draw = random.Random(3)
    times = [None, *range(0, 400, 7)]
    one = [(draw.choice([1, 1, 1, 2, None]), draw.choice(times), i, draw.random()) for i in range(300)]
    other = [(draw.choice([1, 2, 3]), draw.choice(times), draw.choice(["a", "b", None])) for _ in range(80)]
    asked = [(k, t) for k in (1, 2, 3, 4, None) for t in (-1, 0, 49, 50, 51, 180, 399, 5000, None)] * 2
    got = asof_each(spark.createDataFrame(asked, "k int, t long"), ["k"], "t", [
        (spark.createDataFrame(one, "k int, at long, seq int, p double"), "at",
         [Pick({"p": "p", "p_at": "at"}, ["seq"]), Pick({"seq": "seq"}, ["seq"], F.col("p") > 0.8)]),
        (spark.createDataFrame(other, "k int, since long, name string"), "since", [Pick({"name": "name"})])], bucket_seconds=50).collect()

    def plain(rows, k, t, order):
        before = [r for r in rows if None not in (k, t, r[1]) and r[0] == k and r[1] <= t]
        return max(before, key=order, default=None)

    want = []
    for k, t in asked:
        p = plain(one, k, t, lambda r: r[1:3])
        high = plain([r for r in one if r[3] > 0.8], k, t, lambda r: r[1:3])
        name = plain(other, k, t, lambda r: (r[1], r[2] or ""))
        want.append((k, t, p and p[3], p and p[1], high and high[2], name and name[2]))
    assert Counter(map(tuple, got)) == Counter(want) and len({r["seq"] for r in got}) > 4


HOLDER = "market_id long, outcome_index int, trader_id long, wallet string, smart_score double, size_usd double, avg_price double, opened_ts long"


def test_opposing_counts_a_wallet_once(spark):
    rows = [(1, 0, 1, "a", 70.0, 10.0, 0.5, 0), (1, 1, 2, "b", 80.0, 5.0, 0.5, 0), (1, 2, 2, "b", 80.0, 9.0, 0.5, 0), (1, 2, 3, "c", 10.0, 1.0, 0.5, 0)]
    df = spark.createDataFrame(rows, HOLDER)
    got = {r.outcome_index: (r.opposing_count, r.qualified_opposing_count, r.opposing_exposure_usd)
           for r in holders.opposing_totals(df, ["market_id"], 60.0).collect()}
    assert got == {0: (2, 1, 10.0), 1: (3, 2, 20.0), 2: (2, 2, 15.0)}


@pytest.mark.parametrize("count", [2, 3, 4, 5, 12])
def test_clusters_match_the_pairwise_count(spark, count):
    rng = random.Random(count)
    rows = [(1, 0, i, f"w{i}", 70.0, 1.0, 0.3 + rng.random() / 60, 7000 + rng.randint(0, 9000)) for i in range(count)]
    got = holders.entry_clusters(spark.createDataFrame(rows, HOLDER), ["market_id"]).first()
    dated = sorted((r[7], r[2], r[6]) for r in rows)
    best = max(1 + sum(1 for b in dated[i + 1:] if b[0] - a[0] <= 7200 and abs(b[2] - a[2]) <= 0.01) for i, a in enumerate(dated))
    assert got.largest_cluster == best


@pytest.mark.parametrize("large", [20, 1 << 20])
def test_clusters_of_crowded_seconds_and_cents(spark, large):
    rng = random.Random(large)
    rows = [(rng.randint(1, 2), 0, i, f"w{i}", 70.0, 1.0, 0.3 + rng.randint(0, 40) / 1000, rng.choice([0, 7199, 7200, 7201, 14400, rng.randint(0, 20000)]))
            for i in range(300)] + [(1, 0, 900, "x", 1.0, 1.0, None, 5), (1, 0, 901, "y", 1.0, 1.0, 0.3, None)]
    got = {r.market_id: r.largest_cluster for r in holders.entry_clusters(spark.createDataFrame(rows, HOLDER), ["market_id"], large=large).collect()}
    want = {}
    for m in (1, 2):
        dated = sorted((r[7], r[6]) for r in rows if r[0] == m and r[6] is not None and r[7] is not None)
        for a in set(dated):
            n = sum(b[0] - a[0] <= 7200 and abs(b[1] - a[1]) <= 0.01 for b in dated if b >= a)
            want[m] = max(want.get(m, 0), n)
    assert got == want


def test_a_crowded_stretch_takes_no_pairs(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("market_id"), F.lit(0).alias("outcome_index"),
                               (F.lit(0.3) + F.col("id") * 0.4 / n).alias("avg_price"), (F.col("id") * 7919 % 7200).alias("opened_ts"))
    got = holders.entry_clusters(df, ["market_id"]).first().largest_cluster
    pdf = df.toPandas()
    t, p = pdf["opened_ts"].to_numpy(), pdf["avg_price"].to_numpy()
    best = 0
    for i in (t < 60).nonzero()[0]:  # the first minute meets the most
        later = (t > t[i]) | ((t == t[i]) & (p >= p[i]))
        best = max(best, int((later & (abs(p - p[i]) <= 0.01)).sum()))
    assert got == best


def test_average_ranks_of_many_values_come_range_by_range(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1]), rng.choice([None, float("nan"), round(rng.uniform(-5, 5), 2)])) for _ in range(900)]
    got = prefix.average_rank(spark.createDataFrame(rows, "k long, v double"), "v", ["k"], large=10).collect()
    place = lambda v: (v is not None, v is not None and math.isnan(v), 0.0 if v is None or math.isnan(v) else v)
    want = {}
    for k in (None, 1):
        values = sorted(place(v) for key, v in rows if key == k)
        for v in set(values):
            want[k, v] = (values.count(v), values.index(v) + (values.count(v) + 1) / 2)
    assert {(r["k"], place(r["v"])): (r["tied"], r["average_rank"]) for r in got} == want


def test_ladder(spark):
    asks = [(0.58, 56619.1), (0.59, 46501.9), (0.60, 3599.3), (0.61, 7046.1)]
    df = spark.createDataFrame([("t", "ASK", p, s) for p, s in asks], "token_id string, kind string, price double, size double")
    got = {r.stake: r for r in books.ladder_fill(df, (1.0, 50000.0, 1e9)).collect()}
    assert got[1.0].average_price == pytest.approx(0.58) and got[1.0].levels_consumed == 1
    assert got[50000.0].levels_consumed == 2 and got[50000.0].worst_price == 0.59
    assert got[1e9].unfilled_usd == pytest.approx(1e9 - sum(p * s for p, s in asks))


def plan(spark, bankroll, method, positions, offers):
    asked = spark.createDataFrame([(1, float(bankroll), method, positions, 1.0, 0.4)],
                                  "plan_id long, bankroll double, method string, max_positions int, min_ticket double, max_share double")
    pool = spark.createDataFrame([(1, i, float(p), float(s)) for i, (p, s) in enumerate(offers)],
                                 "plan_id long, candidate_id long, price double, score double")
    return sorted(allocation.allocation_plans(asked, pool).collect(), key=lambda r: r.candidate_id)


def test_allocation(spark):
    equal = plan(spark, 20, "EQUAL", 5, [(0.5, 50)] * 5)
    assert [r.stake_usd for r in equal] == [4.0] * 5 and equal[0].chance_all_win == pytest.approx(0.5 ** 5)
    capped = plan(spark, 100, "SCORE_WEIGHTED", 3, [(0.5, 90), (0.5, 5), (0.5, 5)])
    assert [r.stake_usd for r in capped] == [40.0, 30.0, 30.0]
    assert sum(r.stake_usd for r in plan(spark, 10, "EQUAL", 3, [(0.3, 9), (0.4, 8), (0.5, 7)])) == pytest.approx(10.0)
    assert len(plan(spark, 2.5, "EQUAL", 9, [(0.5, 50)] * 9)) == 2
    worthless = plan(spark, 10, "SCORE_WEIGHTED", 3, [(0.5, 60), (0.5, 40), (0.5, 0)])
    assert [r.stake_usd for r in worthless] == [4.0, 6.0]  # the limit's excess has nowhere else to go
    assert [r.stake_usd for r in plan(spark, 3, "SCORE_WEIGHTED", 3, [(0.5, 0)] * 3)] == [1.0] * 3


def test_numbers_as_wire_text(spark):
    values = {12345678.5: "12345678.5", 0.0001: "0.0001", 1e-6: "0.000001", 1e-7: "1e-7", 2.5e-8: "2.5e-8", 50.0: "50", 0.0: "0",
              1e20: "100000000000000000000", 1e21: "1e+21", 1.5e22: "1.5e+22", -0.25: "-0.25", 1e7: "10000000", 0.1: "0.1"}
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", normalize.number_text(F.col("v")).alias("t"))
    assert {r.v: r.t for r in got.collect()} == values


def test_text_ids_rank_and_the_last_arrival_wins(spark):
    sides = spark.createDataFrame([(f"c{i}", i % 2, float(i // 3)) for i in range(50)], "market_id string, outcome_index int, opportunity double")
    ranked = sorted(board.rank_board(sides).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 51))
    assert [(-r.opportunity, r.market_id) for r in ranked] == sorted((-r.opportunity, r.market_id) for r in ranked)
    copies = spark.createDataFrame([("c1", "e10", 2), ("c1", "e9", 1), ("c2", "e3", 5)], "condition_id string, event_id string, arrival int")
    assert {r.condition_id: r.event_id for r in normalize.dedupe_markets(copies).collect()} == {"c1": "e10", "c2": "e3"}


OUTCOME = "horizon_days int, signals long, rank_correlation double, best_band string, significant_alone boolean"


@pytest.mark.parametrize("rows, verdict", [
    ([(1, 50, 0.1, None, False)], "TOO LITTLE DATA"),
    ([(d, 500, 0.1, "0-20", False) for d in (1, 2, 3)], "NOTHING FOUND"),
    ([(1, 500, 0.1, "0-20", True)] + [(d, 500, 0.1, "0-20", False) for d in (2, 3)], "DOES NOT REPLICATE"),
    ([(d, 500, 0.1, "0-20", d < 3) for d in (1, 2, 3, 5, 7, 14)], "INCONSISTENT"),
    ([(d, 500, 0.1, "0-20", d < 7) for d in (1, 2, 3, 5, 7, 14)], "REPLICATES")])
def test_robustness(spark, rows, verdict):
    assert evaluation.robustness(spark.createDataFrame(rows, OUTCOME)).first().verdict == verdict


def test_planted_edge_is_found_and_a_fair_market_is_not(spark):
    rng = random.Random(11)

    def signals(shift):
        out = []
        for i in range(400):
            p, s = rng.uniform(0.2, 0.8), rng.uniform(0, 100)
            out.append((1, i, 0, p, round(s, 1), rng.random() < min(1, p + (shift if s >= 70 else 0))))
        return spark.createDataFrame(out, "horizon_days int, market_id long, outcome_index int, price double, opportunity double, won boolean")

    cfg = {"backtest": {"iterations": 300}}
    fair = evaluation.calibration_test(signals(0.0), cfg).first()
    planted = evaluation.calibration_test(signals(0.35), cfg).first()
    assert fair.best_band_p > 0.01 and planted.best_band_p <= 0.01


CLOSED = "trader_id long, market_id long, outcome_index int, category string, avg_price double, cost_basis_usd double, realized_pnl double, won boolean, resolved_ts long"


def test_scores_stay_in_range_and_ignore_the_future(spark):
    rng = random.Random(2)
    rows = [(t, i, 0, rng.choice(["POLITICS", "SPORTS"]), rng.random(), 1000.0, rng.choice([600.0, -1000.0]), None, 86400 * rng.randint(1, 400))
            for t in range(12) for i in range(t * 3)]
    rows = [r[:7] + (r[6] > 0,) + r[8:] for r in rows]
    later = [(t, 9999, 0, "SPORTS", 0.5, 1000.0, 600.0, True, 86400 * 300) for t in range(12)]
    asked = spark.createDataFrame([(t, 300) for t in range(12)], "trader_id long, as_of_day long")
    a, b = ({r.trader_id: r.smart_score for r in traders.trader_scores_asof(spark.createDataFrame(x, CLOSED), asked).collect()}
            for x in (rows, rows + later))
    assert a == b and all(0 <= s <= 100 for s in a.values()) and a[0] == 0.0
    assert not any(math.isnan(s) for s in a.values())


def test_windows_that_are_still_open_are_kept(spark, tmp_path):
    for k, hours in enumerate(([1, 1, 2], [2, 30], [31, 31])):  # k-th landing; the first fill of each comes twice
        rows = [(1, 1, 0, "BUY", 8.0, 0.5, 4.0, h * 3600 + i, f"{h}:{i}") for i, h in enumerate(hours)]
        spark.createDataFrame(rows + rows[:1], FILL.replace("long", "bigint")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    landed = streams.landed_fills(spark, f"{tmp_path}/in", 1)
    streams.store_windows(landed, f"{tmp_path}/out", f"{tmp_path}/cp", 172800, "1 hour", None).awaitTermination()
    got = {r["window_start"] // 3600: (r["fills"], r["usd"]) for r in streams.windows(spark, f"{tmp_path}/out").collect()}
    assert got == {1: (2, 8.0), 2: (2, 8.0), 30: (1, 4.0), 31: (2, 8.0)}


def land(spark, path, slices):
    for rows in slices:
        spark.createDataFrame(rows, FILL.replace("long", "bigint")).coalesce(1).write.mode("append").parquet(path)


def polls(n=10):
    """Fills of ten hours, one landing an hour; each brings the last minutes of the one before again, and one fill without a time."""
    rng = random.Random(4)
    slices = []
    for k in range(n):
        rows = [(rng.randint(1, 6), rng.randint(1, 3), rng.randint(0, 1), rng.choice(["BUY", "BUY", "SELL"]), float(rng.randint(1, 20)), 0.5,
                 float(rng.randint(1, 9)), k * 3600 + rng.randint(0, 3599), f"{k}:{i}") for i in range(30)]
        slices.append([r for r in (slices[-1] if slices else []) if r[7] is not None and r[7] >= k * 3600 - 600] + rows
                      + [(1, 1, 0, "BUY", 1.0, 0.5, 0.5, None, f"undated {k % 4}")])
    return slices


def stored(spark, path):
    return len(glob.glob(f"{path}/*")), spark.read.parquet(path).count()


def test_open_windows_are_compacted_and_closed_ones_written_once(spark, tmp_path):
    slices = polls()
    land(spark, f"{tmp_path}/in", slices)
    streams.store_windows(streams.landed_fills(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/cp", 1800, "10 minutes", None).awaitTermination()
    want = {}
    for r in {r[8]: r for s in slices for r in s if r[7] is not None}.values():
        key = r[1], r[2], r[7] // 600 * 600
        want[key] = want.get(key, 0) + 1
    got = streams.windows(spark, f"{tmp_path}/out").collect()
    assert len(got) == len(want) and {(r["market_id"], r["outcome_index"], r["window_start"]): r["fills"] for r in got} == want
    last = max(r["window_start"] for r in got)
    open_ = spark.read.parquet(*sorted(glob.glob(f"{tmp_path}/out/open/*"))[-1:])
    assert open_.where(F.col("window_end") <= last - 3600).count() == 0
    assert len(glob.glob(f"{tmp_path}/out/open/*")) <= 2 and len(glob.glob(f"{tmp_path}/out/mark/*")) <= 3
    assert streams.undated(spark, f"{tmp_path}/out").count() == 4


@pytest.mark.parametrize("buckets", [16])
def test_positions_rewrite_touched_buckets_only(spark, tmp_path, buckets):
    slices = polls(5)
    land(spark, f"{tmp_path}/in", slices)
    streams.store_positions(streams.landed_fills(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/cp", 1800, buckets).awaitTermination()
    every = spark.createDataFrame(list({r[8]: r for s in slices for r in s if r[7] is not None}.values()), FILL)
    ends = every.groupBy("market_id").agg(F.max("ts").alias("signal_ts"))
    want = {tuple(r[:3]): tuple(round(x, 9) for x in r[3:]) for r in replay.replay_positions(every, ends, -1, -1).select(
        *streams.HOLDING, "shares", "cost_usd", F.coalesce("first_buy_ts", F.lit(-1))).collect()}
    got = {tuple(r[:3]): tuple(round(x, 9) for x in r[3:]) for r in streams.positions(spark, f"{tmp_path}/out").select(
        *streams.HOLDING, "shares", "cost_usd", F.coalesce("first_buy_ts", F.lit(-1))).collect()}
    assert got == want
    assert streams.undated(spark, f"{tmp_path}/out").count() == 4
    versions = streams._marked(spark, f"{tmp_path}/out", streams._last(spark, f"{tmp_path}/out"))[1]
    assert len(glob.glob(f"{tmp_path}/out/held/*/bucket=*")) <= 2 * len(versions) and len(versions) <= buckets


def test_a_trigger_that_touches_one_bucket_leaves_the_others(spark, tmp_path):
    def fill(trader, ts, key):
        return (trader, 1, 0, "BUY", 2.0, 0.5, 1.0, ts, key)

    land(spark, f"{tmp_path}/in", [[fill(t, 10 + t, f"a{t}") for t in range(40)], [fill(7, 10_000, "b")], [fill(8, 20_000, "c")]])
    streams.store_positions(streams.landed_fills(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/cp", 60, 16).awaitTermination()
    last = streams._last(spark, f"{tmp_path}/out")
    versions = streams._marked(spark, f"{tmp_path}/out", last)[1]
    assert len(set(versions.values())) == 2 and list(versions.values()).count(max(versions.values())) == 1
    assert streams.positions(spark, f"{tmp_path}/out").where("trader_id = 8 and shares = 4").count() == 1


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_shuffle_files_go_with_the_write(spark):
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = held()
    df = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count().groupBy("count").agg(F.sum("k").alias("k"))
    cut = cut_lineage(df)
    until = time.time() + 10
    while held() - before and time.time() < until:
        time.sleep(0.1)
    assert not held() - before and cut.collect() == df.collect() == df.collect()


def test_asof_and_scan_shuffle_once(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    moments = rows.select("k", (F.col("t") + 3).alias("at"), F.lit(1).alias("other"))
    assert exchanges(asof_last(moments, rows, ["k"], "at", "t", {"v": "v"})) == 1
    assert exchanges(prefix.running(rows, ["k"], F.col("t"), ["t"], sums={"s": F.col("v")})) == 1


@pytest.mark.parametrize("cells", [1, 64])
def test_large_keys_are_those_of_many_rows(spark, monkeypatch, cells):
    monkeypatch.setattr(prefix, "CELLS", cells)
    df = spark.createDataFrame([(k % 9 or None,) for k in range(90)] + [(5,)] * 4 + [(None,)] * 8, "k long")
    plain, names = prefix.named_keys(df, ["k"])
    found = prefix.large_keys(df.withColumns(plain), names, 13)
    assert {(r["_k_k"], r["_k_nulls"]) for r in found.collect()} == {(5, 0), (0, 1)}
    assert prefix.large_keys(df.withColumns(plain), names, 18) is None


def test_clusters_shuffle_entries_once_and_sides_once(spark):
    df = spark.range(300).select((F.col("id") % 11).alias("market_id"), (F.col("id") % 2).alias("outcome_index"), (F.col("id") / 500).alias("avg_price"), (F.col("id") * 37).alias("opened_ts"))
    assert exchanges(holders.entry_clusters(df, ["market_id"])) == 2


@pytest.mark.parametrize("at_once", [1, 40, 1 << 17])
def test_cluster_sizes_over_batches(monkeypatch, at_once):
    monkeypatch.setattr(holders, "AT_ONCE", at_once)
    draw = random.Random(at_once)
    rows = sorted({(draw.randint(0, 9) if i % 3 else 4, draw.randint(0, 20000), draw.choice([0.3, 0.31, 0.32, 0.3 + draw.random() / 30])) for i in range(400)})
    table = pa.table({"market_id": [r[0] for r in rows], "opened_ts": [r[1] for r in rows], "avg_price": [r[2] for r in rows],
                      "_own": [1 + i % 3 for i in range(len(rows))], "_start": [i == 0 or rows[i - 1][0] != r[0] for i, r in enumerate(rows)]})
    got = pa.Table.from_batches(list(holders._clusters(7200, 0.01)(iter(table.to_batches(max_chunksize=7)))))
    want = [sum(1 + j % 3 for j in range(i, len(rows)) if rows[j][0] == r[0] and rows[j][1] - r[1] <= 7200 and abs(rows[j][2] - r[2]) <= 0.01)
            for i, r in enumerate(rows)]
    assert got["_own"].to_pylist() == want


def test_scores_as_of_deal_records_by_trader_once(spark, monkeypatch):
    """Skill is worked out for settled days, and nothing is dealt by day or category."""
    plans = []
    monkeypatch.setattr(traders, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut_lineage(df))
    closed = spark.createDataFrame([(t, c, 1000 + 9 * d, 10.0 + d, 3.0 - d % 4, d % 2 == 0, 0.5) for t in (1, 2) for d in range(12) for c in "AB"],
                                   "trader_id long, category string, day long, cost_basis_usd double, realized_pnl double, won boolean, avg_price double")
    closed = closed.withColumn("resolved_ts", F.col("day") * 86400)
    asked = spark.createDataFrame([(t, d) for t in (1, 2, 3) for d in range(995, 1120)], "trader_id long, as_of_day long")
    got = traders.trader_scores_asof(closed, asked).collect()
    assert len(got) == 375 and all((r.smart_score > 0) == (r.trader_id < 3 and r.as_of_day > 1000) or r.as_of_day > 1000 for r in got)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?)\)", plans[-1])
    assert dealt and all(re.match(r"trader_id#\d+L?, \d+$", d) for d in dealt)


def test_rows_of_other_keys_stay_in_the_scan(spark, monkeypatch):
    rows = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    few = cut_lineage(spark.createDataFrame([(3, 1), (4, 2)], "k long, last long"))
    for most in (1 << 20, 1):
        monkeypatch.setattr(session, "MOST_SENT", most)
        assert among(rows, few, "k").count() == 20


@pytest.mark.parametrize("length, slide", [("1 hour", "5 minutes"), ("1 day", None), ("7 minutes", "3 minutes"), ("3 seconds", "500 milliseconds")])
def test_windows_from_panes_are_those_of_fills(spark, length, slide):
    draw = random.Random(5)
    rows = [(draw.choice([1, 2, None]), draw.randint(0, 1), 1.0 + i % 3, 0.5, draw.randint(-5000, 90000)) for i in range(2000)]
    batch = spark.createDataFrame(rows, "market_id long, outcome_index int, size double, price double, ts long")
    time_ = F.timestamp_seconds("ts")
    plain = batch.groupBy("market_id", "outcome_index", (F.window(time_, length, slide) if slide else F.window(time_, length)).alias("w")).agg(
        F.count("*").alias("fills"), F.sum(F.col("size") * F.col("price")).alias("usd"), F.sum("size").alias("shares")).select(
        "market_id", "outcome_index", F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), "fills", "usd", "shares")
    found = streams._window_sums(batch, None, length, slide)
    if slide != "500 milliseconds":  # whole seconds are one row a window; parts of seconds share their names
        assert Counter(map(tuple, found.select(plain.columns).collect())) == Counter(map(tuple, plain.collect()))
        assert exchanges(found) == 2
    again = streams._window_sums(batch, found.select(plain.columns), length, slide)
    assert again.agg(F.sum("fills")).first()[0] == 2 * plain.agg(F.sum("fills")).first()[0]
