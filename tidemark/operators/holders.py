"""From open positions to the holders of each side of a live market."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import merge_config
from tidemark.functions.numeric import clamp, total
from tidemark.operators.prefix import LARGE, large_keys, named_keys, scan
from tidemark.operators.prefix import total as summed_up
from tidemark.session import cut_lineage

BOT_CLASSES = ["POSSIBLE_BOT", "SCALPER", "MARKET_MAKER"]


def live_markets(markets: DataFrame, positions: DataFrame) -> DataFrame:
    """Markets still trading that some tracked trader holds (FLT-1, JOIN-1)."""
    held = positions.where(F.col("size") > 0).select("market_id")
    trading = markets.where(~F.col("closed") & ~F.col("resolved") & F.col("accepting_orders"))
    return trading.join(held, "market_id", "left_semi")


def recent_net(activity: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Signed USD traded in the trailing window per trader and side (AGG-15)."""
    window = activity.where((F.col("ts") >= as_of - hours * 3600) & (F.col("ts") <= as_of))
    signed = F.when(F.col("side") == "BUY", F.col("usd")).otherwise(-F.col("usd"))
    return window.groupBy("market_id", "trader_id", "outcome_index").agg(
        total(signed).alias("recent_net_usd"))


def last_activity(activity: DataFrame, keys: list[str], as_of=None) -> DataFrame:
    """Latest fill per market, or per side, up to the clock (AGG-16)."""
    known = activity if as_of is None else activity.where(F.col("ts") <= as_of)
    return known.groupBy(*keys).agg(F.max("ts").alias("last_activity_ts"))


def first_buy(activity: DataFrame) -> DataFrame:
    """When each position was opened: the first buy (AGG-17)."""
    bought = activity.where(F.col("side") == "BUY")
    return bought.groupBy("trader_id", "market_id", "outcome_index").agg(
        F.min("ts").alias("opened_ts"))


def build_holders(positions: DataFrame, markets: DataFrame, traders: DataFrame,
                  scores: DataFrame, skills: DataFrame, activity: DataFrame, as_of,
                  exclude_bots: bool = False, cfg=None) -> DataFrame:
    """Open positions with their trader's score, category skill and recent flow (JOIN-4).

    A trader without a record in the market's category has no category skill, not a zero one.
    """
    hours = merge_config(cfg)["consensus"]["recent_hours"]
    live = live_markets(markets, positions).select("market_id", "category")
    known = scores.select("trader_id", "smart_score", "behaviour_class", "behaviour_confidence",
                          F.col("avg_position_usd").alias("typical_usd"))
    skill = skills.select("trader_id", "category", F.col("skill_score").alias("category_skill"))
    flow = recent_net(activity, as_of, hours)
    bot = F.coalesce(F.col("behaviour_class").isin(BOT_CLASSES)
                     & (F.col("behaviour_confidence") >= 0.6), F.lit(False))
    holders = (positions.where(F.col("size") > 0)
               .select("trader_id", "market_id", "outcome_index", "avg_price", "opened_ts",
                       F.col("current_value").alias("size_usd"))
               .join(live, "market_id")
               .join(traders.select("trader_id", "wallet", "display_name"), "trader_id")
               .join(known, "trader_id", "left")
               .join(skill, ["trader_id", "category"], "left")
               .join(flow, ["market_id", "trader_id", "outcome_index"], "left")
               .withColumn("likely_bot", bot)
               .fillna({"recent_net_usd": 0.0})
               .drop("behaviour_class", "behaviour_confidence", "category"))
    return holders.where(~F.col("likely_bot")) if exclude_bots else holders


def holder_weight(cfg):
    """Square root of exposure scaled by trader quality, damped for suspected bots (SCR-3)."""
    size = F.greatest(F.coalesce("size_usd", F.lit(0.0)), F.lit(0.0))
    quality = F.pow(clamp(F.coalesce("smart_score", F.lit(0.0)), 0.0, 100.0) / 100.0, F.lit(1.5))
    damp = F.when(F.col("likely_bot"), cfg["consensus"]["bot_weight"]).otherwise(1.0)
    return F.sqrt(size) * quality * damp


def one_per_wallet(holders: DataFrame, keys: list[str]) -> DataFrame:
    """Largest position of every wallet on a side (AGG-13). Combines map-side."""
    rest = [c for c in holders.columns if c not in {*keys, "outcome_index"}]
    order = F.struct((-F.coalesce("size_usd", F.lit(0.0))).alias("minus"), "trader_id")
    best = (holders.withColumn("_wallet", F.lower("wallet"))
            .groupBy(*keys, "outcome_index", "_wallet")
            .agg(F.min_by(F.struct(*rest), order).alias("_row")))
    return best.select(*keys, "outcome_index", "_row.*")


def opposing_totals(unique: DataFrame, keys: list[str], qualified_score: float,
                    size: str = "size_usd") -> DataFrame:
    """Wallets, qualified wallets and exposure on the other sides of a market (JOIN-5).

    A wallet counts once against a side, at its largest position on any other side. Rather than
    pairing every holder with every other side, each wallet is reduced to its two largest sides:
    all sides face the market total of largest positions, and only the wallet's own largest side
    is corrected to the second largest. The work is linear in the holders.
    """
    good = F.when(F.coalesce("smart_score", F.lit(0.0)) >= qualified_score, 1).otherwise(0)
    entry = F.struct(F.coalesce(size, F.lit(0.0)).alias("size"),
                     (-F.col("outcome_index")).alias("minus_outcome"), good.alias("good"))
    wallets = (unique.groupBy(*keys, F.lower("wallet").alias("_wallet"))
               .agg(F.sort_array(F.collect_list(entry), asc=False).alias("_own"))
               .withColumns({"_a": F.get("_own", F.lit(0)), "_b": F.get("_own", F.lit(1))}))
    largest = wallets.groupBy(*keys, (-F.col("_a.minus_outcome")).alias("outcome_index")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_a.good").alias("_q"), F.sum("_a.size").alias("_usd"),
        F.count("_b.size").alias("_n2"), F.coalesce(F.sum("_b.good"), F.lit(0)).alias("_q2"),
        total("_b.size").alias("_usd2"))
    market = largest.groupBy(*keys).agg(
        F.sum("_n").alias("_tn"), F.sum("_q").alias("_tq"), F.sum("_usd").alias("_tusd"))
    sides = unique.select(*keys, "outcome_index").distinct()
    joined = (sides.join(market, keys).join(largest, [*keys, "outcome_index"], "left")
              .fillna(0, ["_n", "_q", "_n2", "_q2"]).fillna(0.0, ["_usd", "_usd2"]))
    return joined.select(
        *keys, "outcome_index",
        (F.col("_tn") - F.col("_n") + F.col("_n2")).alias("opposing_count"),
        (F.col("_tq") - F.col("_q") + F.col("_q2")).alias("qualified_opposing_count"),
        (F.col("_tusd") - F.col("_usd") + F.col("_usd2")).alias("opposing_exposure_usd"))


def _bound(price: Column, near: float, sign: int) -> Column:
    """The outermost price that is no further than ``near`` from ``price``, as subtracting them says."""
    edge = price + sign * near
    tried = [edge * (1 + j * 2.0 ** -53) for j in range(-6, 7)]
    good = [F.when(F.abs(x - price) <= near, x) for x in tried]
    return F.greatest(*good) if sign > 0 else F.least(*good)


def _blocks(rank: Column, levels: Column) -> Column:
    """The dyadic blocks (level, block) that ranks below ``rank`` are made of, one for each of its bits."""
    return F.transform(F.filter(F.sequence(F.lit(0), levels), lambda x: F.getbit(rank, x) == 1), lambda x: F.struct(
        x.alias("_level"), (F.call_function("shiftright", rank, x) - 1).alias("_block")))


def _reach(values: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct values in order: each value's place, and the first and past-last place no further than ``near``."""
    each, at = np.unique(values, return_inverse=True)
    ends = []
    for sign in (-1, 1):
        edge = np.searchsorted(each, each + sign * near, "right" if sign > 0 else "left")
        while True:  # a sum may be rounded: what subtracting says decides
            out = np.clip(edge - (sign > 0), 0, len(each) - 1)
            far = (np.abs(each[out] - each) > near) & (out != np.arange(len(each)))
            wide = np.clip(edge - (sign < 0), 0, len(each) - 1)
            more = (np.abs(each[wide] - each) <= near) & (edge != (len(each) if sign > 0 else 0))
            if not (far | more).any():
                break
            edge = edge + sign * (more.astype(int) - (far & ~more))
        ends.append(edge)
    return at, ends[0][at], ends[1][at]


def _weight_below(place: np.ndarray, weight: np.ndarray, first: np.ndarray, past: np.ndarray, asked: list[np.ndarray]) -> list[np.ndarray]:
    """For each i the weight of rows ``first[i]`` to ``past[i]`` whose place is below ``asked[k][i]``.

    The rows are dealt by one bit of their places after another, highest first, those without it before
    those with it, and each question follows its own bits: n log n steps over all rows at once.
    """
    bits = max(int(place.max(initial=0)), *(int(a.max(initial=0)) for a in asked)).bit_length()
    spans = [(first, past, np.zeros(len(a), weight.dtype)) for a in asked]
    for bit in range(bits - 1, -1, -1):
        one = (place >> bit) & 1 == 1
        zeros = np.concatenate(([0], np.cumsum(~one)))
        light = np.concatenate(([0], np.cumsum(np.where(one, 0, weight))))
        for k, (low, high, sums) in enumerate(spans):
            up = (asked[k] >> bit) & 1 == 1
            sums = sums + np.where(up, light[high] - light[low], 0)
            spans[k] = (np.where(up, zeros[-1] + low - zeros[low], zeros[low]), np.where(up, zeros[-1] + high - zeros[high], zeros[high]), sums)
        dealt = np.argsort(one, kind="stable")
        place, weight = place[dealt], weight[dealt]
    return [sums for *_, sums in spans]


def _cluster_sizes(group: np.ndarray, when: np.ndarray, price: np.ndarray, own: np.ndarray, span: int, near: float) -> np.ndarray:
    """Of entries in order of (group, time, price): their own count and that of later ones of the group within reach."""
    n = len(group)
    times, time_at = np.unique(when, return_inverse=True)
    until = np.searchsorted(times, times + span, "right")[time_at]
    past = np.searchsorted(group * (len(times) + 1) + time_at, group * (len(times) + 1) + until, "left")
    place, low, high = _reach(price, near)
    above, below = _weight_below(place, own, np.arange(1, n + 1), past, [high, low])
    return own + above - below


#: Entries that a task counts at once, if none of its groups is larger.
AT_ONCE = 1 << 17


def _clusters(span: int, near: float):
    """Batches of entries, ``_start`` marking the first of a group, with their cluster sizes for ``_own``."""
    def run(batches):
        held, rows = [], 0

        def counted(table: pa.Table):
            start = table["_start"].to_numpy()
            cols = [table[c].to_numpy() for c in ("opened_ts", "avg_price", "_own")]
            sizes = _cluster_sizes(np.cumsum(start), cols[0], cols[1].astype(float), cols[2].astype(np.int64), span, near)
            return table.set_column(table.schema.get_field_index("_own"), "_own", pa.array(sizes, pa.int64())).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held, rows = [*held, batch], rows + batch.num_rows
            begins = np.flatnonzero(batch["_start"].to_numpy(zero_copy_only=False))
            if rows >= AT_ONCE and len(begins):  # whole groups, up to the last one that begins here
                whole = rows - batch.num_rows + int(begins[-1])
                if whole:
                    table = pa.Table.from_batches(held)
                    yield from counted(table.slice(0, whole))
                    held, rows = table.slice(whole).to_batches(), rows - whole
        if rows:
            yield from counted(pa.Table.from_batches(held))

    return run


def entry_clusters(unique: DataFrame, keys: list[str], cfg=None, large: int = LARGE) -> DataFrame:
    """Largest run of entries within two hours and one cent of an earlier one, per side (JOIN-11).

    Entries at one second and price are counted first. A side's entries are shuffled once and counted in
    one task, in n log n steps, many sides at a time. Of entries at one second the lower price counts as
    the earlier. Sides of more than ``large`` entries, which are looked for first, are spread over all
    tasks by ``_spread_clusters``.
    """
    c = merge_config(cfg)["consensus"]
    span, near = int(c["cluster_hours"] * 3600), c["cluster_price"]
    side = [*keys, "outcome_index"]
    dated = unique.where(F.col("opened_ts").isNotNull() & F.col("avg_price").isNotNull()).select(*side, "opened_ts", "avg_price")
    plain, names = named_keys(dated, side)
    heavy = large_keys(dated.withColumns(plain), names, large)
    light = dated if heavy is None else dated.withColumns(plain).join(F.broadcast(heavy), names, "left_anti").drop(*names)
    points = light.repartition(*side).groupBy(*side, "opened_ts", "avg_price").agg(F.count(F.lit(1)).alias("_own"))
    begins = F.lag(F.lit(1)).over(W.partitionBy(*side).orderBy("opened_ts", "avg_price")).isNull()
    marked = points.withColumn("_start", begins)
    found = marked.mapInArrow(_clusters(span, near), marked.schema).groupBy(*side).agg(F.max("_own").alias("largest_cluster"))
    if heavy is None:
        return found
    crowded = dated.withColumns(plain).join(F.broadcast(heavy), names, "left_semi").drop(*names)
    return found.unionByName(_spread_clusters(crowded, keys, cfg, large))


def _spread_clusters(unique: DataFrame, keys: list[str], cfg=None, large: int = LARGE) -> DataFrame:
    """``entry_clusters`` of sides that are too large for one task.

    What an entry meets lies in its own stretch of two hours, after it, or in the next one, up to its end:
    two half-open times in each of which prices from a to b count, that is, two prefixes of the prices'
    order. A prefix is made of dyadic blocks of ranks, at most one a level. Every point is a row of each
    level's block, every prefix one of each of its blocks, and a scan by time counts the points: n log n
    rows, no pairs, however crowded a stretch is.
    """
    c = merge_config(cfg)["consensus"]
    span, near = int(c["cluster_hours"] * 3600), c["cluster_price"]
    side = [*keys, "outcome_index"]
    cell = [*side, "_cell"]
    dated = unique.where(F.col("opened_ts").isNotNull() & F.col("avg_price").isNotNull())
    points = cut_lineage(dated.groupBy(*side, "opened_ts", "avg_price").agg(F.count(F.lit(1)).alias("_own")).withColumns({
        "_cell": F.floor(F.col("opened_ts") / F.lit(span)), "_id": F.monotonically_increasing_id()}))
    # In order of price: points, and before or after them the ends of what is asked for here and in the next stretch.
    place = points.select(*cell, F.col("avg_price").alias("_p"), F.lit(1).alias("_kind"), "_id", "opened_ts", "_own", F.lit(0).alias("_next"))
    asked = points.select(*side, F.explode(F.array(*[
        F.struct((F.col("_cell") + n).alias("_cell"), _bound(F.col("avg_price"), near, s).alias("_p"),
                 F.lit(1 + s).alias("_kind"), F.lit(n).alias("_next")) for n in (0, 1) for s in (-1, 1)])).alias("_q"),
        "_id", "opened_ts", "_own").select(*side, "_q.*", "_id", "opened_ts", "_own")
    one = F.when(F.col("_kind") == 1, 1).otherwise(0)
    by_price = scan(place.unionByName(asked), cell, F.floor(F.col("_p") / F.lit(near)), ["_p", "_kind", "_id", "_next"],
                    summed_up("_rank", one.cast("long")), large=large)
    sizes = place.groupBy(*cell).agg(F.ceil(F.log2(F.count(F.lit(1)) + 1)).cast("int").alias("_levels"))
    ranked = by_price.join(sizes, cell)
    own = F.transform(F.sequence(F.lit(0), F.col("_levels")), lambda x: F.struct(
        x.alias("_level"), F.call_function("shiftright", F.col("_rank") - 1, x).alias("_block")))
    kind = F.col("_kind")
    blocks = F.when(kind == 1, own).otherwise(_blocks(F.col("_rank"), F.col("_levels")))
    # In the own stretch what comes later is all less what comes up to here; prices below or at one's own at the
    # same second count as earlier. In the next stretch it is what comes up to the span's end.
    at = F.when((kind != 1) & (F.col("_next") == 1), F.col("opened_ts") + span).otherwise(F.col("opened_ts"))
    rows = ranked.select(*cell, "_id", "_kind", "_next", "_own", at.alias("_at"), F.explode(blocks).alias("_b")).select(
        "*", "_b.*").drop("_b")
    block = [*cell, "_level", "_block"]
    weight = F.when(kind == 1, F.col("_own")).otherwise(0)
    order = ["_at", F.when(kind == 1, 0).otherwise(1), "_id", "_kind", "_next"]
    counted = scan(rows, block, F.col("_at"), order, summed_up("_upto", weight.cast("long")), large=large)
    whole = rows.groupBy(*block).agg(F.sum(weight).alias("_all"))
    met = counted.where(kind != 1).join(whole, block)
    sign = F.when(kind == 2, 1).otherwise(-1)
    within = F.when(F.col("_next") == 1, F.col("_upto")).otherwise(F.col("_all") - F.col("_upto"))
    later = met.groupBy("_id").agg(F.sum(sign * within).alias("_later"))
    # At the same second the higher prices within reach come later too.
    same = points.select(*side, "opened_ts", "avg_price", "_own", "_id", _bound(F.col("avg_price"), near, 1).alias("_reach"))
    reach = same.select(*side, "opened_ts", F.explode(F.array(
        F.struct(F.col("avg_price").alias("_p"), F.lit(0).alias("_end"), F.col("_own")),
        F.struct(F.col("_reach").alias("_p"), F.lit(1).alias("_end"), F.lit(0).cast("long").alias("_own")))).alias("_x"), "_id").select(
        *side, "opened_ts", "_x.*", "_id")
    summed = scan(reach, [*side, "opened_ts"], F.floor(F.col("_p") / F.lit(near)), ["_p", "_end", "_id"], summed_up("_sum", F.col("_own")), large=large)
    beside = summed.groupBy("_id").agg(F.sum(F.when(F.col("_end") == 1, F.col("_sum")).otherwise(-F.col("_sum"))).alias("_beside"))
    sized = points.join(later, "_id", "left").join(beside, "_id", "left").withColumn(
        "_size", F.col("_own") + F.coalesce("_later", F.lit(0)) + F.coalesce("_beside", F.lit(0)))
    return sized.groupBy(*side).agg(F.max("_size").alias("largest_cluster"))


def side_holders(positions: DataFrame, traders: DataFrame, scores: DataFrame) -> DataFrame:
    """Holders of every side with their trader's score, largest first (JOIN-13)."""
    return (positions.where(F.col("size") > 0)
            .join(traders.select("trader_id", "display_name"), "trader_id")
            .join(scores.select("trader_id", "smart_score"), "trader_id", "left")
            .select("market_id", "outcome_index", "trader_id", "display_name", "smart_score",
                    "size", "current_value", "avg_price")
            .orderBy("market_id", "outcome_index", F.desc_nulls_last("current_value"), "trader_id"))
