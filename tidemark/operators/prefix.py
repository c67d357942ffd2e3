"""Ordered computations over keys that may be arbitrarily large.

A plain ``W.partitionBy(key).orderBy(t)`` puts a whole key into one task. Every operator here
works on two levels for such keys: rows are windowed inside ``(key, bucket)`` groups, where ``bucket`` is
a coarse, order-preserving cut of the sort column (usually a UTC day), and a small table with one
row per ``(key, bucket)`` carries the running value from one bucket to the next. A hot key is then
spread over as many tasks as it has buckets, and the carry table is bounded by the calendar, not by
the data. ``scan`` does this once for any number of states; a state is anything whose parts compose.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

BUCKET = "_bucket"


#: Where rows without a place in the order go: before all others, as Spark sorts nulls.
NOWHERE = -(1 << 62)
#: Rows of a key that one task may order.
LARGE = 1 << 20
#: Cells that keys are hashed to when large ones are looked for.
CELLS = 1 << 16


def _before(keys: list[str], bucket: str = BUCKET):
    return W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)


def _inside(keys: list[str], order: list):
    return (W.partitionBy(*keys, BUCKET).orderBy(*order)
            .rowsBetween(W.unboundedPreceding, W.currentRow))


@dataclass(frozen=True)
class State:
    """What a scan keeps along the rows of a key.

    ``local`` are columns over the rows of a bucket so far, later steps seeing earlier ones; at the
    bucket's last row they are its total. ``carry`` are columns over the totals of earlier buckets.
    ``out`` composes the two.
    """

    local: list[dict[str, Callable]]
    carry: list[dict[str, Callable]]
    out: dict[str, Column]


def total(name: str, value: Column) -> State:
    """The sum of ``value`` up to each row."""
    s, c = f"_s_{name}", f"_c_{name}"
    return State([{f"_v_{name}": lambda w: value}, {s: lambda w: F.coalesce(F.sum(f"_v_{name}").over(w), F.lit(0))}],
                 [{c: lambda w: F.coalesce(F.sum(s).over(w), F.lit(0))}], {name: F.col(s) + F.coalesce(c, F.lit(0))})


def lowest(net: str, low: str, value: Column) -> State:
    """The sum of ``value`` up to each row, and the least such sum so far."""
    v, s, m, cs, cm = (f"_{x}_{net}" for x in ("v", "s", "m", "cs", "cm"))
    return State([{v: lambda w: value}, {s: lambda w: F.coalesce(F.sum(v).over(w), F.lit(0))}, {m: lambda w: F.min(s).over(w)}],
                 [{cs: lambda w: F.coalesce(F.sum(s).over(w), F.lit(0))}, {cm: lambda w: F.min(F.col(m) + F.col(cs)).over(w)}],
                 {net: F.col(s) + F.coalesce(cs, F.lit(0)), low: F.least(F.col(m) + F.coalesce(cs, F.lit(0)), F.col(cm))})


def extreme(name: str, value: Column, largest: bool) -> State:
    """The largest or least ``value`` up to each row; nulls don't count."""
    pick, join = (F.max, F.greatest) if largest else (F.min, F.least)
    m, c = f"_m_{name}", f"_c_{name}"
    return State([{f"_v_{name}": lambda w: value}, {m: lambda w: pick(f"_v_{name}").over(w)}],
                 [{c: lambda w: pick(m).over(w)}], {name: join(m, c)})


def latest(name: str, value: Column) -> State:
    """The last ``value`` up to each row that isn't null."""
    m, c = f"_l_{name}", f"_c_{name}"
    return State([{f"_v_{name}": lambda w: value}, {m: lambda w: F.last(f"_v_{name}", ignorenulls=True).over(w)}],
                 [{c: lambda w: F.last(m, ignorenulls=True).over(w)}], {name: F.coalesce(m, c)})


def place(name: str) -> State:
    """Each row's 0-based place."""
    n, c = f"_n_{name}", f"_c_{name}"
    return State([{n: lambda w: F.row_number().over(w).cast("long")}],
                 [{c: lambda w: F.coalesce(F.sum(n).over(w), F.lit(0))}], {name: F.col(n) - 1 + F.coalesce(c, F.lit(0))})


def named_keys(df: DataFrame, keys: list[str]) -> tuple[dict[str, Column], list[str]]:
    """Key columns without nulls, so that plain joins and windows agree on what is one key."""
    plain, nulls = {}, F.lit(0)
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        empty = F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit("") if isinstance(kind, T.StringType) else None
        if empty is None:  # a struct is never null, and nulls in it are equal
            plain[f"_k_{k}"] = F.struct(k)
        else:
            plain[f"_k_{k}"] = F.coalesce(k, empty)
            nulls = nulls + F.when(F.col(k).isNull(), 1 << i).otherwise(0)
    plain["_k_nulls"] = nulls
    return plain, list(plain)


def large_keys(df: DataFrame, names: list[str], large: int) -> DataFrame | None:
    """The keys with more than ``large`` rows, or None if there are none. Reads ``df``.

    Rows are counted by a hash of the key first, so a task sends ``CELLS`` rows at most however many keys
    there are; keys are only counted in cells that have more than ``large`` rows.
    """
    cell = F.pmod(F.xxhash64(*names), F.lit(CELLS))
    sums = df.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > large)
    crowded = [r["_cell"] for r in sums.collect()]
    if not crowded:
        return None
    within = df if len(crowded) == CELLS else df.where(cell.isin(crowded))
    heavy = within.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > large)
    found = cut_lineage(heavy.select(*names))
    return None if found.isEmpty() else found


def _dealt(df: DataFrame, keys: list[str], bucket: Column, large: int) -> tuple[DataFrame, list[str]]:
    """``df`` with what its rows are dealt by: plain keys and, if there are large ones, whether a key is large; the bucket if so.

    Being large is one of the columns to deal by, so that a filter on it goes below the windows.
    """
    plain, names = named_keys(df, keys)
    named = df.withColumns(plain)
    heavy = large_keys(named, names, large)
    if heavy is None:
        return named.withColumn(BUCKET, F.lit(NOWHERE)), names
    heavy = heavy.withColumn("_k_found", F.lit(True))
    dealt = named.join(F.broadcast(heavy), names, "left").withColumn("_k_large", F.col("_k_found").isNotNull()).drop("_k_found")
    return dealt.withColumn(BUCKET, F.when(F.col("_k_large"), F.coalesce(bucket, F.lit(NOWHERE))).otherwise(
        F.lit(NOWHERE))), [*names, "_k_large"]


def scan(df: DataFrame, keys: list[str], bucket: Column, order: list, *states: State, large: int = LARGE,
         keep: bool = False) -> DataFrame:
    """``df`` with the outputs of all ``states`` along each key, in one ordered pass.

    Rows are shuffled once, by key. Keys of more than ``large`` rows are cut by ``bucket`` as well: the
    last row of a bucket has its totals, and what they come to before each bucket is a small table that
    is joined where the rows already lie. Those keys are counted first, while the plan is made, and are
    fewer than the rows divided by ``large``, so their list is sent to all tasks. ``order`` must end in a
    column that makes rows unique within a key, and ``bucket`` must not decrease along it. Null keys are a
    key of their own; rows with a null bucket come before all others of their key. ``df`` is read twice or,
    if there are such keys, five times: write it first where it is costly. ``keep`` leaves the columns that
    rows were dealt by, for ``affine``.
    """
    dealt, names = _dealt(df, keys, bucket, large)
    inside, before = _inside(names, order), _before(names)

    def within(rows: DataFrame) -> DataFrame:
        for step in range(max(len(s.local) for s in states)):
            rows = rows.withColumns({n: f(inside) for s in states if step < len(s.local) for n, f in s.local[step].items()})
        return rows

    local = [n for s in states for step in s.local for n in step]
    large_rows = dealt.where("_k_large") if "_k_large" in names else dealt
    carry = _ends(within(large_rows), names, order).select(*names, BUCKET, *local)
    for step in range(max(len(s.carry) for s in states)):
        carry = carry.withColumns({n: f(before) for s in states if step < len(s.carry) for n, f in s.carry[step].items()})
    carried = [n for s in states for step in s.carry for n in step]
    out = {n: c for s in states for n, c in s.out.items()}
    if "_k_large" in names:
        found = within(dealt).join(carry.select(*names, BUCKET, *carried), [*names, BUCKET], "left")
    else:  # no key is cut, so nothing is carried
        found = within(dealt).withColumns({c: F.lit(None).cast(carry.schema[c].dataType) for c in carried})
    return (found.withColumns(out)
            .drop(*local, *carried, *([] if keep else [BUCKET, *names])))


def _ends(rows: DataFrame, names: list[str], order: list) -> DataFrame:
    """The last row of each bucket."""
    follows = F.lead(F.lit(1)).over(W.partitionBy(*names, BUCKET).orderBy(*order))
    return rows.withColumn("_end", follows.isNull()).where("_end").drop("_end")


def _composed(batches):
    """Per run of rows from ``_start`` on, the maps x -> ratio * x + amount composed up to each row.

    Neighbours are composed at distances 1, 2, 4 and so on, all rows at once; a run that goes on in the
    next batch hands its last map over.
    """
    left = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ratio, amount = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_ratio", "_amount"))
        start = batch.column("_start").to_numpy(zero_copy_only=False).astype(bool)
        if left is not None and not start[0]:
            ratio[0], amount[0] = left[0] * ratio[0], left[1] * ratio[0] + amount[0]
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(start, at, 0))
        step, far = 1, at
        while len(far := far[far - step >= first[far]]):
            r, b = ratio[far - step], amount[far - step]
            amount[far], ratio[far] = b * ratio[far] + amount[far], r * ratio[far]
            step *= 2
        left = ratio[-1], amount[-1]
        made = {"_ratio": pa.array(ratio), "_amount": pa.array(amount)}
        yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)


def _compose(rows: DataFrame, part: list[str], order: list) -> DataFrame:
    begins = F.lag(F.lit(1)).over(W.partitionBy(*part).orderBy(*order)).isNull()
    marked = rows.withColumn("_start", begins)
    return marked.mapInArrow(_composed, marked.schema).drop("_start")


def affine(kept: DataFrame, order: list, ratio: Column, amount: Column, out: str) -> DataFrame:
    """``out``: what x -> ratio * x + amount makes of zero, row by row along each key.

    ``kept`` comes from ``scan`` with ``keep`` and the same order, so its rows lie where they are needed.
    Maps compose, so large keys are worked on by bucket and their totals are composed along the key.
    Rows of a key that is not large, or of a bucket, are read in Arrow batches, never as a whole.
    """
    names = [c for c in kept.columns if c.startswith("_k_")]
    mapped = kept.withColumns({"_ratio": ratio.cast("double"), "_amount": amount.cast("double")})
    if "_k_large" not in names:
        found = _compose(mapped, [*names, BUCKET], order)
        return found.withColumn(out, F.col("_amount")).drop("_ratio", "_amount", BUCKET, *names)
    totals = _ends(_compose(mapped.where("_k_large"), [*names, BUCKET], order), names, order)
    along = _compose(totals.select("_ratio", "_amount", *names, BUCKET), names, [BUCKET])
    carry = along.select(*names, BUCKET, F.lag("_amount").over(W.partitionBy(*names).orderBy(BUCKET)).alias("_carried"))
    found = _compose(mapped, [*names, BUCKET], order).join(carry, [*names, BUCKET], "left")
    return found.withColumn(out, F.col("_ratio") * F.coalesce("_carried", F.lit(0.0)) + F.col("_amount")).drop(
        "_ratio", "_amount", "_carried", BUCKET, *names)


def running(df: DataFrame, keys: list[str], bucket: Column, order: list,
            sums: dict[str, Column] | None = None, index: str | None = None, large: int = LARGE) -> DataFrame:
    """Running sums (inclusive) and a 0-based row index per key."""
    states = [total(n, c) for n, c in (sums or {}).items()] + ([place(index)] if index else [])
    return scan(df, keys, bucket, order, *states, large=large)


def running_extreme(df: DataFrame, keys: list[str], bucket: Column, order: list,
                    out: str, value: Column, largest: bool, large: int = LARGE) -> DataFrame:
    """Running maximum or minimum (inclusive) per key."""
    return scan(df, keys, bucket, order, extreme(out, value, largest), large=large)


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """``df`` with each row's 0-based place in ``order`` within its key, for order columns of any type.

    Rows are dealt by range, numbered inside their range, and shifted by the rows of the key in
    earlier ranges, so neither a hot key nor the absence of keys leads to one task. ``order`` must
    end in a column that makes rows unique within a key.
    """
    dealt = cut_lineage(df.repartitionByRange(*keys, *order).withColumn(BUCKET, F.spark_partition_id()))
    carry = (dealt.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_c", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)))
             .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(BUCKET).alias("_k_bucket"), "_c"))
    same = F.col(BUCKET) == F.col("_k_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    placed = dealt.withColumn(name, F.row_number().over(_inside(keys, order)).cast("long") - 1)
    return (placed.join(carry, same).withColumn(name, F.col(name) + F.col("_c"))
            .drop(BUCKET, "_k_bucket", "_c", *[f"_k_{k}" for k in keys]))


def latest_n(df: DataFrame, keys: list[str], order: list, n: int | Column, salt: list[str],
             splits: int = 32) -> DataFrame:
    """The first ``n`` rows of every key in the given order (WIN-10); ``n`` may differ by key.

    A hot key is cut into ``splits`` groups by a hash of ``salt`` first; each keeps its own ``n``
    best, so the second pass sees at most ``splits * n`` rows of any key.
    """
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(splits)))
            .withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= n)
            .withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= n)
            .drop("_salt", "_rank"))


def thin(df: DataFrame, keys: list[str], bucket: Column, order: list, max_rows: int) -> DataFrame:
    """Evenly spaced rows of a key with more than ``max_rows``, plus its last row (WIN-9)."""
    indexed = running(df, keys, bucket, order, index="_i")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = F.col("_n").cast("double") / F.lit(float(max_rows))
    slot = F.floor(F.col("_i") / step)
    hit = F.lit(False)
    for near in (slot, slot + 1):  # the division may land a hair on either side of the slot
        hit = hit | ((near < max_rows) & (F.floor(near * step) == F.col("_i")))
    kept = (F.col("_n") <= max_rows) | hit | (F.col("_i") == F.col("_n") - 1)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    named = sizes.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "_n")
    return indexed.join(named, same).where(kept).drop("_i", "_n", *[f"_t_{k}" for k in keys])


def order_statistics(df: DataFrame, keys: list[str], value: str, width: int,
                     ranks: dict[str, Column]) -> DataFrame:
    """Exact k-th smallest values of a whole-number column per key.

    ``ranks`` maps output names to a 1-based rank written in terms of the column ``n`` (rows of
    the key). Equal values are counted before anything is shuffled, so a window never sees more
    than ``width`` distinct values of one key: first the bucket holding each rank is located on
    the bucket totals, then the value inside it.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias("_k"))
              .withColumn(BUCKET, F.floor(F.col(value) / F.lit(width))))
    carry = (counts.groupBy(*keys, BUCKET).agg(F.sum("_k").alias("_b"))
             .withColumns({"_c": F.coalesce(F.sum("_b").over(_before(keys)), F.lit(0)),
                           "n": F.sum("_b").over(W.partitionBy(*keys))})
             .select(*keys, BUCKET, "_c", "n"))
    upto = (W.partitionBy(*keys, BUCKET).orderBy(value)
            .rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = (counts.join(carry, [*keys, BUCKET])
              .withColumn("_hi", F.sum("_k").over(upto) + F.col("_c"))
              .withColumn("_lo", F.col("_hi") - F.col("_k")))
    picked = [F.max(F.when((rank > F.col("_lo")) & (rank <= F.col("_hi")), F.col(value))).alias(name)
              for name, rank in ranks.items()]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *picked)


def exact_median(df: DataFrame, keys: list[str], value: str, out: str,
                 width: int = 3600) -> DataFrame:
    """Median of a whole-number column per key, midpoint for an even count (AGG-9)."""
    ranks = {"_low": F.floor((F.col("n") + 1) / F.lit(2)), "_high": F.floor(F.col("n") / F.lit(2)) + 1}
    stats = order_statistics(df, keys, value, width, ranks)
    return stats.select(*keys, ((F.col("_low") + F.col("_high")) / F.lit(2.0)).alias(out))


def average_rank(df: DataFrame, value: str, keys: list[str], large: int = LARGE) -> DataFrame:
    """Distinct values with their count and average rank under ties (WIN-6); nulls rank first.

    Values are counted before they are ranked and dealt by range, so a key with very many distinct
    values is ranked range by range and the counts are carried from one to the next.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    dealt = cut_lineage(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id().cast("long")))
    ranked = scan(dealt, keys, F.col("_range"), [value], total("_upto", F.col("_k")), large=large)
    return ranked.select(*keys, value, F.col("_k").alias("tied"),
                         (F.col("_upto") - F.col("_k") + (F.col("_k") + 1) / F.lit(2.0)).alias("average_rank"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str], out: str) -> DataFrame:
    """Rank correlation of two columns per key; null under 3 rows or without variance (WIN-7).

    Rows are first counted per (x, y) pair, so the ranking and the sums run on distinct pairs.
    """
    pairs = df.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_k"))

    def ranks(column: str, name: str) -> DataFrame:
        ranked = average_rank(df, column, keys)
        return ranked.select(*keys, column, F.col("average_rank").alias(name))

    ranked = pairs.join(ranks(x, "_rx"), [*keys, x]).join(ranks(y, "_ry"), [*keys, y])
    a, b, k = F.col("_rx"), F.col("_ry"), F.col("_k")
    sums = ranked.groupBy(*keys).agg(
        F.sum("_k").alias("_n"), F.sum(k * a * b).alias("_ab"),
        F.sum(k * a * a).alias("_aa"), F.sum(k * b * b).alias("_bb"))
    centre = F.col("_n") * (F.col("_n") + 1) * (F.col("_n") + 1) / F.lit(4.0)
    dx, dy = F.col("_aa") - centre, F.col("_bb") - centre
    usable = (F.col("_n") >= 3) & (dx > 0) & (dy > 0)
    return sums.select(*keys, F.when(usable, (F.col("_ab") - centre) / F.sqrt(dx * dy)).alias(out))
