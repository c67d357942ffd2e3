"""As-of lookups: the last row at or before a time, for keys of any size."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prefix import extreme, scan


def latest_before(df: DataFrame, keys: list[str], ts: str, as_of=None,
                  tie: list[str] | None = None) -> DataFrame:
    """One row per key: the latest at or before ``as_of`` (JOIN-8). Combines map-side."""
    kept = df if as_of is None else df.where(F.col(ts) <= as_of)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(ts, *(tie or []))
    best = kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*")


@dataclass(frozen=True)
class Pick:
    """What an as-of merge takes from a table: columns (output name to column) of its last row that meets ``where``.

    ``tie`` orders the rows of one instant; without a difference there the columns themselves do.
    """

    cols: dict[str, str]
    tie: list[str] = field(default_factory=list)
    where: Column | None = None

    def row(self, ts: str) -> Column:
        ties = [F.col(c).alias(f"_tie{i}") for i, c in enumerate(self.tie)]
        taken = F.struct(F.col(ts).alias("_t"), *ties, *[F.col(c).alias(n) for n, c in self.cols.items()])
        return taken if self.where is None else F.when(self.where, taken)


def asof_each(left: DataFrame, keys: list[str], left_ts: str, seen: list[tuple[DataFrame, str, list[Pick]]],
              bucket_seconds: int = 86400) -> DataFrame:
    """``left`` plus, of every pick of every table in ``seen``, the last row at or before ``left_ts`` (JOIN-6, JOIN-7).

    ``seen`` lists (table, its time, picks); times are epoch seconds. The rows of all tables and those of
    ``left`` go through one scan along each key, so everything is shuffled once; ``left`` is neither
    reduced to its moments nor joined again. A hot key is worked on by as many tasks as it has buckets,
    between which only the last row of every pick travels. Rows with a null time count for nothing;
    moments with a null time or key find nothing and stay.
    """
    picks = [p for *_, each in seen for p in each]
    names = [f"_row{i}" for i in range(len(picks))]
    free = iter(names)
    tables = [rows.where(F.col(ts).isNotNull()).select(
        *keys, F.col(ts).alias("_t"), *[p.row(ts).alias(next(free)) for p in each]) for rows, ts, each in seen]
    asked = left.select(*keys, F.col(left_ts).alias("_t"), F.struct(*left.columns).alias("_ask"))
    rows = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), [*tables, asked])
    # At one instant the rows seen come before the moments asked for; a pick's greatest row has the latest time.
    late = F.col("_ask").isNotNull()
    found = scan(rows, keys, F.floor(F.col("_t") / F.lit(bucket_seconds)), ["_t", late],
                 *[extreme(f"_of{n}", F.col(n), True) for n in names]).where(late)
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return found.select("_ask.*", *[F.when(keyed, F.col(f"_of{n}.{c}")).alias(c)
                                    for n, p in zip(names, picks, strict=True) for c in p.cols])


def asof_last(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
              cols: dict[str, str], tie: list[str] | None = None,
              bucket_seconds: int = 86400) -> DataFrame:
    """``asof_each`` of one table: ``left`` plus ``cols`` of the last ``right`` row at or before ``left_ts`` (JOIN-6)."""
    return asof_each(left, keys, left_ts, [(right, right_ts, [Pick(cols, tie or [])])], bucket_seconds)
