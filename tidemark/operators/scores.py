"""Weighted combination of score components with penalties (SCR-0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, half_up


def attach_score(df: DataFrame, name: str, components: dict[str, tuple[float, Column]],
                 penalties: dict[str, Column], keep_detail: bool = True) -> DataFrame:
    """Add ``name``, ``name_base``, ``name_penalty`` and the detail arrays to ``df``.

    A component that is null gives its weight to the others. Each contribution is rounded to one
    decimal before summing, and each penalty is a column of points to subtract, null when it does
    not apply. Every ``name_<component>`` column keeps the component's own 0..100 value.
    """
    value = {k: f"_v_{k}" for k in components}
    points = {k: f"_p_{k}" for k in penalties}
    staged = df.withColumns({value[k]: clamp(c, 0.0, 100.0) for k, (_, c) in components.items()}
                            | {points[k]: c.cast("double") for k, c in penalties.items()})
    available = sum((F.when(F.col(value[k]).isNotNull(), float(w)).otherwise(0.0)
                     for k, (w, _) in components.items()), F.lit(0.0))
    staged = staged.withColumn("_available", available)
    part = {k: f"_c_{k}" for k in components}
    staged = staged.withColumns({
        part[k]: F.when(
            F.col(value[k]).isNotNull(),
            half_up(F.col(value[k]) * (F.lit(float(w)) / F.col("_available") * 100.0) / 100.0, 1))
        .otherwise(0.0) for k, (w, _) in components.items()})
    base = half_up(clamp(sum((F.col(part[k]) for k in components), F.lit(0.0)), 0.0, 100.0), 1)
    taken = sum((F.coalesce(F.col(points[k]), F.lit(0.0)) for k in penalties), F.lit(0.0))
    staged = staged.withColumns({f"{name}_base": base, "_taken": taken})
    out = {
        name: half_up(clamp(F.col(f"{name}_base") - F.col("_taken"), 0.0, 100.0), 1),
        f"{name}_penalty": half_up(-F.col("_taken"), 1),
        **{f"{name}_{k}": half_up(F.col(value[k]), 1) for k in components},
    }
    if keep_detail:
        out[f"{name}_components"] = F.array(*[
            F.struct(F.lit(k).alias("key"), half_up(F.col(value[k]), 1).alias("value"),
                     F.lit(float(w)).alias("weight"), F.col(part[k]).alias("contribution"))
            for k, (w, _) in components.items()])
        out[f"{name}_penalties"] = F.array_compact(F.array(*[
            F.when(F.col(points[k]).isNotNull(),
                   F.struct(F.lit(k).alias("key"), (-F.col(points[k])).alias("points")))
            for k in penalties]))
    drop = [*value.values(), *points.values(), *part.values(), "_available", "_taken"]
    return staged.withColumns(out).drop(*drop)


def points_if(condition: Column, points: float) -> Column:
    """A penalty of fixed points under a condition."""
    return F.when(condition, float(points))
