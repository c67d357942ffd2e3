"""Null-safe arithmetic on columns: unknown stays null, never 0, NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    """A column from a name, a column, or None."""
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) \
        else F.lit(value)


def finite(value) -> Column:
    """Any column as a finite double, else null (FN-1)."""
    number = col(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def safe_divide(top, bottom) -> Column:
    """Quotient, null on a zero or missing divisor (FN-2)."""
    return finite(F.try_divide(finite(top), finite(bottom)))


def first_number(*candidates) -> Column:
    """First candidate that is a finite number (FN-9)."""
    return F.coalesce(*[finite(c) for c in candidates])


def clamp(value, low, high) -> Column:
    """Clip into [low, high]; null stays null."""
    value = col(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def half_up(value, digits: int = 0) -> Column:
    """Round halves toward +infinity, also for negatives (unlike ``F.round``)."""
    scale = float(10 ** digits)
    return F.floor(col(value) * scale + 0.5).cast("double") / scale


def clamp_score(value) -> Column:
    """0..100 to one decimal; unknown scores 0 (FN-3)."""
    return F.coalesce(half_up(clamp(finite(value), 0.0, 100.0), 1), F.lit(0.0))


def scale_to_score(value, low: float, high: float) -> Column:
    """Map [low, high] onto 0..100, clipped; an empty range maps to 50 (FN-4)."""
    value = col(value)
    if high == low:
        return F.when(value.isNotNull(), F.lit(50.0))
    return clamp((value - F.lit(float(low))) / F.lit(float(high - low)) * 100.0, 0.0, 100.0)


def liquidity_score(liquidity, bounds) -> Column:
    """Log-scaled depth score (FN-5)."""
    liquidity = col(liquidity)
    low = F.log10(F.lit(float(max(bounds[0], 1))))
    high = F.log10(F.lit(float(max(bounds[1], 10))))
    level = F.log10(F.greatest(liquidity, F.lit(1.0)))
    score = clamp((level - low) / (high - low) * 100.0, 0.0, 100.0)
    return F.when(liquidity <= 0, 0.0).when(liquidity.isNotNull(), score)


def spread_score(spread, bounds) -> Column:
    """Inverted spread score: tight is high (FN-5)."""
    return 100.0 - scale_to_score(spread, bounds[0], bounds[1])


def weighted_mean(value, weight) -> Column:
    """Aggregate: weighted mean over non-null values with positive weight (AGG-8)."""
    value, weight = col(value), col(weight)
    counted = value.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(counted, value * weight)), F.sum(F.when(counted, weight)))


def herfindahl(value) -> Column:
    """Aggregate: concentration of the positive values, 1 = one holding is everything (AGG-7)."""
    value = F.when(col(value) > 0, col(value))
    return F.try_divide(F.sum(value * value), F.sum(value) * F.sum(value))


def total(value) -> Column:
    """Aggregate: sum that is 0, not null, when nothing was summed."""
    return F.coalesce(F.sum(col(value)), F.lit(0.0))


def count_where(condition: Column) -> Column:
    """Aggregate: rows for which the condition holds."""
    return F.count_if(condition)


def epoch(value) -> Column:
    """Whole epoch seconds of a timestamp with or without zone."""
    return F.unix_seconds(col(value).cast("timestamp"))


def hours_between(later, earlier) -> Column:
    """Hours from ``earlier`` to ``later``, both epoch seconds."""
    return (col(later) - col(earlier)).cast("double") / 3600.0


def day_of(seconds) -> Column:
    """UTC day number of epoch seconds, the bucket the prefix operators split hot keys by."""
    return F.floor(col(seconds) / F.lit(86400)).cast("long")


def day_text(seconds) -> Column:
    return F.date_format(F.timestamp_seconds(col(seconds)), "yyyy-MM-dd")


def hour_text(seconds) -> Column:
    return F.date_format(F.timestamp_seconds(col(seconds)), "yyyy-MM-dd'T'HH")


def month_text(seconds) -> Column:
    return F.date_format(F.timestamp_seconds(col(seconds)), "yyyy-MM")


def band_label(value, bands) -> Column:
    """Label of the [low, high) band a value falls in, else null (FN-15)."""
    value = col(value)
    label = F.lit(None).cast("string")
    for name, low, high in reversed(bands):
        inside = F.lit(True)
        if low != float("-inf"):
            inside = inside & (value >= low)
        if high != float("inf"):
            inside = inside & (value < high)
        label = F.when(value.isNotNull() & inside, F.lit(name)).otherwise(label)
    return label
