"""Intervals, seeded draws and significance labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.fixed_values import DRAW_STEP
from tidemark.functions.numeric import col

WORD = 0xFFFFFFFF


def wilson(wins, n, z: float = 1.959964) -> dict[str, Column]:
    """Score interval of a proportion; null when it is not defined (STA-1)."""
    wins, n = col(wins).cast("double"), col(n).cast("double")
    usable = (n > 0) & (wins >= 0) & (wins <= n)
    p, z2 = wins / n, z * z
    spread = 1.0 + z2 / n
    centre = (p + z2 / (2.0 * n)) / spread
    half = z * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n)) / spread
    return {"low": F.when(usable, F.greatest(F.lit(0.0), centre - half)),
            "high": F.when(usable, F.least(F.lit(1.0), centre + half))}


def _xor_shift(value: Column, bits: int) -> Column:
    return value.bitwiseXOR(F.shiftright(value, bits))


def _times(a: Column, b: Column) -> Column:
    """Product of two 32-bit words modulo 2**32, in halves so that nothing overflows a long."""
    low = a * b.bitwiseAND(F.lit(0xFFFF))
    high = (a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(WORD))


def uniform_draw(seed: int, k) -> Column:
    """The ``k``-th draw (from 0) of the seeded 32-bit generator, addressed by counter (STA-2).

    Addressing by counter instead of carrying state is what lets the draws of a simulation be
    produced by any task, in any order, and again after a lost executor.
    """
    turn = (col(k).cast("long") + 1).bitwiseAND(F.lit(WORD))
    state = (turn * F.lit(DRAW_STEP) + F.lit(seed & WORD)).bitwiseAND(F.lit(WORD))
    t = _times(_xor_shift(state, 15), state.bitwiseOR(F.lit(1)))
    u = (t + _times(_xor_shift(t, 7), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(WORD))
    t = t.bitwiseXOR(u)
    return _xor_shift(t, 14).cast("double") / float(WORD + 1)


def significance(p) -> Column:
    """Conservative reading of a p-value (STA-4)."""
    p = col(p)
    return (F.when(p.isNull(), "Not testable").when(p <= 0.01, "Unlikely to be chance")
            .when(p <= 0.05, "Possibly real").when(p <= 0.2, "Consistent with chance")
            .otherwise("Indistinguishable from chance"))
