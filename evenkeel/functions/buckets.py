"""Buckets by ascending thresholds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of a lookup table, for each threshold, at most.
CELLS = 4


def _longs(values: Sequence[int]) -> Column:
    """An array of longs as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bucket_of(value: Column, thresholds: Sequence[int]) -> Column:
    """How many thresholds are at or below ``value``; 0 for null.

    Thresholds that are about evenly spaced are looked up by arithmetic, in generated
    code: a cell as wide as the smallest gap holds one threshold at most, so a table of
    cells gives the number to within one. Others take about two square roots of them.
    """
    t = list(thresholds)
    if not t:
        return F.lit(0)
    v = value.cast("long")
    gap = min((b - a for a, b in zip(t, t[1:], strict=False)), default=1)
    if gap > 0 and (t[-1] - t[0]) // gap <= CELLS * len(t):
        if len(t) == 1 or all(b - a == gap for a, b in zip(t, t[1:], strict=False)):
            number = F.least(_div(v - t[0], gap) + 1, F.lit(len(t)).cast("long"))
        else:
            cells, k = [], 0
            for cell in range((t[-1] - t[0]) // gap + 1):
                while k < len(t) and t[k] <= t[0] + cell * gap:
                    k += 1
                cells.append(k)
            below = F.get(_longs(cells), F.least(_div(v - t[0], gap), F.lit(len(cells) - 1).cast("long")).cast("int"))
            # the next threshold may lie inside the cell
            number = below + F.when(v >= F.get(_longs([*t, (1 << 63) - 1]), below.cast("int")), 1).otherwise(0)
        return F.when(v >= t[0], number).otherwise(0).cast("int")
    step = max(1, math.isqrt(len(t)))
    every, lasts = _longs(t), _longs(t[step - 1 :: step])
    runs = F.size(F.filter(lasts, lambda x: x <= v))
    within = F.size(F.filter(F.slice(every, runs * step + 1, F.lit(step)), lambda x: x <= v))
    return F.when(v.isNull(), F.lit(0)).otherwise(runs * step + within)


def _div(value: Column, by: int) -> Column:
    """Whole division of a non-negative long."""
    return value if by == 1 else F.call_function("div", value, F.lit(by).cast("long"))
