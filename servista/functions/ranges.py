"""Places of values among sorted bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def place(value: Column, bounds: Sequence[Column]) -> Column:
    """How many of the ascending bounds are at most the value: a tree of comparisons, so a row takes about log2 of them; nulls are last."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < bounds[mid], among(low, mid)).otherwise(among(mid + 1, high))

    return among(0, len(bounds))
