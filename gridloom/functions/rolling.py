"""Rolling sums by prefix difference.

A discrete signal depends on how a float sum was rounded, so the contract is the
difference of two running sums, never a sum over a sliding frame. Both running sum and
lag use one window specification, so any number of them costs one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker_idx").orderBy("seq")


def running_sum(value: Column | str) -> Column:
    return F.sum(value).over(by_ticker().rowsBetween(Window.unboundedPreceding, Window.currentRow))


def lagged(value: Column | str, n: int) -> Column:
    return F.lag(value, n).over(by_ticker())


def rolling(prefix: str, window: int, first: int = 0) -> Column:
    """Sum of the last ``window`` values whose running sum is column ``prefix`` and
    whose first value is at seq ``first``; null before there are so many."""
    return F.when(F.col("seq") >= first + window - 1, F.col(prefix) - F.coalesce(lagged(prefix, window), F.lit(0.0)))
