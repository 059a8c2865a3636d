"""Exact top-K under a total order, so ties never decide by chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranking import COMBO


def order() -> list:
    """Equity downwards, then the parameters upwards."""
    return [F.desc("final_equity"), *(F.asc(c) for c in COMBO)]


def top_k(results: DataFrame, k: int, dedupe_equivalent: bool = False) -> DataFrame:
    """The best k rows in order. Spark keeps k rows per task and merges them.

    dedupe_equivalent: of the vol periods with the same outcome for one (gap, signal,
    momentum) keep the smallest, so that one combination doesn't fill the list."""
    if dedupe_equivalent:
        same = Window.partitionBy("gap_period", "signal_period", "momentum_period", "final_equity", "trades").orderBy("vol_period")
        results = results.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")
    return results.orderBy(*order()).limit(k)


def top_k_per(results: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k rows for each value of ``keys``, with their rank."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order()))).where(F.col("rank") <= k)


def merge_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """Global top-k of local ones: exact, as every global leader leads its part."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return top_k(every, k)
