"""How a grid's results lie around its winner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranking import COMBO
from gridloom.operators.topk import order, top_k

POINTS = (0.0, 0.5, 0.9, 0.99, 0.999, 1.0)
AXES = ["gap_period", "signal_period", "momentum_period"]


def quantiles(results: DataFrame, points: tuple[float, ...] = POINTS) -> DataFrame:
    """(point, total_return): exact, linear between neighbours."""
    agg = results.agg(F.percentile("total_return", F.array(*map(F.lit, points))).alias("q"))
    return agg.select(F.explode(F.arrays_zip(F.array(*map(F.lit, points)).alias("point"), F.col("q").alias("total_return"))).alias("x")).select("x.*")


def _winner(results: DataFrame) -> DataFrame:
    names = [*COMBO, "final_equity", "total_return"]
    return F.broadcast(top_k(results, 1).select(*(F.col(c).alias(f"best_{c}") for c in names)))


def neighbourhood(results: DataFrame, radius: int = 2) -> DataFrame:
    """Statistics of the combinations at most ``radius`` from the winner on each axis."""
    near = results.crossJoin(_winner(results))
    for c in AXES:
        near = near.where(F.abs(F.col(c) - F.col(f"best_{c}")) <= radius)
    near = near.where(F.col("vol_period") == F.col("best_vol_period"))
    top = results.agg(F.percentile("total_return", F.lit(0.99)).alias("q99"))
    r = F.col("total_return")
    stats = near.crossJoin(F.broadcast(top)).agg(
        F.count("*").alias("count"),
        F.percentile("total_return", F.lit(0.5)).alias("median_return"),
        F.avg(r).alias("mean_return"),
        F.min(r).alias("min_return"),
        F.max(r).alias("max_return"),
        F.stddev_samp(r).alias("std_return"),
        F.avg((r > 0).cast("int")).alias("share_positive"),
        F.avg((r >= F.col("q99")).cast("int")).alias("share_top_1pct"),
        F.max("best_total_return").alias("best"),
    )
    multiple = F.when(F.col("median_return") > -1, (1 + F.col("best")) / (1 + F.col("median_return")))
    return stats.withColumn("winner_vs_median", multiple).drop("best")


def axis_neighbours(results: DataFrame) -> DataFrame:
    """The combinations one step from the winner on one axis, where they were run."""
    steps = [(f"{c.removesuffix('_period')}{d:+d}", c, d) for c in AXES for d in (-1, 1)]
    moved = [F.struct(F.lit(name).alias("direction"), *((F.col(f"best_{c}") + (d if c == axis else 0)).alias(c) for c in AXES), F.col("best_vol_period").alias("vol_period")) for name, axis, d in steps]
    keys = _winner(results).select("best_final_equity", F.explode(F.array(*moved)).alias("x")).select("best_final_equity", "x.*")
    rows = results.join(F.broadcast(keys), COMBO)
    multiple = F.when(F.col("final_equity") > 0, F.col("best_final_equity") / F.col("final_equity"))
    return rows.select("direction", *COMBO, "total_return", "final_equity", multiple.alias("winner_multiple"))


def concentration(results: DataFrame, share: float = 0.001, top: int = 10) -> DataFrame:
    """(axis, value, share): how often each period is among the best rows, ties by value."""
    n = max(1, -int(-results.count() * share // 1))
    best = results.orderBy(*order()).limit(n)
    axes = F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(c).alias("value")) for c in AXES)))
    counts = best.select(axes.alias("x")).select("x.*").groupBy("axis", "value").agg((F.count("*") / F.lit(n)).alias("share"))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("share"), "value"))
    return counts.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")
