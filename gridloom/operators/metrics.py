"""Risk and annual metrics of daily equity curves (date, equity).

All take the columns that tell curves apart in ``by``, so many curves are one job. The
window over a curve is partitioned by them; a single curve has a row a day.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAYS_A_YEAR, SESSIONS_A_YEAR = 365.2425, 252


def _keys(by: list[str]) -> list:
    return [*by] if by else [F.lit(0)]


def normalised(curve: DataFrame, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """Curves as dates and doubles with one row a date (the last by ``row``, where there
    is such a column). A column that isn't there and a curve of fewer than ``least`` rows
    are refused at once; a date that isn't one and an equity that isn't finite and 0 or
    more fail the job that reads them."""
    by = by or []
    for c in (*by, "date", "equity"):
        if c not in curve.columns:
            raise ValueError(f"a curve needs a column; there is no column {c}")
    if least and curve.limit(least).count() < least:
        raise ValueError("the curve has no row" if least == 1 else f"the curve has fewer than {least} rows")
    day, e = F.substring(F.col("date").cast("string"), 1, 10).try_cast("date"), F.col("equity").try_cast("double")
    bad = e.isNull() | F.isnan(e) | (e < 0) | (e == float("inf"))
    checked = {
        "date": F.when(day.isNull(), F.raise_error(F.lit("date must be a date")).cast("date")).otherwise(day),
        "equity": F.when(bad, F.raise_error(F.lit("equity must be finite and not negative")).cast("double")).otherwise(e),
    }
    curve = curve.withColumns(checked)
    if "row" in curve.columns:
        last = Window.partitionBy(*_keys(by), "date").orderBy(F.desc("row"))
        curve = curve.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth", "row")
    return curve


def drawdown(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(peak, drawdown) of each day, from the curve's own first day."""
    w = Window.partitionBy(*_keys(by or [])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("peak", F.max("equity").over(w))
    return rows.withColumn("drawdown", F.when(F.col("peak") > 0, F.col("equity") / F.col("peak")).otherwise(F.lit(1.0)) - 1)


def risk(curve: DataFrame, initial_cash: float, by: list[str] | None = None) -> DataFrame:
    """total_return, cagr, max_drawdown, annual_volatility, sharpe and calmar; a metric
    that isn't defined is null."""
    by = by or []
    w = Window.partitionBy(*_keys(by)).orderBy("date")
    before = F.lag("equity").over(w)
    daily = F.when(before > 0, F.col("equity") / before - 1)
    rows = drawdown(curve, by).withColumn("daily", daily)
    agg = rows.groupBy(*by).agg(
        F.max_by("equity", "date").alias("final_equity"),
        (F.datediff(F.max("date"), F.min("date")) / DAYS_A_YEAR).alias("years"),
        F.min("drawdown").alias("max_drawdown"),
        F.stddev_samp("daily").alias("sd"),
        F.avg("daily").alias("mean"),
    )
    final = F.col("final_equity")
    agg = agg.withColumn("cagr", F.when((F.col("years") > 0) & (final > 0), F.pow(final / initial_cash, 1 / F.col("years")) - 1))
    root = math.sqrt(SESSIONS_A_YEAR)
    return agg.select(
        *by,
        (final / initial_cash - 1).alias("total_return"),
        "cagr",
        "max_drawdown",
        (F.col("sd") * root).alias("annual_volatility"),
        F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * root).alias("sharpe"),
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).alias("calmar"),
    )


def annual(curve: DataFrame, initial_cash: float, by: list[str] | None = None) -> DataFrame:
    """Returns by year, each from the end of the year before (the first from the initial
    cash). A year is complete if its first day is in January's first seven and its last
    in December from the 28th on."""
    by = by or []
    years = curve.withColumn("year", F.year("date")).groupBy(*by, "year").agg(
        F.max_by("equity", "date").alias("end_equity"), F.min("date").alias("first_observation"), F.max("date").alias("last_observation")
    )
    start = F.lag("end_equity", 1, float(initial_cash)).over(Window.partitionBy(*_keys(by)).orderBy("year"))
    first, last = F.col("first_observation"), F.col("last_observation")
    complete = (F.month(first) == 1) & (F.dayofmonth(first) <= 7) & (F.month(last) == 12) & (F.dayofmonth(last) >= 28)
    rows = years.withColumn("start_equity", start).withColumn("complete_year", complete)
    rows = rows.withColumn("return", F.when(F.col("start_equity") > 0, F.col("end_equity") / F.col("start_equity") - 1))
    return rows.select(*by, "year", "start_equity", "end_equity", "return", (F.col("return") * 100).alias("return_pct"), "first_observation", "last_observation", "complete_year")


def annual_map(years: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(returns): the years' returns as one map of year to return for each curve; a year
    whose return isn't defined is left out."""
    entry = F.when(F.col("return").isNotNull(), F.struct("year", "return"))
    return years.groupBy(*(by or [])).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("returns"))


def complete_year_means(years: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number, arithmetic and geometric mean of complete years' returns; the geometric
    mean is null where a year lost all."""
    r = F.when(F.col("complete_year"), F.col("return"))
    agg = years.groupBy(*(by or [])).agg(F.count(r).alias("complete_years"), F.avg(r).alias("average_return"), F.product(1 + r).alias("growth"), F.min(1 + r).alias("least"))
    geometric = F.when(F.col("least") > 0, F.pow("growth", 1 / F.col("complete_years")) - 1)
    return agg.select(*(by or []), "complete_years", "average_return", geometric.alias("geometric_mean"))


def liquidation(curve_end: DataFrame, fee_bps: float, slippage_bps: float, odd_lot_extra_bps: float) -> DataFrame:
    """What selling the last position would leave: (inferred_close, liquidation_cost,
    liquidation_equity) for rows (equity, cash, shares, holding)."""
    fee, base, extra = fee_bps / 1e4, slippage_bps / 1e4, odd_lot_extra_bps / 1e4
    open_ = (F.col("holding") != "CASH") & (F.col("shares") > 0)
    rows = curve_end.withColumn("inferred_close", F.when(open_, (F.col("equity") - F.col("cash")) / F.col("shares")))
    rows = rows.withColumn("slip", F.col("inferred_close") * (F.lit(base) * F.col("shares") + F.lit(extra) * (F.col("shares") % 100)))
    rows = rows.withColumn("gross", F.col("inferred_close") * F.col("shares") - F.col("slip"))
    rows = rows.withColumn("liquidation_cost", F.coalesce(F.col("slip") + F.col("gross") * fee, F.lit(0.0)))
    return rows.withColumn("liquidation_equity", F.coalesce(F.col("cash") + F.col("gross") - F.col("gross") * fee, F.col("equity"))).drop("slip", "gross")
