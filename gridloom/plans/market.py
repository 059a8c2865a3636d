"""A market's tables and the plans that run a grid over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.config import Costs, Grid
from gridloom.operators import indicators, portfolio, ranking, schedule


@dataclass
class Market:
    candles: DataFrame
    calendar: DataFrame
    weeks: DataFrame
    tickers: int
    start: str | None = None
    end: str | None = None


def market(candles: DataFrame, tickers: int, calendar: DataFrame | None = None, start: str | None = None, end: str | None = None) -> Market:
    """With an official calendar a candle outside it fails; without one the calendar is
    every day on which some ticker traded. The calendar ends with ``end``."""
    if calendar is None:
        calendar = schedule.observed_calendar(candles)
    elif schedule.outside(candles, calendar).limit(1).count():
        raise ValueError("there are candles on days outside the calendar")
    if end:
        calendar = calendar.where(F.col("session_date") <= F.to_date(F.lit(end)))
    return Market(candles, calendar, schedule.weekly_schedule(calendar, start, end), tickers, start, end)


def periods(spark, grid: Grid) -> DataFrame:
    """The parameter product as a table."""
    one = lambda name, values: spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    gaps = one("gap_period", grid.gaps).crossJoin(one("signal_period", grid.signals))
    return ranking.combinations(gaps, one("momentum_period", grid.momenta), one("vol_period", grid.vols))


def candidates(m: Market, grid: Grid) -> DataFrame:
    """Eligible tickers by combination and week."""
    at = lambda values: indicators.at_decisions(values, m.weeks)
    states = at(indicators.gap_state(m.candles, grid.gaps, grid.signals))
    return ranking.eligible(states, at(indicators.momentum(m.candles, grid.momenta)), at(indicators.vol_gate(m.candles, grid.vols)))


def targets(m: Market, grid: Grid) -> DataFrame:
    return ranking.top1(candidates(m, grid), periods(m.candles.sparkSession, grid), m.weeks)


def decisions(m: Market, grid: Grid) -> DataFrame:
    """(decision_date, ticker, gap_state, momentum, vol_valid, selected_top1) of a grid of
    one combination: what each ticker with a candle at a decision showed, and what was
    chosen (CASH for nothing)."""
    at = lambda values: indicators.at_decisions(values, m.weeks)
    names = m.candles.select("ticker_idx", "ticker").distinct()
    rows = at(indicators.gap_state(m.candles, grid.gaps, grid.signals)).select("week_idx", "ticker_idx", F.col("state").alias("gap_state"))
    rows = rows.join(at(indicators.momentum(m.candles, grid.momenta)).select("week_idx", "ticker_idx", F.col("score").alias("momentum")), ["week_idx", "ticker_idx"])
    rows = rows.join(at(indicators.vol_gate(m.candles, grid.vols)).select("week_idx", "ticker_idx", F.col("ok").alias("vol_valid")), ["week_idx", "ticker_idx"])
    chosen = targets(m, grid).select("week_idx", F.col("target").alias("target_idx")).join(F.broadcast(names.select(F.col("ticker_idx").alias("target_idx"), F.col("ticker").alias("selected_top1"))), "target_idx", "left")
    weeks = F.broadcast(m.weeks.select("week_idx", "decision_date"))
    rows = rows.join(F.broadcast(names), "ticker_idx").join(weeks, "week_idx").join(chosen, "week_idx", "left")
    return rows.select("decision_date", "ticker", "gap_state", "momentum", "vol_valid", F.coalesce("selected_top1", F.lit("CASH")).alias("selected_top1"))


def week_arrays(m: Market, grid: Grid) -> DataFrame:
    prices = portfolio.execution_prices(m.candles, m.weeks, m.tickers)
    return portfolio.weeks(periods(m.candles.sparkSession, grid), candidates(m, grid), prices, m.tickers)


def backtest(m: Market, grid: Grid, costs: Costs, shard: int = 0) -> DataFrame:
    """A result row for each combination of the grid."""
    folded = portfolio.fold(week_arrays(m, grid), costs)
    return portfolio.results(folded, portfolio.final_close(m.candles, m.end), m.candles.where(F.col("date") <= F.to_date(F.lit(m.end))) if m.end else m.candles, m.weeks, costs, shard)
