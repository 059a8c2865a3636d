"""Ranking of eligible tickers and the weekly top-1 target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def eligible(states: DataFrame, scores: DataFrame, gates: DataFrame) -> DataFrame:
    """Rows per combination, week and ticker that may be bought: gap state on, gate
    open, momentum known and above 0."""
    base = scores.where("score > 0").join(gates.where("ok"), ["week_idx", "ticker_idx"]).select("momentum_period", "vol_period", "week_idx", "ticker_idx", "score")
    return states.where("state").select("gap_period", "signal_period", "week_idx", "ticker_idx").join(base, ["week_idx", "ticker_idx"])


def ranked(scores: DataFrame) -> DataFrame:
    """Rank by momentum in each week; ties keep the universe's order."""
    order = Window.partitionBy("momentum_period", "week_idx").orderBy(F.desc("score"), "ticker_idx")
    return scores.where("score is not null").withColumn("rank", F.row_number().over(order))


def combinations(gaps: DataFrame, momenta: DataFrame, vols: DataFrame) -> DataFrame:
    """The parameter product of tables of periods."""
    return gaps.crossJoin(momenta).crossJoin(vols)


COMBO = ["gap_period", "signal_period", "momentum_period", "vol_period"]


def top1(candidates: DataFrame, combos: DataFrame, schedule: DataFrame) -> DataFrame:
    """(combo, week_idx, target): the best eligible ticker; null where there is none, so
    that weeks in cash stay."""
    order = Window.partitionBy(*COMBO, "week_idx").orderBy(F.desc("score"), "ticker_idx")
    best = candidates.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    weeks = combos.crossJoin(F.broadcast(schedule.select("week_idx")))
    return weeks.join(best.select(*COMBO, "week_idx", F.col("ticker_idx").alias("target")), [*COMBO, "week_idx"], "left")
