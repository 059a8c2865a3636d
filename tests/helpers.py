"""Small markets for the tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom import schemas
from gridloom.operators.ranking import COMBO
from gridloom.plans.market import Market, market


def synthetic(spark: SparkSession, seed: int = 3, tickers: int = 3, days: int = 700, start: str = "2017-01-02", skip: float = 0.0) -> Market:
    """Random walks over business days; ``skip`` is the share of missing candles."""
    draw = np.random.default_rng(seed)
    dates = np.busday_offset(start, np.arange(days))
    rows = []
    for i in range(tickers):
        close = 20 * np.cumprod(1 + draw.normal(0.0003, 0.012, days))
        open_ = close * (1 + draw.normal(0, 0.004, days))
        keep = np.flatnonzero(draw.random(days) >= skip)
        rows += [(i, f"T{i}", dates[k].astype(object), n, float(open_[k]), float(close[k])) for n, k in enumerate(keep)]
    return market(spark.createDataFrame(rows, schemas.CANDLES), tickers)


def fold_input(spark: SparkSession, targets: list[int], opens: list[list[float]], scores: list[list[float | None]] | None = None) -> DataFrame:
    """One combination's weeks as the fold takes them."""
    scores = scores or [[None] * len(opens[0])] * len(targets)
    weeks = [(i, t, o, s) for i, (t, o, s) in enumerate(zip(targets, opens, scores, strict=True))]
    schema = ", ".join(f"{c} int" for c in COMBO) + ", weeks array<struct<week_idx:int,target:int,opens:array<double>,scores:array<double>>>"
    return spark.createDataFrame([(1, 1, 1, 2, weeks)], schema)


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)
