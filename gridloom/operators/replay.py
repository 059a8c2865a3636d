"""Daily equity curves of chosen combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import Costs
from gridloom.operators.ranking import COMBO


def filled_closes(candles: DataFrame, calendar: DataFrame) -> DataFrame:
    """(date, ticker_idx, ticker, close, traded): on every session each ticker's last
    close so far; null before its first candle. Partitioned by ticker."""
    names = candles.select("ticker_idx", "ticker").distinct()
    days = calendar.select(F.col("session_date").alias("date")).crossJoin(F.broadcast(names))
    met = days.join(candles.select("ticker_idx", "date", "close"), ["ticker_idx", "date"], "left")
    w = Window.partitionBy("ticker_idx").orderBy("date")
    return met.select("date", "ticker_idx", "ticker", F.last("close", ignorenulls=True).over(w).alias("close"), F.last(F.when(F.col("close").isNotNull(), F.col("date")), ignorenulls=True).over(w).alias("traded"))


def curves(history: DataFrame, candles: DataFrame, calendar: DataFrame, weeks: DataFrame, costs: Costs, start: str | None = None) -> DataFrame:
    """(combo, date, equity, cash, holding, shares, weekly_target): a row a session from
    ``start`` on. The target is the intended one on execution days, whether or not it
    could be bought, and the holding on others."""
    days = calendar.select(F.col("session_date").alias("date"))
    if start:
        days = days.where(F.col("date") >= F.to_date(F.lit(start)))
    combos = history.select(*COMBO).distinct()
    after = history.join(F.broadcast(weeks.select("week_idx", F.col("execution_date").alias("date"))), "week_idx").select(*COMBO, "date", "aimed", "p")
    rows = combos.crossJoin(F.broadcast(days)).join(after, [*COMBO, "date"], "left")
    p = F.last("p", ignorenulls=True).over(Window.partitionBy(*COMBO).orderBy("date"))
    rows = rows.withColumn("p", p)
    rows = rows.select(*COMBO, "date", "aimed", F.coalesce("p.cash", F.lit(float(costs.initial_cash))).alias("cash"), F.coalesce("p.shares", F.lit(0)).cast("long").alias("shares"), F.coalesce("p.holding", F.lit(-1)).alias("holding_idx"))
    closes = filled_closes(candles, calendar).select("date", F.col("ticker_idx").alias("holding_idx"), F.col("ticker").alias("held"), "close")
    rows = rows.join(closes, ["date", "holding_idx"], "left")
    names = F.broadcast(candles.select(F.col("ticker_idx").alias("target_idx"), F.col("ticker").alias("aim")).distinct())
    rows = rows.withColumn("target_idx", F.coalesce("aimed", "holding_idx")).join(names, "target_idx", "left")
    unpriced = (F.col("holding_idx") >= 0) & F.col("close").isNull()
    mark = F.when(unpriced, F.raise_error(F.lit("an open position has no price")).cast("double")).otherwise(F.coalesce(F.col("shares") * F.col("close"), F.lit(0.0)))
    return rows.select(*COMBO, "date", (F.col("cash") + mark).alias("equity"), "cash", F.coalesce("held", F.lit("CASH")).alias("holding"), "shares", F.coalesce("aim", F.lit("CASH")).alias("weekly_target"))


def reconcile(results: DataFrame, curve: DataFrame, history: DataFrame) -> DataFrame:
    """Result rows against the replay: one boolean a check."""
    from gridloom.functions.money import close_to

    end = curve.groupBy(*COMBO).agg(F.max_by(F.struct("equity", "holding"), "date").alias("c"))
    last = history.groupBy(*COMBO).agg(F.max_by("p", "week_idx").alias("p"))
    met = results.join(end, COMBO).join(last, COMBO)
    checks = {
        "final_equity_ok": close_to(F.col("final_equity"), F.col("c.equity")),
        "fees_ok": close_to(F.col("fees_paid"), F.col("p.fees")),
        "slippage_ok": close_to(F.col("slippage_impact"), F.col("p.slip")),
        "trades_ok": F.col("trades") == F.col("p.trades"),
        "skipped_ok": F.col("skipped_executions") == F.col("p.skipped"),
        "holding_ok": F.col("final_holding") == F.col("c.holding"),
    }
    return met.select(*COMBO, *(c.alias(k) for k, c in checks.items()))
