"""Gap state, momentum and volatility gate of every candle.

All are expressions over one window specification (a ticker's candles in order), so a
list of periods costs one shuffle and one sort whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.rolling import by_ticker, lagged, rolling, running_sum


def with_gaps(candles: DataFrame) -> DataFrame:
    """Opening gap against the previous close, 0 for a ticker's first candle."""
    gap = F.coalesce(F.col("open") - lagged("close", 1), F.lit(0.0))
    return candles.withColumn("gap", gap)


def _ratios(candles: DataFrame, gaps: Iterable[int]) -> DataFrame:
    rows = with_gaps(candles)
    rows = rows.withColumns({"up": F.greatest("gap", F.lit(0.0)), "down": F.greatest(-F.col("gap"), F.lit(0.0))})
    rows = rows.withColumns({"up_sum": running_sum("up"), "down_sum": running_sum("down")})
    for g in gaps:
        rows = rows.withColumns({f"u{g}": rolling("up_sum", g), f"d{g}": rolling("down_sum", g)})
    ratio = lambda g: F.when(F.col(f"d{g}") == 0, F.lit(1.0)).otherwise(F.lit(100.0) * F.col(f"u{g}") / F.col(f"d{g}"))
    return rows.withColumns({f"ratio{g}": F.when(F.col(f"u{g}").isNotNull(), ratio(g)) for g in gaps})


def _long(rows: DataFrame, parts: list[tuple[dict[str, int], str]], value: str) -> DataFrame:
    """Columns turned into rows: the keys of each part and its column as ``value``."""
    structs = [F.struct(*(F.lit(v).alias(k) for k, v in keys.items()), F.col(column).alias(value)) for keys, column in parts]
    return rows.select("ticker_idx", "ticker", "date", "seq", F.explode(F.array(*structs)).alias("x")).select("ticker_idx", "ticker", "date", "seq", "x.*")


def gap_ratio(candles: DataFrame, gaps: Iterable[int]) -> DataFrame:
    """(gap, ratio): 100 times the sum of upward gaps over that of downward gaps in the
    last ``gap`` candles, 1 without a downward one."""
    gaps = list(gaps)
    return _long(_ratios(candles, gaps), [({"gap_period": g}, f"ratio{g}") for g in gaps], "ratio")


def _lines(candles: DataFrame, gaps: list[int], signals: list[int]) -> DataFrame:
    rows = _ratios(candles, gaps)
    rows = rows.withColumns({f"rsum{g}": running_sum(f"ratio{g}") for g in gaps})
    return rows.withColumns({f"line{g}_{s}": rolling(f"rsum{g}", s, g - 1) / s for g in gaps for s in signals})


def signal_line(candles: DataFrame, gaps: Iterable[int], signals: Iterable[int]) -> DataFrame:
    """(gap, signal, line): mean of the last ``signal`` gap ratios."""
    gaps, signals = list(gaps), list(signals)
    parts = [({"gap_period": g, "signal_period": s}, f"line{g}_{s}") for g in gaps for s in signals]
    return _long(_lines(candles, gaps, signals), parts, "line")


def gap_state(candles: DataFrame, gaps: Iterable[int], signals: Iterable[int]) -> DataFrame:
    """(gap, signal, state): whether the line's last move was up; false before any."""
    gaps, signals = list(gaps), list(signals)
    rows = _lines(candles, gaps, signals)
    moves, states = {}, {}
    for g in gaps:
        for s in signals:
            line, before = F.col(f"line{g}_{s}"), lagged(f"line{g}_{s}", 1)
            moves[f"move{g}_{s}"] = F.when(line > before, 1).when(line < before, 0)
            states[f"state{g}_{s}"] = F.coalesce(F.last(f"move{g}_{s}", ignorenulls=True).over(by_ticker()) == 1, F.lit(False))
    parts = [({"gap_period": g, "signal_period": s}, f"state{g}_{s}") for g in gaps for s in signals]
    return _long(rows.withColumns(moves).withColumns(states), parts, "state")


def momentum(candles: DataFrame, periods: Iterable[int]) -> DataFrame:
    """(momentum, score): change of the close over so many candles of the ticker."""
    periods = list(periods)
    rows = candles.withColumns({f"m{p}": F.col("close") / lagged("close", p) - 1 for p in periods})
    return _long(rows, [({"momentum_period": p}, f"m{p}") for p in periods], "score")


def vol_gate(candles: DataFrame, periods: Iterable[int]) -> DataFrame:
    """(vol, ok): whether the one-pass sample variance of returns is above 0. The first
    candle's return is 0 and counts."""
    periods = list(periods)
    rows = candles.withColumn("ret", F.coalesce(F.col("close") / lagged("close", 1) - 1, F.lit(0.0)))
    rows = rows.withColumns({"s1": running_sum("ret"), "s2": running_sum(F.col("ret") * F.col("ret"))})
    rows = rows.withColumns({f"a{p}": rolling("s1", p) for p in periods} | {f"b{p}": rolling("s2", p) for p in periods})
    ok = {f"ok{p}": F.coalesce((F.col(f"b{p}") - F.col(f"a{p}") * F.col(f"a{p}") / p) / (p - 1) > 0, F.lit(False)) for p in periods}
    return _long(rows.withColumns(ok), [({"vol_period": p}, f"ok{p}") for p in periods], "ok")


def at_decisions(values: DataFrame, schedule: DataFrame) -> DataFrame:
    """Indicator rows on decision dates, with week_idx. A ticker without a candle on the
    very session has no row. The schedule has a row a week, so it is broadcast."""
    weeks = F.broadcast(schedule.select("week_idx", F.col("decision_date").alias("date")))
    return values.join(weeks, "date").drop("date", "seq")


def vol_islands(results: DataFrame, keys: list[str], outcome: list[str]) -> DataFrame:
    """(keys, vols, outcome): runs of neighbouring vol periods that have one outcome, as
    a label: "a..b" for a run, "a" for one period. Gaps and islands: within an outcome the
    period less its rank is constant along a run."""
    rank = F.row_number().over(Window.partitionBy(*keys, *outcome).orderBy("vol_period"))
    rows = results.select(*keys, *outcome, "vol_period", (F.col("vol_period") - rank).alias("island"))
    runs = rows.groupBy(*keys, *outcome, "island").agg(F.min("vol_period").alias("low"), F.max("vol_period").alias("high"))
    label = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("..", "low", "high"))
    return runs.select(*keys, label.alias("vols"), *outcome)


def gate_groups(gates: DataFrame) -> DataFrame:
    """(representative, vol_values, weeks): vol periods whose gates are identical over
    all weeks and tickers, grouped on the whole gate. ``gates``: vol_gate at decisions."""
    cells = F.array_sort(F.collect_list(F.struct("week_idx", "ticker_idx", "ok")))
    by_vol = gates.groupBy("vol_period").agg(cells.alias("gate"))
    groups = by_vol.groupBy("gate").agg(F.array_sort(F.collect_list("vol_period")).alias("vol_values"))
    return groups.select(F.element_at("vol_values", 1).alias("representative"), "vol_values", F.size("gate").alias("cells"))
