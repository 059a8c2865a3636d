"""The weekly portfolio as a fold inside the JVM.

A combination's weeks become one sorted array of structs, and ``aggregate`` carries the
portfolio over it. Prices and scores of a week are arrays by ticker, because which of
them a step needs depends on what is held. The fold runs in parallel over combinations;
each array has as many entries as there are weeks, so memory per row is bounded by the
calendar, not by the number of combinations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.config import Costs
from gridloom.functions.money import affordable, let, purchase, slippage
from gridloom.operators.ranking import COMBO

STATE = {"cash": "double", "shares": "bigint", "holding": "int", "trades": "int", "skipped": "int", "fees": "double", "slip": "double"}


def execution_prices(candles: DataFrame, schedule: DataFrame, tickers: int) -> DataFrame:
    """(week_idx, opens): open prices on the execution date by ticker, null without a candle."""
    weeks = F.broadcast(schedule.select("week_idx", F.col("execution_date").alias("date")))
    met = candles.join(weeks, "date").groupBy("week_idx").agg(F.map_from_entries(F.collect_list(F.struct("ticker_idx", "open"))).alias("m"))
    return schedule.select("week_idx").join(met, "week_idx", "left").select("week_idx", _by_ticker("m", tickers).alias("opens"))


def _by_ticker(column: str, tickers: int) -> Column:
    """A map ticker_idx -> value as an array with a null for each absent ticker."""
    return F.transform(F.sequence(F.lit(0), F.lit(tickers - 1)), lambda i: F.try_element_at(F.coalesce(F.col(column), F.expr("map(-1, cast(null as double))")), i))


def final_close(candles: DataFrame, end: str | None = None) -> DataFrame:
    """(ticker_idx, final_close): the last close at or before the end."""
    rows = candles.where(F.col("date") <= F.to_date(F.lit(end))) if end else candles
    return rows.groupBy("ticker_idx").agg(F.max_by("close", "date").alias("final_close"))


def weeks(combos: DataFrame, candidates: DataFrame, prices: DataFrame, tickers: int) -> DataFrame:
    """A row per combination with its weeks: (week_idx, target, opens, scores), where
    scores holds the momentum of eligible tickers and target is the best of them, the
    first in the universe's order where several are. Both come from one aggregation, so
    the candidates are computed once."""
    entry, best = F.struct("ticker_idx", "score"), F.struct("score", (-F.col("ticker_idx")).alias("before"))
    able = candidates.groupBy(*COMBO, "week_idx").agg(F.map_from_entries(F.collect_list(entry)).alias("m"), F.max(best).alias("top"))
    rows = combos.crossJoin(F.broadcast(prices)).join(able, [*COMBO, "week_idx"], "left")
    week = F.struct("week_idx", F.coalesce(-F.col("top.before"), F.lit(-1)).alias("target"), "opens", _by_ticker("m", tickers).alias("scores"))
    return rows.groupBy(*COMBO).agg(F.array_sort(F.collect_list(week)).alias("weeks"))


def _at(values: Column, i: Column) -> Column:
    return F.when(i >= 0, F.try_element_at(values, i + 1))


def start(cash: float) -> Column:
    values = {"cash": cash, "shares": 0, "holding": -1, "trades": 0, "skipped": 0, "fees": 0.0, "slip": 0.0}
    return F.struct(*(F.lit(v).cast(STATE[k]).alias(k) for k, v in values.items()))


def aim(p: Column, w: Column) -> Column:
    """The week's target, or the incumbent where it ties the target's score."""
    held_score, top_score = _at(w["scores"], p["holding"]), _at(w["scores"], w["target"])
    tie = (p["holding"] >= 0) & (w["target"] >= 0) & F.coalesce(held_score == top_score, F.lit(False))
    return F.when(tie, p["holding"]).otherwise(w["target"])


def step(costs: Costs):
    """The merge function of the fold: portfolio and week to portfolio.

    The same target: nothing is done. Another one: both orders are checked first; if the
    sale or the purchase can't be made nothing is done but to count it. An incumbent
    that ties the target's score exactly is kept.
    """
    fee, base, extra = costs.rates

    def merge(p: Column, w: Column) -> Column:
        return let(aim(p, w), lambda target: F.when(target == p["holding"], _typed(p)).otherwise(trade(p, w, target)))

    def trade(p: Column, w: Column, target: Column) -> Column:
        sold = _at(w["opens"], p["holding"])
        slip = F.when(p["holding"] >= 0, slippage(sold, p["shares"], base, extra)).otherwise(F.lit(0.0))
        sale = let(slip, lambda s: let(F.when(p["holding"] >= 0, sold * p["shares"] - s).otherwise(F.lit(0.0)), lambda gross: F.struct(s.alias("slip"), (gross * F.lit(fee)).alias("fee"), (p["cash"] + (gross - gross * F.lit(fee))).alias("cash"))))
        return let(sale, lambda s: buy(p, w, target, sold, s))

    def buy(p: Column, w: Column, target: Column, sold: Column, s: Column) -> Column:
        price = _at(w["opens"], target)
        quantity = F.when(target >= 0, affordable(s["cash"], price, fee, base, extra)).otherwise(F.lit(0).cast("long"))
        return let(F.coalesce(quantity, F.lit(0).cast("long")), lambda q: settle(p, target, sold, s, price, q))

    def settle(p: Column, target: Column, sold: Column, s: Column, price: Column, q: Column) -> Column:
        sellable = (p["holding"] < 0) | F.coalesce(sold > 0, F.lit(False))
        buyable = (target < 0) | (F.coalesce(price > 0, F.lit(False)) & (q > 0))
        gross = F.when(target >= 0, purchase(price, q, base, extra)).otherwise(F.lit(0.0))
        done = let(gross, lambda g: _struct(
            F.when(target >= 0, F.greatest(s["cash"] - g - g * F.lit(fee), F.lit(0.0))).otherwise(s["cash"]),
            q,
            target,
            p["trades"] + (p["holding"] >= 0).cast("int") + (target >= 0).cast("int"),
            p["skipped"],
            p["fees"] + s["fee"] + g * F.lit(fee),
            p["slip"] + s["slip"] + F.when(target >= 0, slippage(price, q, base, extra)).otherwise(F.lit(0.0)),
        ))
        stay = _struct(p["cash"], p["shares"], p["holding"], p["trades"], p["skipped"] + 1, p["fees"], p["slip"])
        return F.when(sellable & buyable, done).otherwise(stay)

    return merge


def _struct(*values: Column) -> Column:
    return F.struct(*(v.cast(t).alias(k) for (k, t), v in zip(STATE.items(), values, strict=True)))


def _typed(p: Column) -> Column:
    return _struct(*(p[k] for k in STATE))


def fold(combos: DataFrame, costs: Costs) -> DataFrame:
    """Each combination's portfolio after its last week, in column ``p``."""
    return combos.select(*COMBO, F.aggregate("weeks", start(costs.initial_cash), step(costs)).alias("p"))


def history(combos: DataFrame, costs: Costs) -> DataFrame:
    """Each combination's portfolio after each week: (combo, week_idx, aimed, p)."""
    merge = step(costs)
    entry = "array<struct<week_idx:int,aimed:int,p:struct<" + ",".join(f"{k}:{t}" for k, t in STATE.items()) + ">>>"
    zero = F.struct(start(costs.initial_cash).alias("p"), F.array().cast(entry).alias("log"))

    def keep(acc: Column, w: Column) -> Column:
        after = let(merge(acc["p"], w), lambda p: F.struct(p.alias("p"), F.struct(w["week_idx"].alias("week_idx"), aim(acc["p"], w).alias("aimed"), p.alias("p")).alias("entry")))
        return let(after, lambda x: F.struct(x["p"].alias("p"), F.concat(acc["log"], F.array(x["entry"])).alias("log")))

    logged = combos.select(*COMBO, F.aggregate("weeks", zero, keep, lambda acc: acc["log"]).alias("log"))
    return logged.select(*COMBO, F.explode("log").alias("x")).select(*COMBO, "x.*")


def results(folded: DataFrame, closes: DataFrame, candles: DataFrame, schedule: DataFrame, costs: Costs, shard: int = 0) -> DataFrame:
    """A result row for each combination; open positions are marked at the final close."""
    names = F.broadcast(candles.select("ticker_idx", "ticker").distinct().join(closes, "ticker_idx"))
    span = schedule.agg(F.min("execution_date").alias("start"))
    end = candles.agg(F.max("date").alias("end"))
    rows = folded.join(names, F.col("p.holding") == F.col("ticker_idx"), "left").crossJoin(F.broadcast(span)).crossJoin(F.broadcast(end))
    invalid = (F.col("p.holding") >= 0) & ~F.coalesce(F.col("final_close") > 0, F.lit(False))
    broken = (F.col("p.cash") < -1e-7) | (F.col("p.shares") < 0) | ((F.col("p.holding") < 0) != (F.col("p.shares") == 0))
    mark = F.when(F.col("p.holding") >= 0, F.col("p.shares") * F.col("final_close")).otherwise(F.lit(0.0))
    equity = F.when(invalid | broken, F.raise_error(F.lit("a portfolio breaks its invariants"))).otherwise(F.col("p.cash") + mark)
    return rows.withColumn("final_equity", equity.cast("double")).select(
        *COMBO,
        "final_equity",
        (F.col("final_equity") / costs.initial_cash - 1).alias("total_return"),
        F.col("p.trades").alias("trades"),
        F.col("p.skipped").alias("skipped_executions"),
        F.col("p.fees").alias("fees_paid"),
        F.col("p.slip").alias("slippage_impact"),
        F.coalesce("ticker", F.lit("CASH")).alias("final_holding"),
        "start",
        "end",
        F.lit(shard).alias("shard"),
    )
