"""All named queries over the demonstration market, each with its DuckDB twin where SQL
can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.config import Costs, Grid, required_warmup
from gridloom.functions.money import affordable
from gridloom.operators import audits, indicators, metrics, portfolio, ranking, replay, robustness, schedule, topk
from gridloom.operators.ranking import COMBO
from gridloom.plans import grid as vector
from gridloom.plans import oracle as o
from gridloom.plans import walk_forward as wf
from gridloom.plans.market import Market, backtest, candidates, decisions, market, targets, week_arrays
from gridloom.sources.candles import clean, demo_candles
from gridloom.streaming.bars import daily_bars

TICKERS = 8
COSTS = Costs(initial_cash=100_000.0)
GRID = Grid((5, 10), (2, 3), (5, 10), (21,))
WIDE = Grid((5, 6, 7), (2, 3, 4), (5, 6, 7), (21,))
ONE = Grid((5,), (2,), (10,), (21,))
VOLS = (2, 5, 21)
START, END = "1996-01-01", "2001-06-30"
WINDOWS = [
    wf.WindowRow("w1", "1995-01-01", "1996-12-31", "1997-01-01", "1997-12-31", (5, 2, 10, 21)),
    wf.WindowRow("w2", "1996-01-01", "1997-12-31", "1998-01-01", "1998-12-31", (10, 3, 5, 21)),
]

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_candles(spark.read.parquet(f"{sf_dir}/orders.parquet"), TICKERS)


def _market(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> Market:
    return market(_candles(spark, sf_dir), TICKERS, start=start, end=end)


def _r(c: str | Column, n: int = 6) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, n).alias(c) if isinstance(c, str) else F.round(column, n)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of the smallest table, best combination first."""
    return topk.top_k(backtest(_market(spark, sf_dir), GRID, COSTS), GRID.size)


_KEYS = "gap_period, signal_period, momentum_period, vol_period"
_RES = f"SELECT {_KEYS}, round(final_equity, 4) AS final_equity, round(total_return, 6) AS total_return, trades, skipped_executions, round(fees_paid, 4) AS fees_paid, round(slippage_impact, 4) AS slippage_impact, final_holding FROM res"


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(*COMBO, _r("final_equity", 4), _r("total_return"), "trades", "skipped_executions", _r("fees_paid", 4), _r("slippage_impact", 4), "final_holding")


def _folded(grid: Grid) -> list[str]:
    return [*o.grid_parts(grid), o.FINAL, o.fold(COSTS)]


# Market and schedule.


@_query(o.query("SELECT week_idx, decision_date, execution_date FROM sch"))
def weekly_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _market(spark, sf_dir).weeks


@_query(o.query("SELECT ticker_idx, ticker, date, seq, open, close FROM c"))
def candle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candles(spark, sf_dir)


@_query(o.query("SELECT session_idx, session_date FROM cal"))
def calendar_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.numbered(schedule.observed_calendar(_candles(spark, sf_dir)))


@_query(o.query("SELECT week_idx, ticker_idx, open FROM sch JOIN c ON c.date = execution_date"))
def exec_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    opens = portfolio.execution_prices(m.candles, m.weeks, TICKERS).select("week_idx", F.posexplode("opens").alias("ticker_idx", "open"))
    return opens.where("open is not null")


@_query(o.query(f"SELECT ticker_idx, max_by(close, date) AS final_close FROM c WHERE date <= DATE '{END}' GROUP BY 1"))
def final_close_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.final_close(_candles(spark, sf_dir), END)


@_query(o.query("SELECT date, ticker_idx, close, traded FROM filled", o.curve(COSTS).split("),\ndays AS")[0] + ")"))
def close_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    return replay.filled_closes(m.candles, m.calendar).select("date", "ticker_idx", "close", "traded")


@_query(o.query("SELECT ticker, date FROM c WHERE date NOT IN (SELECT session_date FROM cal WHERE session_idx % 50 <> 7)"))
def out_of_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    return schedule.outside(m.candles, schedule.numbered(m.calendar).where("session_idx % 50 <> 7")).select("ticker", "date")


@_query(
    """SELECT ticker, date, open, close FROM (
      SELECT 'C' || (o_custkey % 8) AS ticker, CAST(o_orderdate AS DATE) AS date, o_totalprice AS open,
             CASE WHEN o_orderkey % 7 = 0 THEN -1.0 ELSE o_totalprice END AS close
      FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 8, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1)
    WHERE close > 0 AND open > 0"""
)
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = orders.select(
        F.concat(F.lit("C"), F.col("o_custkey") % 8).alias("ticker"),
        F.col("o_orderkey").alias("row"),
        F.col("o_orderdate").cast("string").alias("date"),
        F.col("o_totalprice").cast("string").alias("open"),
        F.when(F.col("o_orderkey") % 7 == 0, "-1").otherwise(F.col("o_totalprice").cast("string")).alias("close"),
    )
    return clean(raw)


# Indicators.


@_query(o.query("SELECT gap_period, ticker_idx, seq, round(ratio, 6) AS ratio FROM rat", o.RUNNING, o.ratios(GRID.gaps)))
def gap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.gap_ratio(_candles(spark, sf_dir), GRID.gaps).where("ratio is not null")
    return rows.select("gap_period", "ticker_idx", "seq", _r("ratio"))


@_query(o.query("SELECT gap_period, signal_period, ticker_idx, seq, round(line, 6) AS line FROM lin WHERE line IS NOT NULL", o.RUNNING, o.ratios(GRID.gaps), o.lines(GRID.signals)))
def signal_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.signal_line(_candles(spark, sf_dir), GRID.gaps, GRID.signals).where("line is not null")
    return rows.select("gap_period", "signal_period", "ticker_idx", "seq", _r("line"))


@_query(o.query("SELECT gap_period, signal_period, ticker_idx, seq, state FROM st WHERE state", o.RUNNING, o.ratios(GRID.gaps), o.lines(GRID.signals)))
def gap_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.gap_state(_candles(spark, sf_dir), GRID.gaps, GRID.signals).where("state")
    return rows.select("gap_period", "signal_period", "ticker_idx", "seq", "state")


@_query(o.query("SELECT momentum_period, ticker_idx, seq, round(score, 6) AS score FROM mom WHERE score IS NOT NULL", o.momenta(GRID.momenta)))
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.momentum(_candles(spark, sf_dir), GRID.momenta).where("score is not null")
    return rows.select("momentum_period", "ticker_idx", "seq", _r("score"))


@_query(o.query("SELECT vol_period, ticker_idx, seq, ok FROM vol", o.RUNNING, o.gates(VOLS)))
def vol_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.vol_gate(_candles(spark, sf_dir), VOLS).select("vol_period", "ticker_idx", "seq", "ok")


@_query(
    o.query(
        """SELECT min(vol_period) AS representative, array_to_string(list_sort(list(vol_period)), ',') AS vols, any_value(n) AS cells
        FROM (SELECT vol_period, list(week_idx || ':' || ticker_idx || ':' || ok ORDER BY week_idx, ticker_idx) AS gate, count(*) AS n
              FROM vol JOIN c USING (ticker_idx, seq) JOIN sch ON decision_date = c.date GROUP BY 1) GROUP BY gate""",
        o.RUNNING,
        o.gates(VOLS),
    )
)
def gate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    groups = indicators.gate_groups(indicators.at_decisions(indicators.vol_gate(m.candles, VOLS), m.weeks))
    return groups.select("representative", F.array_join("vol_values", ",").alias("vols"), F.col("cells").cast("long").alias("cells"))


# Ranking and portfolio.


@_query(o.query("SELECT momentum_period, week_idx, ticker_idx, row_number() OVER (PARTITION BY momentum_period, week_idx ORDER BY score DESC, ticker_idx) AS rank FROM mom JOIN c USING (ticker_idx, seq) JOIN sch ON decision_date = c.date WHERE score IS NOT NULL", o.momenta(GRID.momenta)))
def momentum_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    rows = ranking.ranked(indicators.at_decisions(indicators.momentum(m.candles, GRID.momenta), m.weeks))
    return rows.select("momentum_period", "week_idx", "ticker_idx", F.col("rank").cast("long").alias("rank"))


@_query(o.query(f"SELECT {_KEYS}, week_idx, ticker_idx, round(score, 6) AS score FROM cand", *o.grid_parts(GRID)))
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(_market(spark, sf_dir), GRID).select(*COMBO, "week_idx", "ticker_idx", _r("score"))


@_query(o.query(f"SELECT {_KEYS}, week_idx, target FROM tgt", *o.grid_parts(GRID)))
def top1_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(_market(spark, sf_dir), GRID).select(*COMBO, "week_idx", "target")


@_query("SELECT o_orderkey, " + o.quantity("o_totalprice", "CAST(o_orderkey % 997 + 0.37 AS DOUBLE)", COSTS) + " AS shares FROM orders")
def affordable_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = (F.col("o_orderkey") % 997 + F.lit(0.37)).cast("double")
    return orders.select("o_orderkey", affordable(F.col("o_totalprice"), price, *COSTS.rates).alias("shares"))


@_query(o.query(_RES, *_folded(GRID)))
def grid_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(backtest(_market(spark, sf_dir), GRID, COSTS))


@_query(o.query(_RES, *_folded(WIDE)))
def grid_vectorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(vector.grid_results(_market(spark, sf_dir), WIDE, COSTS))


@_query(o.query(f"{_RES} ORDER BY res.final_equity DESC, {_KEYS} LIMIT 5", *_folded(WIDE)))
def grid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(vector.grid_results(_market(spark, sf_dir), WIDE, COSTS, top_k=5))


@_query(o.query(f"SELECT {_KEYS}, rank FROM (SELECT *, row_number() OVER (PARTITION BY gap_period ORDER BY final_equity DESC, {_KEYS}) AS rank FROM res) WHERE rank <= 3", *_folded(WIDE)))
def topk_per_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.top_k_per(vector.grid_results(_market(spark, sf_dir), WIDE, COSTS), ["gap_period"], 3)
    return rows.select(*COMBO, F.col("rank").cast("long").alias("rank"))


@_query("SELECT 0 AS differences")
def tiers_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declarative and the vectorised plan on one grid, to the bit."""
    m = _market(spark, sf_dir)
    differs = vector.agreement(backtest(m, GRID, COSTS), vector.grid_results(m, GRID, COSTS))
    return differs.agg(F.count("*").cast("int").alias("differences"))


# Daily replay and metrics.


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    return replay.curves(portfolio.history(week_arrays(m, ONE), COSTS), m.candles, m.calendar, m.weeks, COSTS)


_CURVE = [*_folded(ONE), o.curve(COSTS)]


@_query(o.query("SELECT date, round(equity, 4) AS equity, round(cash, 4) AS cash, holding, shares, weekly_target FROM curve", *_CURVE))
def daily_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("date", _r("equity", 4), _r("cash", 4), "holding", "shares", "weekly_target")


@_query(o.query(f"SELECT {_KEYS}, true AS ok FROM combo", *o.grid_parts(ONE)))
def replay_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    history = portfolio.history(week_arrays(m, ONE), COSTS)
    checks = replay.reconcile(backtest(m, ONE, COSTS), replay.curves(history, m.candles, m.calendar, m.weeks, COSTS), history)
    ok = F.lit(True)
    for c in checks.columns:
        ok = ok & F.col(c) if c.endswith("_ok") else ok
    return checks.select(*COMBO, ok.alias("ok"))


_DD = "dd AS (SELECT *, max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak, equity / lag(equity) OVER (ORDER BY date) - 1 AS daily FROM curve)"


@_query(o.query("SELECT date, round(peak, 4) AS peak, round(equity / peak - 1, 6) AS drawdown FROM dd", *_CURVE, _DD))
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.drawdown(_curve(spark, sf_dir)).select("date", _r("peak", 4), _r("drawdown"))


@_query(
    o.query(
        f"""SELECT round(total_return, 6) AS total_return, round(cagr, 6) AS cagr, round(mdd, 6) AS max_drawdown, round(sd * sqrt(252), 6) AS annual_volatility,
          round(CASE WHEN sd > 0 THEN mean / sd * sqrt(252) END, 6) AS sharpe, round(CASE WHEN mdd < 0 THEN cagr / abs(mdd) END, 6) AS calmar
        FROM (SELECT *, final / {COSTS.initial_cash!r} - 1 AS total_return, pow(final / {COSTS.initial_cash!r}, 1 / years) - 1 AS cagr
          FROM (SELECT max_by(equity, date) AS final, (max(date) - min(date)) / 365.2425 AS years, min(equity / peak - 1) AS mdd, stddev_samp(daily) AS sd, avg(daily) AS mean FROM dd))""",
        *_CURVE,
        _DD,
    )
)
def risk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.risk(_curve(spark, sf_dir), COSTS.initial_cash)
    return rows.select(*(_r(c) for c in rows.columns))


_YEARS = f"""yr AS (
  SELECT year, end_equity, coalesce(lag(end_equity) OVER (ORDER BY year), {COSTS.initial_cash!r}) AS start_equity, first_observation, last_observation,
    month(first_observation) = 1 AND day(first_observation) <= 7 AND month(last_observation) = 12 AND day(last_observation) >= 28 AS complete_year
  FROM (SELECT CAST(year(date) AS INTEGER) AS year, max_by(equity, date) AS end_equity, min(date) AS first_observation, max(date) AS last_observation FROM curve GROUP BY 1))"""


@_query(o.query("SELECT year, round(start_equity, 4) AS start_equity, round(end_equity, 4) AS end_equity, round(end_equity / start_equity - 1, 6) AS return, first_observation, last_observation, complete_year FROM yr", *_CURVE, _YEARS))
def annual_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.annual(_curve(spark, sf_dir), COSTS.initial_cash)
    return rows.select("year", _r("start_equity", 4), _r("end_equity", 4), _r("return"), "first_observation", "last_observation", "complete_year")


@_query(
    o.query(
        """SELECT count(*) FILTER (complete_year) AS complete_years, round(avg(r) FILTER (complete_year), 6) AS average_return,
          round(pow(product(1 + r) FILTER (complete_year), 1.0 / count(*) FILTER (complete_year)) - 1, 6) AS geometric_mean
        FROM (SELECT *, end_equity / start_equity - 1 AS r FROM yr)""",
        *_CURVE,
        _YEARS,
    )
)
def geo_mean_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.complete_year_means(metrics.annual(_curve(spark, sf_dir), COSTS.initial_cash))
    return rows.select("complete_years", _r("average_return"), _r("geometric_mean"))


@_query(
    o.query(
        f"""SELECT date, holding, round(x, 6) AS inferred_close, round(coalesce(cost + gross * {COSTS.rates[0]!r}, 0.0), 4) AS liquidation_cost,
          round(coalesce(cash + gross - gross * {COSTS.rates[0]!r}, equity), 4) AS liquidation_equity
        FROM (SELECT *, x * shares - cost AS gross FROM (SELECT *, x * ({COSTS.rates[1]!r} * shares + {COSTS.rates[2]!r} * (shares % 100)) AS cost
          FROM (SELECT *, CASE WHEN holding <> 'CASH' AND shares > 0 THEN (equity - cash) / shares END AS x FROM curve)))""",
        *_CURVE,
    )
)
def liquidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.liquidation(_curve(spark, sf_dir), COSTS.fee_bps, COSTS.slippage_bps, COSTS.odd_lot_extra_bps)
    return rows.select("date", "holding", _r("inferred_close"), _r("liquidation_cost", 4), _r("liquidation_equity", 4))


# Robustness.


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.grid_results(_market(spark, sf_dir), WIDE, COSTS)


_BEST = f"best AS (SELECT * FROM res ORDER BY final_equity DESC, {_KEYS} LIMIT 1)"


@_query(o.query("SELECT unnest([0.0, 0.5, 0.9, 0.99, 0.999, 1.0])::DOUBLE AS point, unnest(list_transform(quantile_cont(total_return, [0.0, 0.5, 0.9, 0.99, 0.999, 1.0]), lambda x: round(x, 6))) AS total_return FROM res", *_folded(WIDE)))
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.quantiles(_wide(spark, sf_dir)).select("point", _r("total_return"))


@_query(
    o.query(
        """SELECT count(*) AS count, round(quantile_cont(r.total_return, 0.5), 6) AS median_return, round(avg(r.total_return), 6) AS mean_return,
          round(min(r.total_return), 6) AS min_return, round(max(r.total_return), 6) AS max_return, round(stddev_samp(r.total_return), 6) AS std_return,
          round(avg(CAST(r.total_return > 0 AS INTEGER)), 6) AS share_positive, round(avg(CAST(r.total_return >= q AS INTEGER)), 6) AS share_top_1pct,
          round((1 + any_value(best.total_return)) / (1 + quantile_cont(r.total_return, 0.5)), 6) AS winner_vs_median
        FROM res r, best, (SELECT quantile_cont(total_return, 0.99) AS q FROM res)
        WHERE abs(r.gap_period - best.gap_period) <= 1 AND abs(r.signal_period - best.signal_period) <= 1 AND abs(r.momentum_period - best.momentum_period) <= 1 AND r.vol_period = best.vol_period""",
        *_folded(WIDE),
        _BEST,
    )
)
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = robustness.neighbourhood(_wide(spark, sf_dir), 1)
    return rows.select("count", *(_r(c) for c in rows.columns if c != "count"))


@_query(
    o.query(
        """SELECT d AS direction, r.gap_period, r.signal_period, r.momentum_period, r.vol_period, round(r.final_equity, 4) AS final_equity, round(best.final_equity / r.final_equity, 6) AS winner_multiple
        FROM best, (VALUES ('gap-1', -1, 0, 0), ('gap+1', 1, 0, 0), ('signal-1', 0, -1, 0), ('signal+1', 0, 1, 0), ('momentum-1', 0, 0, -1), ('momentum+1', 0, 0, 1)) v(d, a, b, e)
        JOIN res r ON r.gap_period = best.gap_period + a AND r.signal_period = best.signal_period + b AND r.momentum_period = best.momentum_period + e AND r.vol_period = best.vol_period""",
        *_folded(WIDE),
        _BEST,
    )
)
def axis_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.axis_neighbours(_wide(spark, sf_dir)).select("direction", *COMBO, _r("final_equity", 4), _r("winner_multiple"))


@_query(
    o.query(
        f"""SELECT axis, value, round(count(*) / 6, 6) AS share FROM (
          SELECT unnest(['gap_period', 'signal_period', 'momentum_period']) AS axis, unnest([gap_period, signal_period, momentum_period]) AS value
          FROM (SELECT * FROM res ORDER BY final_equity DESC, {_KEYS} LIMIT 6)) GROUP BY 1, 2""",
        *_folded(WIDE),
    )
)
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the best fifth, as the grid is small."""
    return robustness.concentration(_wide(spark, sf_dir), share=0.2).select("axis", "value", _r("share"))


# Audits.


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table with a missing, an extra and a repeated combination."""
    from gridloom.plans.market import periods

    rows = periods(spark, WIDE)
    extra = rows.where("gap_period = 5 and signal_period = 2 and momentum_period = 5")
    return rows.where("not (gap_period = 7 and signal_period = 4 and momentum_period = 7)").unionByName(extra).unionByName(extra.withColumn("gap_period", F.lit(99)))


@_query("SELECT * FROM (VALUES (5, 2, 5, 21, 2, 'repeated'), (99, 2, 5, 21, 1, 'extra'), (7, 4, 7, 21, NULL, 'missing')) v(gap_period, signal_period, momentum_period, vol_period, rows, problem)")
def grid_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.plans.market import periods

    return audits.grid_coverage(_broken(spark, sf_dir), periods(spark, WIDE)).withColumn("rows", F.col("rows").cast("int"))


@_query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


_SPOILT = {
    "final_equity": "gap_period = 5 AND signal_period = 2",
    "fees_paid": "gap_period = 10 AND signal_period = 3",
    "slippage_impact": "momentum_period = 5 AND gap_period = 5",
    "trades": "momentum_period = 10",
    "final_holding": "signal_period = 3",
    "dates": "gap_period = 10 AND momentum_period = 5 AND signal_period = 2",
}


@_query(
    o.query(
        "SELECT unnest(['final_equity', 'total_return', 'fees_paid', 'slippage_impact', 'trades', 'skipped_executions', 'periods', 'final_holding', 'dates']) AS \"check\", unnest(["
        + ", ".join(f"count(*) FILTER ({_SPOILT.get(k, 'false')})" for k in ("final_equity", "final_equity", "fees_paid", "slippage_impact", "trades", "", "", "final_holding", "dates"))
        + "]) AS bad FROM res",
        *_folded(GRID),
    )
)
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On results that are spoilt in six ways: an equity below 0 that no longer matches
    its return, a fee that isn't a number, an impact below 0, broken trades, an unknown
    holding, and a start after the end."""
    m = _market(spark, sf_dir)
    bad = {k: F.expr(v) for k, v in _SPOILT.items()}
    rows = backtest(m, GRID, COSTS).withColumns(
        {
            "final_equity": F.when(bad["final_equity"], -1.0).otherwise(F.col("final_equity")),
            "fees_paid": F.when(bad["fees_paid"], float("nan")).otherwise(F.col("fees_paid")),
            "slippage_impact": F.when(bad["slippage_impact"], -0.5).otherwise(F.col("slippage_impact")),
            "trades": F.when(bad["trades"], F.col("trades") + 0.5).otherwise(F.col("trades").cast("double")),
            "final_holding": F.when(bad["final_holding"], "NONE").otherwise(F.col("final_holding")),
            "start": F.when(bad["dates"], F.date_add("end", 1)).otherwise(F.col("start")),
        }
    )
    return audits.integrity(rows, COSTS.initial_cash, m.candles.select("ticker").distinct())


@_query(
    """WITH m AS (SELECT DISTINCT CAST(o_custkey % 37 AS INTEGER) AS gap, CAST((o_custkey % 37 + CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END) % 4 AS INTEGER) AS shard FROM orders),
    s AS (SELECT DISTINCT shard, shard < 3 AS run FROM m)
    SELECT 'shard' AS problem, CAST(n AS VARCHAR) AS what FROM range(5) r(n) WHERE n NOT IN (SELECT shard FROM s)
    UNION ALL SELECT 'contract', CAST(count(DISTINCT run) AS VARCHAR) FROM s HAVING count(DISTINCT run) > 1
    UNION ALL SELECT 'gap owned twice', CAST(gap AS VARCHAR) FROM m WHERE gap < 36 GROUP BY gap HAVING count(*) > 1
    UNION ALL SELECT 'unknown gap', '36' FROM m WHERE gap = 36 HAVING count(*) > 0
    UNION ALL SELECT 'gap without owner', CAST(n AS VARCHAR) FROM (SELECT unnest([40, 41]) AS n UNION ALL SELECT n FROM range(36) r(n) WHERE n NOT IN (SELECT gap FROM m))"""
)
def shard_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata derived from the order table, where some gaps have two owners, the last
    shard is missing, one gap isn't expected and two expected ones have no owner."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    gap = (F.col("o_custkey") % 37).cast("int")
    shard = ((gap + F.when(F.col("o_orderkey") % 101 == 0, 1).otherwise(0)) % 4).cast("int")
    meta = orders.select(gap.alias("gap"), shard.alias("shard")).groupBy("shard").agg(F.collect_set("gap").alias("gap_values")).withColumn("run", F.col("shard") < 3)
    gaps = spark.range(36).select(F.col("id").cast("int").alias("gap_period")).union(spark.range(40, 42).select(F.col("id").cast("int")))
    return audits.shard_contract(meta, ["run"], 5, gaps)


@_query(
    """SELECT shard, CASE WHEN n > 0 THEN n END AS rows, tested AS tested_rows FROM (
      SELECT CAST(l_linenumber AS INTEGER) AS shard, count(*) AS n, count(*) FILTER (l_quantity < 50 OR l_linenumber % 2 = 0) AS tested FROM lineitem GROUP BY 1)
    WHERE n <> tested"""
)
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata that miss some rows of the odd shards."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("shard", F.col("l_linenumber").cast("int"))
    meta = rows.groupBy("shard").agg(F.count_if((F.col("l_quantity") < 50) | (F.col("shard") % 2 == 0)).alias("tested_rows"))
    return audits.row_counts(rows, meta)


@_query(
    o.query(
        f"""SELECT ticker, count(*) FILTER (date < DATE '{START}') AS sessions_before, min(date) AS first_date,
          count(*) FILTER (date < DATE '{START}') >= {required_warmup(10, 3, 10, 21)} AS enough FROM c GROUP BY 1"""
    )
)
def warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.warmup(_candles(spark, sf_dir), START, required_warmup(10, 3, 10, 21), 1994).select("ticker", "sessions_before", "first_date", "enough")


@_query(
    o.query(
        f"""SELECT ticker, count(*) FILTER (date BETWEEN DATE '{START}' AND DATE '{END}') AS sessions,
          round(count(*) FILTER (date BETWEEN DATE '{START}' AND DATE '{END}') / any_value(n), 6) AS ratio, any_value(last) - max(date) AS stale_days
        FROM c, (SELECT count(*) AS n, max(session_date) AS last FROM cal WHERE session_date BETWEEN DATE '{START}' AND DATE '{END}') GROUP BY 1"""
    )
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    return audits.coverage(m.candles, m.calendar, START, END).select("ticker", F.col("sessions").cast("long").alias("sessions"), _r("ratio"), F.col("stale_days").cast("long").alias("stale_days"))


_STALE = """stale AS (
  SELECT curve.date, holding, traded, a.session_idx - b.session_idx AS age
  FROM curve JOIN filled ON filled.date = curve.date AND 'T' || filled.ticker_idx = holding JOIN cal a ON a.session_date = curve.date LEFT JOIN cal b ON b.session_date = traded)"""


@_query(o.query("SELECT date, holding, traded AS last_trade_date, age AS stale_sessions FROM stale", *_CURVE, _STALE))
def stale_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    return audits.stale_prices(_curve(spark, sf_dir), m.candles, m.calendar)


@_query(o.query("SELECT (SELECT coalesce(max(age), 0) FROM stale) AS max_stale, (SELECT count(*) FROM stale WHERE age IS NULL OR age > 3) AS warnings, max_by(holding, date) AS terminal_holding, CASE WHEN max_by(holding, date) = 'CASH' THEN 0 ELSE (SELECT max_by(age, date) FROM stale) END AS terminal_stale FROM curve", *_CURVE, _STALE))
def stale_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    curve = _curve(spark, sf_dir)
    return audits.stale_summary(audits.stale_prices(curve, m.candles, m.calendar), curve)


_OVERRIDES = [("T1", "1996-06-01", "1996-05-31", 2.0), ("T2", "1997-03-03", "1997-03-02", 0.5), ("T3", "1998-09-10", "1998-09-09", 4.0)]


@_query(
    o.query(
        f"""SELECT ticker, date, round(ratio, 6) AS close_ratio, EXISTS (SELECT 1 FROM (VALUES {', '.join(f"('{t}', DATE '{d}')" for t, d, *_ in _OVERRIDES)}) v(t, d) WHERE t = ticker AND abs(d - date) <= 5) AS near_override
        FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker_idx ORDER BY date) AS ratio FROM c) WHERE ratio > 3.0 OR ratio < 1 / 3.0"""
    )
)
def extreme_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.createDataFrame(_OVERRIDES, "ticker string, ex_date string, last_date_prior string, split_ratio double")
    return audits.extreme_moves(_candles(spark, sf_dir), events).select("ticker", "date", _r("close_ratio"), "near_override")


_EVENTS = [
    ("T1", "1996-06-01", "1996-05-31", 2.0, "split", "exchange", "https://example.org/1"),
    ("T9", "1996-06-01", "1996-05-31", 2.0, "split", "exchange", "https://example.org/2"),
    ("T2", "1997-03-03", "1997-03-03", 1.0, "split", " ", "http://example.org/3"),
    ("T3", "1998-01-05", "1998-01-02", None, "split", "exchange", "https://example.org/4"),
]

_SPOILT_CANDLES = """raw AS (
  SELECT ticker, seq, CASE WHEN ticker = 'T2' AND seq % 150 = 149 THEN date - 40 ELSE date END AS day, CASE WHEN ticker = 'T6' AND seq % 200 = 3 THEN open * -1 ELSE open END AS open, CASE WHEN ticker = 'T1' AND seq % 100 = 0 THEN NULL ELSE close END AS close
  FROM c WHERE ticker <> 'T5' AND (ticker <> 'T3' OR date <= DATE '1998-01-31') AND (ticker <> 'T4' OR seq < 250)),
few AS (SELECT session_date FROM cal WHERE session_idx % 50 <> 7),
span AS (SELECT max(session_date) AS official_end, count(*) AS sessions FROM few WHERE session_date BETWEEN DATE '1996-01-01' AND DATE '1998-08-09'),
lagged AS (SELECT *, lag(day) OVER w AS before, close / lag(close) OVER w AS ratio FROM raw WINDOW w AS (PARTITION BY ticker ORDER BY seq)),
own AS (
  SELECT ticker, count(*) AS rows, count(*) FILTER (before >= day) AS disorder, count(*) FILTER (close IS NULL OR open <= 0) AS bad_prices, count(*) FILTER (session_date IS NULL) AS outside, max(day) AS last,
    count(DISTINCT day) FILTER (session_date IS NOT NULL AND day BETWEEN DATE '1996-01-01' AND official_end) AS met, count(*) FILTER (moved) AS moves, count(*) FILTER (moved AND NOT coalesce(abs(ex - day) <= 5, false)) AS unexplained
  FROM (SELECT *, ratio > 3.0 OR ratio < 1 / 3.0 AS moved FROM lagged) LEFT JOIN few ON session_date = day LEFT JOIN (VALUES ('T1', DATE '1996-06-01'), ('T2', DATE '1997-03-03'), ('T3', DATE '1998-01-05')) e(t, ex) ON t = ticker, span GROUP BY ticker)"""


@_query(
    o.query(
        """SELECT t.ticker, x.rule, CASE WHEN x.rule LIKE '%moves%' THEN 'diagnostic' ELSE 'blocking' END AS severity, x.evidence FROM (
          SELECT u.ticker, unnest(list_filter([
            CASE WHEN u.ticker = 'T7' THEN {'rule': 'repeated in the universe', 'evidence': '2'} END,
            CASE WHEN rows IS NULL THEN {'rule': 'no candles', 'evidence': NULL} END,
            CASE WHEN disorder > 0 THEN {'rule': 'order', 'evidence': CAST(disorder AS VARCHAR)} END,
            CASE WHEN bad_prices > 0 THEN {'rule': 'prices', 'evidence': CAST(bad_prices AS VARCHAR)} END,
            CASE WHEN outside > 0 THEN {'rule': 'outside the calendar', 'evidence': CAST(outside AS VARCHAR)} END,
            CASE WHEN rows < 300 THEN {'rule': 'history', 'evidence': CAST(rows AS VARCHAR)} END,
            CASE WHEN met / sessions < 0.5 THEN {'rule': 'coverage', 'evidence': CAST(met AS VARCHAR)} END,
            CASE WHEN official_end - last > 10 THEN {'rule': 'stale', 'evidence': CAST(official_end - last AS VARCHAR)} END,
            CASE WHEN moves > 0 THEN {'rule': 'extreme moves', 'evidence': CAST(moves AS VARCHAR)} END,
            CASE WHEN unexplained > 0 THEN {'rule': 'moves without an override', 'evidence': CAST(unexplained AS VARCHAR)} END], lambda x: x IS NOT NULL)) AS x
          FROM (SELECT DISTINCT ticker FROM c) u LEFT JOIN own ON own.ticker = u.ticker, span) t
        UNION ALL SELECT NULL, 'universe', 'blocking', '9'
        UNION ALL SELECT NULL, 'universe members', 'blocking', 'T0,T1'
        UNION ALL SELECT NULL, 'calendar lag', 'blocking', CAST(DATE '1998-08-09' - official_end AS VARCHAR) FROM span WHERE DATE '1998-08-09' - official_end > 4
        UNION ALL SELECT NULL, 'candle lag', 'blocking', CAST(official_end - last AS VARCHAR) FROM span, (SELECT max(last) AS last FROM own) WHERE official_end - last > 4
        UNION ALL SELECT v.t, 'override: ' || v.p, 'blocking', v.d FROM (VALUES ('T9', '1996-06-01', 'not in universe'), ('T2', '1997-03-03', 'ratio'), ('T2', '1997-03-03', 'dates'), ('T2', '1997-03-03', 'authority'), ('T2', '1997-03-03', 'source'), ('T3', '1998-01-05', 'missing field'), ('T3', '1998-01-05', 'ratio')) v(t, d, p)""",
        _SPOILT_CANDLES,
    )
)
def snapshot_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On candles that are spoilt ticker by ticker: prices that aren't numbers or not
    positive, dates out of order, a ticker that ends early, a short one and one without
    candles; with a calendar that lacks sessions and ends early, a universe that repeats a
    ticker, and broken overrides."""
    m = _market(spark, sf_dir)
    bad = lambda ticker, every, at: (F.col("ticker") == ticker) & (F.col("seq") % every == at)
    kept = m.candles.where("ticker <> 'T5' and (ticker <> 'T3' or date <= '1998-01-31') and (ticker <> 'T4' or seq < 250)")
    raw = kept.select(
        F.lower("ticker").alias("ticker"),
        F.col("seq").alias("row"),
        F.when(bad("T2", 150, 149), F.date_sub("date", 40)).otherwise(F.col("date")).cast("string").alias("date"),
        F.when(bad("T6", 200, 3), -F.col("open")).otherwise(F.col("open")).cast("string").alias("open"),
        F.when(bad("T1", 100, 0), "n/a").otherwise(F.col("close").cast("string")).alias("close"),
    )
    few = schedule.numbered(m.calendar).where("session_idx % 50 <> 7")
    names = m.candles.select("ticker").distinct()
    names = names.unionByName(names.where("ticker = 'T7'"))
    events = spark.createDataFrame(_EVENTS, schemas.OVERRIDE)
    return audits.snapshot_rules(raw, few, names, events, "1996-01-01", "1998-08-09", audits.SnapshotLimits(tickers=9, least_ratio=0.5), must=("T0", "T1"), must_not=("T1",))


# Walk-forward and streams.


def _one(combo: tuple[int, int, int, int]) -> str:
    return "SELECT " + ", ".join(f"{v} AS {c}" for c, v in zip(COMBO, combo, strict=True))


_W1, _W2 = WINDOWS
_CHAIN = [
    *o.grid_parts(GRID)[:-1],
    *o.span("w1", _one(_W1.combo), COSTS, _W1.oos_start, _W1.oos_end),
    *o.span("w2", _one(_W2.combo), COSTS, _W2.oos_start, _W2.oos_end, "(SELECT max_by(equity, date) FROM curve_w1)"),
]


@_query(o.query(f"SELECT window_id, {_KEYS}, date, round(equity, 4) AS equity, round(cash, 4) AS cash, holding, shares FROM (SELECT 'w1' AS window_id, * FROM curve_w1 UNION ALL SELECT 'w2' AS window_id, * FROM curve_w2)", *_CHAIN))
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles = _candles(spark, sf_dir)
    rows = wf.walk_forward(lambda start, end: market(candles, TICKERS, start=start, end=end), WINDOWS, COSTS)
    return rows.select("window_id", *COMBO, "date", _r("equity", 4), _r("cash", 4), "holding", "shares")


@_query(
    """SELECT event_type, CAST(ts AS DATE) AS day, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close, count(*) AS n
    FROM events GROUP BY 1, 2"""
)
def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark.read.parquet(f"{sf_dir}/events.parquet"))


_OOS = [
    *o.grid_parts(WIDE)[:-1],
    *o.span("tr", "SELECT * FROM gs, ss, ms, vs", COSTS, None, "1997-12-31")[:-1],
    f"best AS (SELECT {_KEYS}, CAST(row_number() OVER (ORDER BY final_equity DESC, {_KEYS}) AS INTEGER) AS training_rank FROM res_tr QUALIFY training_rank <= 3)",
    *o.span("oos", f"SELECT {_KEYS} FROM best", COSTS, "1998-01-01", "1998-12-31"),
    f"dd AS (SELECT *, max(equity) OVER w AS peak, equity / lag(equity) OVER w - 1 AS daily FROM curve_oos WINDOW w AS (PARTITION BY {_KEYS} ORDER BY date ROWS UNBOUNDED PRECEDING))",
]


@_query(
    o.query(
        f"""SELECT training_rank, {_KEYS}, round(max_by(equity, date) / {COSTS.initial_cash!r} - 1, 6) AS total_return, round(min(equity / peak - 1), 6) AS max_drawdown,
          round(stddev_samp(daily) * sqrt(252), 6) AS annual_volatility FROM dd JOIN best USING ({_KEYS}) GROUP BY ALL""",
        *_OOS,
    )
)
def oos_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training span's best combinations, replayed out of sample in training order."""
    candles = _candles(spark, sf_dir)
    train = market(candles, TICKERS, end="1997-12-31")
    best = topk.top_k(vector.grid_results(train, WIDE, COSTS, top_k=3), 3).collect()
    rank = {tuple(r[c] for c in COMBO): i + 1 for i, r in enumerate(best)}
    curves = wf.evaluate(market(candles, TICKERS, start="1998-01-01", end="1998-12-31"), list(rank), COSTS)
    rows = metrics.risk(curves, COSTS.initial_cash, COMBO)
    names = spark.createDataFrame([(*k, v) for k, v in rank.items()], ", ".join(f"{c} int" for c in [*COMBO, "training_rank"]))
    return rows.join(F.broadcast(names), COMBO).select("training_rank", *COMBO, *(_r(c) for c in ("total_return", "max_drawdown", "annual_volatility")))


# More audits.


@_query("SELECT * FROM (VALUES ('l_quantity', 0), ('l_linenumber', 0)) v(\"column\", bad) UNION ALL SELECT 'l_extendedprice', count(*) FILTER (l_extendedprice <> round(l_extendedprice, 0)) FROM lineitem")
def integer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audits.integer_valued(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_linenumber", "l_extendedprice"])
    return rows.select("column", F.col("bad").cast("long").alias("bad"))


@_query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_linenumber BETWEEN 2 AND 6 AND l_quantity BETWEEN 5 AND 45)")
def out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audits.within(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), {"l_linenumber": (2, 6), "l_quantity": (5, 45)})
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@_query(o.query("SELECT gap_period % 2 AS shard, count(*) AS rows, min(momentum_period) AS min_momentum, max(momentum_period) AS max_momentum, array_to_string(list_sort(list(DISTINCT gap_period)), ',') AS gaps FROM res GROUP BY 1", *_folded(WIDE)))
def shard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audits.shard_summary(_wide(spark, sf_dir).withColumn("shard", F.col("gap_period") % 2))
    return rows.select("shard", "rows", F.col("min_momentum_period").alias("min_momentum"), F.col("max_momentum_period").alias("max_momentum"), F.array_join("gaps", ",").alias("gaps"))


@_query(
    o.query(
        f"""SELECT ticker, unnest(list_filter([CASE WHEN rows < 1300 THEN 'history' END, CASE WHEN ratio < 0.55 THEN 'coverage' END, CASE WHEN stale > 2 THEN 'stale' END], lambda x: x IS NOT NULL)) AS problem
        FROM (SELECT ticker, count(*) AS rows, count(*) FILTER (date BETWEEN DATE '{START}' AND DATE '{END}') / any_value(n) AS ratio, any_value(last) - max(date) AS stale
              FROM c, (SELECT count(*) AS n, max(session_date) AS last FROM cal WHERE session_date BETWEEN DATE '{START}' AND DATE '{END}') GROUP BY 1)"""
    )
)
def snapshot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    return audits.snapshot(m.candles, m.calendar, START, END, 1300, 0.55, 2)


@_query("SELECT * FROM (VALUES ('T9', '1996-06-01', 'not in universe'), ('T2', '1997-03-03', 'ratio'), ('T2', '1997-03-03', 'dates'), ('T2', '1997-03-03', 'authority'), ('T2', '1997-03-03', 'source'), ('T3', '1998-01-05', 'missing field'), ('T3', '1998-01-05', 'ratio')) v(ticker, ex_date, problem)")
def override_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.overrides(spark.createDataFrame(_EVENTS, schemas.OVERRIDE), _candles(spark, sf_dir).select("ticker").distinct())


@_query(o.query("SELECT date, unnest(CASE WHEN day(date) = 1 THEN ['equity', 'shares'] ELSE ['equity'] END) AS \"column\" FROM curve WHERE day(date) <= 2", *_CURVE))
def golden_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against an external curve that differs on the first two days of each month, by more
    than the audit's relative tolerance however large the equity."""
    curve = _curve(spark, sf_dir).drop(*COMBO)
    more = F.greatest(F.lit(1.0), F.abs("equity") * 1e-6)
    other = curve.withColumn("equity", F.when(F.dayofmonth("date") <= 2, F.col("equity") + more).otherwise(F.col("equity")))
    other = other.withColumn("shares", F.when(F.dayofmonth("date") == 1, F.col("shares") + 1).otherwise(F.col("shares")))
    return audits.golden(other, curve).select("date", "column")


@_query(
    o.query(
        """SELECT decision_date, ticker, unnest(list_filter([CASE WHEN ticker_idx = 1 AND score IS NOT NULL THEN 'momentum' END, CASE WHEN ticker_idx = 2 THEN 'gap_state' END,
          CASE WHEN day(decision_date) = 1 AND target IS NOT NULL THEN 'selected_top1' END], lambda x: x IS NOT NULL)) AS "column"
        FROM sch JOIN c ON c.date = decision_date LEFT JOIN st USING (ticker_idx, seq) JOIN mom USING (ticker_idx, seq) JOIN vol USING (ticker_idx, seq) JOIN tgt USING (week_idx)""",
        *o.grid_parts(ONE),
    )
)
def golden_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against external indicators: one ticker's momentum is a little off, another's
    state is turned round, and on the first of a month nothing is selected."""
    own = decisions(_market(spark, sf_dir), ONE)
    other = own.withColumns(
        {
            "momentum": F.when(F.col("ticker") == "T1", F.col("momentum") + 1e-6).otherwise(F.col("momentum")),
            "gap_state": F.col("gap_state") != (F.col("ticker") == "T2"),
            "selected_top1": F.when(F.dayofmonth("decision_date") == 1, "CASH").otherwise(F.col("selected_top1")),
        }
    )
    return audits.golden_indicators(other, own).select("decision_date", "ticker", "column")


_SPAN = """SELECT CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR) AS id, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS oos_start,
  CAST(max(CAST(o_orderdate AS DATE)) + CASE WHEN year(CAST(o_orderdate AS DATE)) % 2 = 0 THEN 9 ELSE 0 END AS VARCHAR) AS oos_end FROM orders GROUP BY year(CAST(o_orderdate AS DATE))"""


@_query(f"SELECT id FROM (SELECT id, oos_start, lag(oos_end) OVER (ORDER BY oos_start) AS before FROM ({_SPAN})) WHERE before >= oos_start")
def window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a year each, of which every second one reaches into the next."""
    day = F.to_date("o_orderdate")
    years = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.year(day).alias("year")).agg(F.min(day).alias("low"), F.max(day).alias("high"))
    late = F.date_add("high", F.when(F.col("year") % 2 == 0, 9).otherwise(0))
    return wf.overlaps(years.select(F.col("year").cast("string").alias("id"), F.col("low").cast("string").alias("oos_start"), late.cast("string").alias("oos_end"))).select("id")


_CHOICES = {"gap_period": 3, "signal_period": 2, "momentum_period": 4, "vol_period": 5}


@_query(
    "WITH w AS (SELECT CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR) AS id, "
    + ", ".join(f"CAST(count(*) % {v} AS INTEGER) AS {c}" for c, v in _CHOICES.items())
    + " FROM orders GROUP BY 1), p AS (SELECT *, "
    + ", ".join(f"lag({c}) OVER (ORDER BY id) AS p_{c}" for c in _CHOICES)
    + " FROM w) SELECT count(*) FILTER ("
    + " OR ".join(f"{c} <> p_{c}" for c in COMBO[:3])
    + ") AS changes, count(*) FILTER ("
    + " OR ".join(f"{c} <> p_{c}" for c in COMBO)
    + ") AS changes_with_vol FROM p"
)
def parameter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a year each with parameters drawn from the number of its orders."""
    years = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.year(F.to_date("o_orderdate")).cast("string").alias("window_id")).agg(F.count("*").alias("n"))
    return wf.parameter_changes(years.select("window_id", *((F.col("n") % v).cast("int").alias(c) for c, v in _CHOICES.items())))
