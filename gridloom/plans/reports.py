"""Markdown reports of a grid, a year-by-year curve, an out-of-sample test, a
walk-forward and a robustness analysis. Each takes small result tables; what it collects
has a row a year, a window, a neighbour or a leader."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.operators.ranking import COMBO


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.2f} %"


def money(x: float | None) -> str:
    return "n/a" if x is None else f"{x:,.2f}"


def table(columns: list[str], rows: list[list[object]]) -> list[str]:
    """A Markdown table; a cell's bars are escaped."""
    line = lambda cells: "| " + " | ".join(str("" if c is None else c).replace("|", "\\|") for c in cells) + " |"
    return [line(columns), "|" + " --- |" * len(columns), *map(line, rows)]


def _page(title: str, *parts: list[str]) -> str:
    return "\n\n".join([f"# {title}", *("\n".join(p) for p in parts if p)]) + "\n"


def grid_report(best: DataFrame, tested: int, span: tuple[str, str], tickers: int, annual: DataFrame, risk: DataFrame, most: int = 20) -> str:
    """The leaders of an exhaustive search, the winner's risk and its years."""
    rows = best.limit(most).collect()
    facts = [f"- combinations tested: {tested:,}", f"- period: {span[0]} to {span[1]}", f"- tickers: {tickers}"]
    leaders = table([*COMBO, "final equity", "return", "trades", "skipped", "fees", "slippage"], [[*(r[c] for c in COMBO), money(r["final_equity"]), percent(r["total_return"]), r["trades"], r["skipped_executions"], money(r["fees_paid"]), money(r["slippage_impact"])] for r in rows])
    r = risk.first()
    winner = [f"- {k}: {percent(r[k])}" for k in ("total_return", "cagr", "max_drawdown", "annual_volatility")] + [f"- {k}: {'n/a' if r[k] is None else format(r[k], '.4f')}" for k in ("sharpe", "calmar")]
    years = [f"- {y['year']}{'' if y['complete_year'] else ' (partial)'}: {percent(y['return'])}" for y in annual.orderBy("year").collect()]
    return _page("Exhaustive grid", facts, leaders, ["## Winner", "", *winner], ["## By year", "", *years], ["The winner was chosen on the period it is measured on."])


def annual_report(annual: DataFrame, means: DataFrame, total_return: float | None) -> str:
    rows = [[y["year"], percent(y["return"]), money(y["end_equity"]), "complete" if y["complete_year"] else "partial"] for y in annual.orderBy("year").collect()]
    m = means.first()
    ends = [f"- total return: {percent(total_return)}", f"- mean of {m['complete_years']} complete years: {percent(m['average_return'])}", f"- geometric mean of complete years: {percent(m['geometric_mean'])}"]
    return _page("Returns by year", table(["year", "return", "final equity", "coverage"], rows), ends, ["Partial years are shown and take no part in the means."])


def oos_report(results: DataFrame, train: tuple[str, str], holdout: tuple[str, str]) -> str:
    """``results``: a row for each training rank with its metrics."""
    rows = [[r["training_rank"], *(r[c] for c in COMBO), percent(r["total_return"]), percent(r["cagr"]), percent(r["max_drawdown"])] for r in results.orderBy("training_rank").collect()]
    return _page("Out-of-sample test", [f"Chosen on {train[0]} to {train[1]}, measured on {holdout[0]} to {holdout[1]}."], table(["training rank", *COMBO, "return", "CAGR", "max drawdown"], rows))


def walk_forward_report(windows: DataFrame, risk: DataFrame, changes: int) -> str:
    """``windows``: window_id, first, last, the parameters, start_equity and end_equity."""
    found = windows.orderBy("first").collect()
    rows = [[w["window_id"], f"{w['first']} to {w['last']}", "/".join(str(w[c]) for c in COMBO), percent(w["end_equity"] / w["start_equity"] - 1), money(w["end_equity"])] for w in found]
    r = risk.first()
    ends = [f"- total return: {percent(r['total_return'])}", f"- final capital: {money(found[-1]['end_equity'])}", f"- CAGR: {percent(r['cagr'])}", f"- max drawdown: {percent(r['max_drawdown'])}", f"- changes of parameters: {changes}"]
    return _page("Walk-forward", table(["window", "evaluated", "parameters", "return", "final capital"], rows), ends, ["Capital is carried from window to window, positions aren't."])


def robustness_report(quantiles: DataFrame, near: DataFrame, axis: DataFrame, concentration: DataFrame) -> str:
    points = [f"- quantile {q['point']:g}: {percent(q['total_return'])}" for q in quantiles.orderBy("point").collect()]
    n = near.first()
    local = [f"- combinations: {n['count']}", *(f"- {k}: {percent(n[k])}" for k in ("median_return", "mean_return", "min_return", "max_return", "share_positive", "share_top_1pct"))]
    steps = table(["step", *COMBO, "return"], [[r["direction"], *(r[c] for c in COMBO), percent(r["total_return"])] for r in axis.orderBy("direction").collect()])
    often = table(["axis", "value", "share"], [[r["axis"], r["value"], percent(r["share"])] for r in concentration.orderBy("axis", "share", "value").collect()])
    return _page("Robustness in sample", points, ["## Around the winner", "", *local], ["## One step away", "", *steps], ["## Periods among the best", "", *often], ["Stability in sample doesn't establish a strategy."])
