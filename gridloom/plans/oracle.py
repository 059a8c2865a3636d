"""DuckDB twins of the catalog's queries, built from shared common table expressions.

Running sums are recursive there, because a float sum depends on its order and the
window sums of other engines don't promise one.
"""

from __future__ import annotations

import re

from gridloom.config import Costs, Grid

CANDLES = """c0 AS (
  SELECT CAST(o_custkey % 8 AS INTEGER) AS ticker_idx, CAST(o_orderdate AS DATE) AS date,
         min_by(o_totalprice, o_orderkey) / 1000 AS open, max_by(o_totalprice, o_orderkey) / 1000 AS close
  FROM orders GROUP BY 1, 2),
c AS (SELECT *, 'T' || ticker_idx AS ticker, CAST(row_number() OVER (PARTITION BY ticker_idx ORDER BY date) - 1 AS INTEGER) AS seq FROM c0),
cal AS (SELECT date AS session_date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS session_idx FROM (SELECT DISTINCT date FROM c)),
sch AS (
  SELECT CAST(row_number() OVER (ORDER BY session_date) - 1 AS INTEGER) AS week_idx, decision_date, session_date AS execution_date
  FROM (SELECT session_date, lag(session_date) OVER (ORDER BY session_date) AS decision_date FROM cal)
  WHERE date_trunc('week', session_date) <> date_trunc('week', decision_date))"""

RUNNING = """g AS (
  SELECT *, coalesce(open - lag(close) OVER w, 0.0) AS gap, coalesce(close / lag(close) OVER w - 1, 0.0) AS ret
  FROM c WINDOW w AS (PARTITION BY ticker_idx ORDER BY seq)),
run AS (
  SELECT ticker_idx, seq, greatest(gap, 0.0) AS up, greatest(-gap, 0.0) AS down, ret AS s1, ret * ret AS s2 FROM g WHERE seq = 0
  UNION ALL
  SELECT g.ticker_idx, g.seq, run.up + greatest(g.gap, 0.0), run.down + greatest(-g.gap, 0.0), run.s1 + g.ret, run.s2 + g.ret * g.ret
  FROM run JOIN g ON g.ticker_idx = run.ticker_idx AND g.seq = run.seq + 1)"""


def _values(name: str, column: str, values: tuple[int, ...]) -> str:
    return f"{name} AS (SELECT CAST(unnest([{', '.join(map(str, values))}]) AS INTEGER) AS {column})"


def ratios(gaps: tuple[int, ...]) -> str:
    return f"""{_values('gs', 'gap_period', gaps)},
rat AS (
  SELECT gap_period, ticker_idx, seq, CASE WHEN d = 0 THEN 1.0 ELSE 100.0 * u / d END AS ratio
  FROM (SELECT gap_period, r.ticker_idx, r.seq, r.up - coalesce(p.up, 0.0) AS u, r.down - coalesce(p.down, 0.0) AS d
        FROM run r CROSS JOIN gs LEFT JOIN run p ON p.ticker_idx = r.ticker_idx AND p.seq = r.seq - gap_period
        WHERE r.seq >= gap_period - 1))"""


def lines(signals: tuple[int, ...]) -> str:
    return f"""{_values('ss', 'signal_period', signals)},
rrun AS (
  SELECT gap_period, ticker_idx, seq, ratio AS rs FROM rat WHERE seq = gap_period - 1
  UNION ALL
  SELECT rat.gap_period, rat.ticker_idx, rat.seq, rrun.rs + rat.ratio
  FROM rrun JOIN rat ON rat.gap_period = rrun.gap_period AND rat.ticker_idx = rrun.ticker_idx AND rat.seq = rrun.seq + 1),
lin AS (
  SELECT r.gap_period, signal_period, r.ticker_idx, r.seq,
         CASE WHEN r.seq >= r.gap_period + signal_period - 2 THEN (r.rs - coalesce(p.rs, 0.0)) / signal_period END AS line
  FROM rrun r CROSS JOIN ss LEFT JOIN rrun p ON p.gap_period = r.gap_period AND p.ticker_idx = r.ticker_idx AND p.seq = r.seq - signal_period),
ev AS (
  SELECT *, CASE WHEN line > lag(line) OVER w THEN 1 WHEN line < lag(line) OVER w THEN 0 END AS ev
  FROM lin WINDOW w AS (PARTITION BY gap_period, signal_period, ticker_idx ORDER BY seq)),
st AS (
  SELECT gap_period, signal_period, ticker_idx, seq,
         coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY gap_period, signal_period, ticker_idx ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1, false) AS state
  FROM ev)"""


def momenta(periods: tuple[int, ...]) -> str:
    return f"""{_values('ms', 'momentum_period', periods)},
mom AS (
  SELECT momentum_period, a.ticker_idx, a.seq, a.close / b.close - 1 AS score
  FROM c a CROSS JOIN ms LEFT JOIN c b ON b.ticker_idx = a.ticker_idx AND b.seq = a.seq - momentum_period)"""


def gates(periods: tuple[int, ...]) -> str:
    return f"""{_values('vs', 'vol_period', periods)},
vol AS (
  SELECT vol_period, ticker_idx, seq, coalesce(seq >= vol_period - 1 AND (b - a * a / vol_period) / (vol_period - 1) > 0, false) AS ok
  FROM (SELECT vol_period, r.ticker_idx, r.seq, r.s1 - coalesce(p.s1, 0.0) AS a, r.s2 - coalesce(p.s2, 0.0) AS b
        FROM run r CROSS JOIN vs LEFT JOIN run p ON p.ticker_idx = r.ticker_idx AND p.seq = r.seq - vol_period))"""


TARGETS = """dec AS (SELECT week_idx, c.ticker_idx, c.seq FROM sch JOIN c ON c.date = decision_date),
cand AS (
  SELECT gap_period, signal_period, momentum_period, vol_period, week_idx, ticker_idx, score
  FROM dec JOIN st USING (ticker_idx, seq) JOIN mom USING (ticker_idx, seq) JOIN vol USING (ticker_idx, seq)
  WHERE state AND ok AND score > 0),
combo AS (SELECT * FROM gs, ss, ms, vs),
tgt AS (
  SELECT combo.*, sch.week_idx, b.ticker_idx AS target
  FROM combo CROSS JOIN sch LEFT JOIN (
    SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY gap_period, signal_period, momentum_period, vol_period, week_idx ORDER BY score DESC, ticker_idx) = 1) b
  USING (gap_period, signal_period, momentum_period, vol_period, week_idx))"""

FINAL = "fin AS (SELECT ticker_idx, max_by(close, date) AS final_close FROM c GROUP BY 1)"


def quantity(cash: str, price: str, costs: Costs) -> str:
    """A scalar subquery with the affordable shares."""
    fee, base, extra = costs.rates
    return f"""(SELECT CASE WHEN NOT ({price} > 0 AND {cash} > 0) OR {price} IS NULL THEN 0
      WHEN {price} * ({1.0 + base!r}::DOUBLE * whole + {extra!r}::DOUBLE * (whole % 100)) * {1.0 + fee!r}::DOUBLE > {cash} + 1e-9 THEN greatest(whole - 1, 0) ELSE whole END
    FROM (SELECT lots * 100 + CAST(least(greatest(floor(greatest({cash} - lots * lot * 100.0::DOUBLE, 0.0) / (lot + odd)), 0), 99) AS BIGINT) AS whole
      FROM (SELECT lot, odd, CAST(floor({cash} / (lot * 100.0::DOUBLE)) AS BIGINT) AS lots
        FROM (SELECT {price} * {1.0 + fee!r}::DOUBLE * {1.0 + base!r}::DOUBLE AS lot, {price} * {1.0 + fee!r}::DOUBLE * {extra!r}::DOUBLE AS odd))))"""


def fold(costs: Costs, cash: str | None = None) -> str:
    """``cash``: SQL for the capital at the start, instead of that of the costs."""
    cash = cash or f"{costs.initial_cash!r}::DOUBLE"
    fee, base, extra = (f"{x!r}::DOUBLE" for x in costs.rates)
    one = f"{1.0 + costs.rates[1]!r}::DOUBLE"
    keys = "gap_period, signal_period, momentum_period, vol_period"
    return f"""op AS (
  SELECT week_idx, list(c.open ORDER BY t) AS opens FROM sch CROSS JOIN range(8) r(t) LEFT JOIN c ON c.date = execution_date AND c.ticker_idx = t GROUP BY 1),
el AS (
  SELECT combo.*, sch.week_idx, list(score ORDER BY t) AS scores
  FROM combo CROSS JOIN sch CROSS JOIN range(8) r(t)
  LEFT JOIN cand ON cand.ticker_idx = t AND cand.week_idx = sch.week_idx AND cand.gap_period = combo.gap_period AND cand.signal_period = combo.signal_period
    AND cand.momentum_period = combo.momentum_period AND cand.vol_period = combo.vol_period
  GROUP BY ALL),
wk AS (SELECT {keys}, week_idx, coalesce(target, -1) AS target, opens, scores FROM tgt JOIN op USING (week_idx) JOIN el USING ({keys}, week_idx)),
f AS (
  SELECT {keys}, -1 AS w, -1 AS aimed, {cash} AS cash, 0::BIGINT AS shares, -1 AS holding, 0 AS trades, 0 AS skipped, 0.0::DOUBLE AS fees, 0.0::DOUBLE AS slip FROM combo
  UNION ALL
  SELECT {keys}, w, t,
    CASE WHEN NOT moves THEN cash WHEN t >= 0 THEN greatest(purse - spent - spent * {fee}, 0.0) ELSE purse END,
    CASE WHEN moves THEN q ELSE shares END, CASE WHEN moves THEN t ELSE holding END,
    CASE WHEN moves THEN trades + CAST(holding >= 0 AS INTEGER) + CAST(t >= 0 AS INTEGER) ELSE trades END,
    CASE WHEN t <> holding AND NOT moves THEN skipped + 1 ELSE skipped END,
    CASE WHEN moves THEN fees + sale_fee + spent * {fee} ELSE fees END,
    CASE WHEN moves THEN slip + cost + CASE WHEN t >= 0 THEN ask * ({base} * q + {extra} * (q % 100)) ELSE 0.0 END ELSE slip END
  FROM (
    SELECT *, t <> holding AND (holding < 0 OR coalesce(sold > 0, false)) AND (t < 0 OR (coalesce(ask > 0, false) AND q > 0)) AS moves,
      CASE WHEN t >= 0 THEN ask * ({one} * q + {extra} * (q % 100)) ELSE 0.0 END AS spent
    FROM (
      SELECT *, CASE WHEN t >= 0 THEN {quantity('purse', 'ask', costs)} ELSE 0 END AS q
      FROM (
        SELECT *, gross * {fee} AS sale_fee, cash + (gross - gross * {fee}) AS purse
        FROM (
          SELECT *, CASE WHEN holding >= 0 THEN sold * shares - cost ELSE 0.0 END AS gross
          FROM (
            SELECT *, CASE WHEN holding >= 0 THEN sold * ({base} * shares + {extra} * (shares % 100)) ELSE 0.0 END AS cost
            FROM (
              SELECT *, CASE WHEN t >= 0 THEN opens[t + 1] END AS ask, CASE WHEN holding >= 0 THEN opens[holding + 1] END AS sold
              FROM (
                SELECT {', '.join(f'f.{k}' for k in keys.split(', '))}, wk.week_idx AS w, f.cash, f.shares, f.holding, f.trades, f.skipped, f.fees, f.slip, wk.opens,
                  CASE WHEN f.holding >= 0 AND wk.target >= 0 AND wk.scores[f.holding + 1] = wk.scores[wk.target + 1] THEN f.holding ELSE wk.target END AS t
                FROM f JOIN wk ON wk.week_idx = f.w + 1 AND wk.gap_period = f.gap_period AND wk.signal_period = f.signal_period
                  AND wk.momentum_period = f.momentum_period AND wk.vol_period = f.vol_period)))))))),
res AS (
  SELECT {keys}, cash + CASE WHEN holding >= 0 THEN shares * final_close ELSE 0.0 END AS final_equity,
    (cash + CASE WHEN holding >= 0 THEN shares * final_close ELSE 0.0 END) / {costs.initial_cash!r}::DOUBLE - 1 AS total_return,
    trades, skipped AS skipped_executions, fees AS fees_paid, slip AS slippage_impact, CASE WHEN holding >= 0 THEN 'T' || holding ELSE 'CASH' END AS final_holding
  FROM f LEFT JOIN fin ON fin.ticker_idx = holding WHERE w = (SELECT max(week_idx) FROM sch))"""


def curve(costs: Costs, cash: str | None = None, start: str | None = None) -> str:
    """The daily curves of the combinations that are folded, from ``start`` on."""
    cash = cash or f"{costs.initial_cash!r}::DOUBLE"
    keys = "gap_period, signal_period, momentum_period, vol_period"
    since = f"WHERE session_date >= DATE '{start}'" if start else ""
    same = " AND ".join(f"f.{k} = combo.{k}" for k in keys.split(", "))
    return f"""filled AS (
  SELECT session_date AS date, CAST(t AS INTEGER) AS ticker_idx, last_value(c.close IGNORE NULLS) OVER w AS close, last_value(c.date IGNORE NULLS) OVER w AS traded
  FROM cal CROSS JOIN range(8) r(t) LEFT JOIN c ON c.date = session_date AND c.ticker_idx = t
  WINDOW w AS (PARTITION BY t ORDER BY session_date ROWS UNBOUNDED PRECEDING)),
days AS (
  SELECT combo.*, session_date AS date, aimed, coalesce(last_value(f.cash IGNORE NULLS) OVER w, {cash}) AS cash,
    coalesce(last_value(f.shares IGNORE NULLS) OVER w, 0) AS shares, coalesce(last_value(f.holding IGNORE NULLS) OVER w, -1) AS h
  FROM cal CROSS JOIN combo LEFT JOIN sch ON execution_date = session_date LEFT JOIN f ON f.w = sch.week_idx AND {same} {since}
  WINDOW w AS (PARTITION BY {', '.join(f'combo.{k}' for k in keys.split(', '))} ORDER BY session_date ROWS UNBOUNDED PRECEDING)),
curve AS (
  SELECT {keys}, days.date, cash + CASE WHEN h >= 0 THEN shares * close ELSE 0.0 END AS equity, cash, CASE WHEN h >= 0 THEN 'T' || h ELSE 'CASH' END AS holding,
    shares, CASE WHEN coalesce(aimed, h) >= 0 THEN 'T' || coalesce(aimed, h) ELSE 'CASH' END AS weekly_target
  FROM days LEFT JOIN filled ON filled.date = days.date AND filled.ticker_idx = h)"""


def query(body: str, *parts: str) -> str:
    """A statement from common table expressions and its body."""
    return "WITH RECURSIVE " + ",\n".join([CANDLES, *parts]) + "\n" + body


def grid_parts(grid: Grid) -> list[str]:
    return [RUNNING, ratios(grid.gaps), lines(grid.signals), momenta(grid.momenta), gates(grid.vols), TARGETS]


def span(name: str, combos: str, costs: Costs, start: str | None, end: str, cash: str | None = None) -> list[str]:
    """The parts of a market cut to a span, whose tables' names end with ``name``:
    schedule, targets, fold, results and curves of ``combos`` (SQL for their periods)."""
    sessions = f"cal AS (SELECT * FROM calendar WHERE session_date <= DATE '{end}')"
    weeks = CANDLES[CANDLES.index("sch AS (") :]
    if start:
        weeks = weeks.replace("WHERE date_trunc", f"WHERE session_date >= DATE '{start}' AND date_trunc")
    chosen = TARGETS.replace("combo AS (SELECT * FROM gs, ss, ms, vs)", f"combo AS ({combos})")
    final = FINAL.replace("FROM c GROUP", f"FROM c WHERE date <= DATE '{end}' GROUP")
    parts = [sessions, weeks, chosen, final, fold(costs, cash), curve(costs, cash, start)]
    own = re.compile(r"\b(cal|sch|dec|cand|combo|tgt|fin|op|el|wk|f|res|filled|days|curve)\b")
    return [own.sub(rf"\1_{name}", x).replace("FROM calendar", "FROM cal") for x in parts]
