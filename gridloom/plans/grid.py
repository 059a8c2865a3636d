"""Whole grids: a vectorised kernel over parameter combinations, a task per gap and block of
momentum periods.

The declarative plan in ``market`` carries a row per combination and week; a grid of
tens of millions of combinations can't. Here a task gets the market's matrices (a few
MB, checked), computes the gap states of its gap, and folds all (momentum, signal)
combinations of its block at once, a vol gate at a time. Vol periods with identical gates
share one fold. With ``top_k`` a task returns its best rows only, which is exact because
a global leader leads its own task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.config import Costs, Grid
from gridloom.operators.topk import top_k as best_rows
from gridloom.plans.market import Market

#: Candles that may be sent to every task: 40 tickers of 2,900 sessions are 116,000.
MOST_CANDLES = 5_000_000
#: Momentum periods that a task folds together.
BLOCK = 16


def matrices(m: Market) -> dict:
    """The market as arrays: per ticker opens and closes, and by week the candle number
    at the decision (-1 without one), the execution open (NaN without one)."""
    if m.candles.count() > MOST_CANDLES:
        raise ValueError(f"a market of more than {MOST_CANDLES} candles isn't sent to every task")
    rows = m.candles.orderBy("ticker_idx", "seq").toPandas()
    weeks = m.weeks.orderBy("week_idx").toPandas()
    decide, execute = (pd.to_datetime(weeks[c]).to_numpy() for c in ("decision_date", "execution_date"))
    out = {"open": [], "close": [], "names": [""] * m.tickers, "at": np.full((len(weeks), m.tickers), -1), "exec": np.full((len(weeks), m.tickers), np.nan), "final": np.full(m.tickers, np.nan)}
    end = np.datetime64(m.end) if m.end else None
    last = None
    for i in range(m.tickers):
        own = rows[rows.ticker_idx == i]
        date, opens, closes = pd.to_datetime(own["date"]).to_numpy(), own["open"].to_numpy(float), own["close"].to_numpy(float)
        out["open"].append(opens)
        out["close"].append(closes)
        if not len(own):
            continue
        out["names"][i] = own["ticker"].iloc[0]
        for wanted, put in ((decide, "at"), (execute, "exec")):
            spot = np.minimum(np.searchsorted(date, wanted), len(date) - 1)
            hit = date[spot] == wanted
            out[put][hit, i] = spot[hit] if put == "at" else opens[spot[hit]]
        upto = len(date) if end is None else int(np.searchsorted(date, end, "right"))
        if upto:
            out["final"][i] = closes[upto - 1]
            last = max(last, date[upto - 1]) if last is not None else date[upto - 1]
    out["start"], out["end"] = (weeks["execution_date"].min() if len(weeks) else None), (pd.Timestamp(last).date() if last is not None else None)
    return out


def _window(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the last n values by prefix difference, NaN before there are n."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        total = np.append(0.0, np.cumsum(x))
        out[n - 1 :] = total[n:] - total[:-n]
    return out


def _pick(values: np.ndarray, at: np.ndarray, missing) -> np.ndarray:
    """values[at], and ``missing`` where at is -1."""
    return np.where(at >= 0, values[np.maximum(at, 0)], missing) if len(values) else np.full(len(at), missing)


def states(data: dict, gap: int, signals: tuple[int, ...]) -> np.ndarray:
    """[signal, week, ticker]: whether the signal line's last move was up."""
    at = data["at"]
    out = np.zeros((len(signals), *at.shape), dtype=bool)
    for i, (opens, closes) in enumerate(zip(data["open"], data["close"], strict=True)):
        gaps = np.append(0.0, opens[1:] - closes[:-1])[: len(opens)]
        up, down = _window(np.maximum(gaps, 0), gap), _window(np.maximum(-gaps, 0), gap)
        if len(opens) < gap:
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(down == 0, 1.0, 100.0 * up / down)[gap - 1 :]
        for k, s in enumerate(signals):
            line = _window(ratio, s) / s
            move = np.sign(np.append(np.nan, np.diff(line)))
            told = np.flatnonzero(np.isfinite(move) & (move != 0))
            state = np.zeros(len(opens), dtype=bool)
            if len(told):
                since = np.searchsorted(told, np.arange(len(ratio)), "right") - 1
                state[gap - 1 :] = (since >= 0) & (move[told[np.maximum(since, 0)]] > 0)
            out[k, :, i] = _pick(state, at[:, i], False)
    return out


def scores(data: dict, periods: tuple[int, ...]) -> np.ndarray:
    """[momentum, week, ticker]: change over so many candles, NaN where not known."""
    at = data["at"]
    out = np.full((len(periods), *at.shape), np.nan)
    for i, closes in enumerate(data["close"]):
        for k, p in enumerate(periods):
            if len(closes) > p:
                out[k, :, i] = _pick(np.append(np.full(p, np.nan), closes[p:] / closes[:-p] - 1), at[:, i], np.nan)
    return out


def gates(data: dict, periods: tuple[int, ...]) -> np.ndarray:
    """[vol, week, ticker]: whether the one-pass variance of returns is above 0."""
    at = data["at"]
    out = np.zeros((len(periods), *at.shape), dtype=bool)
    for i, closes in enumerate(data["close"]):
        ret = np.append(0.0, closes[1:] / closes[:-1] - 1)[: len(closes)]
        for k, p in enumerate(periods):
            a, b = _window(ret, p), _window(ret * ret, p)
            with np.errstate(invalid="ignore"):
                out[k, :, i] = _pick((b - a * a / p) / (p - 1) > 0, at[:, i], False)
    return out


def _quantity(cash: np.ndarray, price: np.ndarray, fee: float, base: float, extra: float) -> np.ndarray:
    lot, odd = price * (1 + fee) * (1 + base), price * (1 + fee) * extra
    lots = np.floor(cash / (lot * 100.0))
    loose = np.clip(np.floor(np.maximum(cash - lots * lot * 100.0, 0) / (lot + odd)), 0, 99)
    q = lots * 100 + loose
    over = price * ((1 + base) * q + extra * (q % 100)) * (1 + fee) > cash + 1e-9
    return np.where(over, np.maximum(q - 1, 0), q)


def simulate(score: np.ndarray, state: np.ndarray, gate: np.ndarray, data: dict, costs: Costs) -> dict[str, np.ndarray]:
    """Portfolios of all (momentum, signal) combinations after the last week."""
    (fee, base, extra), m, s = costs.rates, len(score), len(state)
    n = m * s
    cash, shares, held = np.full(n, float(costs.initial_cash)), np.zeros(n), np.full(n, -1)
    trades, skipped, fees, slip = np.zeros(n, int), np.zeros(n, int), np.zeros(n), np.zeros(n)
    every = np.arange(n)
    for w in range(score.shape[1]):
        with np.errstate(invalid="ignore"):
            able = np.where(gate[w] & (score[:, w] > 0), score[:, w], -np.inf)
        value = np.where(state[None, :, w], able[:, None], -np.inf).reshape(n, -1)
        best = value.argmax(axis=1)  # the first of equal ones
        top = value[every, best]
        target = np.where(top > -np.inf, best, -1)
        kept = value[every, np.maximum(held, 0)]
        target = np.where((held >= 0) & (target >= 0) & (kept > -np.inf) & (kept == top), held, target)
        i = np.flatnonzero(target != held)
        if not len(i):
            continue
        h, t, price = held[i], target[i], data["exec"][w]
        sold, q = price[np.maximum(h, 0)], shares[i]
        cost = np.where(h >= 0, sold * (base * q + extra * (q % 100)), 0.0)
        gross = np.where(h >= 0, sold * q - cost, 0.0)
        paid = gross * fee
        purse = cash[i] + (gross - paid)
        ask = price[np.maximum(t, 0)]
        with np.errstate(invalid="ignore", divide="ignore"):
            buys = np.where((t >= 0) & (ask > 0) & (purse > 0), _quantity(purse, ask, fee, base, extra), 0.0)
            ok = ((h < 0) | (sold > 0)) & ((t < 0) | (buys > 0))
        skipped[i[~ok]] += 1
        i, t, h, buys, ask, purse, cost, paid = (x[ok] for x in (i, t, h, buys, ask, purse, cost, paid))
        spent = np.where(t >= 0, ask * ((1 + base) * buys + extra * (buys % 100)), 0.0)
        fees[i] = fees[i] + paid + spent * fee
        slip[i] = slip[i] + cost + np.where(t >= 0, ask * (base * buys + extra * (buys % 100)), 0.0)
        cash[i] = np.where(t >= 0, np.maximum(purse - spent - spent * fee, 0.0), purse)
        shares[i], held[i] = buys, t
        trades[i] += (h >= 0).astype(int) + (t >= 0)
    if (cash < -1e-7).any() or (shares < 0).any() or ((held < 0) != (shares == 0)).any():
        raise RuntimeError("a portfolio breaks its invariants")
    mark = np.where(held >= 0, shares * data["final"][np.maximum(held, 0)], 0.0)
    if not np.isfinite(mark).all():
        raise RuntimeError("an open position has no final price")
    return {"final_equity": cash + mark, "trades": trades, "skipped_executions": skipped, "fees_paid": fees, "slippage_impact": slip, "held": held}


def groups(gate: np.ndarray) -> dict[bytes, list[int]]:
    """Positions of vol periods by their whole gate."""
    out: dict[bytes, list[int]] = {}
    for k in range(len(gate)):
        out.setdefault(gate[k].tobytes(), []).append(k)
    return out


def grid_results(m: Market, grid: Grid, costs: Costs, top_k: int | None = None, shard: int = 0) -> DataFrame:
    """Result rows of the whole grid, or its exact best ``top_k``."""
    spark = m.candles.sparkSession
    data = matrices(m)
    sent = spark.sparkContext.broadcast(data)
    columns = [x.split()[0] for x in schemas.RESULT.split(", ")]

    # A task per gap and block of momentum periods: even, and as many as the grid is large.
    wide = -(-len(grid.momenta) // BLOCK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = sent.value
        gate = gates(data, grid.vols)
        names = np.array([*data["names"], "CASH"])
        for batch in batches:
            for unit in batch["id"]:
                gap, momenta = grid.gaps[int(unit) // wide], grid.momenta[int(unit) % wide * BLOCK :][:BLOCK]
                score, state = scores(data, momenta), states(data, gap, grid.signals)
                pm, ps = (x.ravel() for x in np.meshgrid(momenta, grid.signals, indexing="ij"))
                for members in groups(gate).values():
                    found = simulate(score, state, gate[members[0]], data, costs)
                    held = found.pop("held")
                    frame = pd.DataFrame({"gap_period": gap, "signal_period": ps, "momentum_period": pm, **found})
                    frame["total_return"] = frame["final_equity"] / costs.initial_cash - 1
                    frame["final_holding"] = names[held]
                    frame["start"], frame["end"], frame["shard"] = data["start"], data["end"], shard
                    if top_k is not None and len(frame) > top_k:
                        frame = frame.sort_values(["final_equity", "signal_period", "momentum_period"], ascending=[False, True, True]).head(top_k)
                    for k in members:
                        yield frame.assign(vol_period=grid.vols[k])[columns]

    units = len(grid.gaps) * wide
    rows = spark.range(0, units, 1, units).mapInPandas(run, schemas.RESULT)
    return rows if top_k is None else best_rows(rows, top_k)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combinations on which two result tables differ."""
    keys = ["gap_period", "signal_period", "momentum_period", "vol_period"]
    values = ["final_equity", "trades", "skipped_executions", "fees_paid", "slippage_impact", "final_holding"]
    met = a.select(*keys, F.struct(*values).alias("a")).join(b.select(*keys, F.struct(*values).alias("b")), keys, "full_outer")
    return met.where(~F.col("a").eqNullSafe(F.col("b")))
