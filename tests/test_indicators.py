import numpy as np
import pytest

from gridloom import schemas
from gridloom.operators import indicators
from tests.helpers import day, synthetic


def plain_states(opens, closes, gap, signal):
    """The state by one running loop."""
    up, down, ratios, sums, state, lines = [0.0], [0.0], [], [0.0], [], []
    now = False
    for i, (o, _) in enumerate(zip(opens, closes, strict=True)):
        g = o - closes[i - 1] if i else 0.0
        up.append(up[-1] + max(g, 0.0))
        down.append(down[-1] + max(-g, 0.0))
        line = None
        if i >= gap - 1:
            u, d = up[i + 1] - up[i + 1 - gap], down[i + 1] - down[i + 1 - gap]
            ratios.append(1.0 if d == 0 else 100.0 * u / d)
            sums.append(sums[-1] + ratios[-1])
            if len(ratios) >= signal:
                line = (sums[-1] - sums[-1 - signal]) / signal
        if line is not None and lines and lines[-1] is not None and line != lines[-1]:
            now = line > lines[-1]
        lines.append(line)
        state.append(now)
    return state


@pytest.mark.parametrize(("gap", "signal"), [(5, 2), (40, 20)])
def test_gap_state_keeps_the_prefix_contract(spark, gap, signal):
    """Gaps from 1e-8 to 1e3 on a price of a million: any other order of summing flips states."""
    draw = np.random.default_rng(11)
    n = 1500
    closes = np.full(n, 1e6)
    opens = closes + draw.choice([-1, 1], n) * 10 ** draw.uniform(-8, 3, n)
    dates = np.busday_offset("2000-01-03", np.arange(n))
    rows = [(0, "T0", d.astype(object), i, float(o), float(c)) for i, (d, o, c) in enumerate(zip(dates, opens, closes, strict=True))]
    found = indicators.gap_state(spark.createDataFrame(rows, schemas.CANDLES), [gap], [signal]).orderBy("seq").collect()
    assert [r.state for r in found] == plain_states(opens.tolist(), closes.tolist(), gap, signal)


def test_first_gap_counts_and_no_fall_is_one(spark):
    rows = [(0, "T0", day(f"2020-01-0{i + 1}"), i, 10.0 + i, 10.0 + i) for i in range(4)]
    found = {r.seq: r.ratio for r in indicators.gap_ratio(spark.createDataFrame(rows, schemas.CANDLES), [2]).collect()}
    assert found == {0: None, 1: 1.0, 2: 1.0, 3: 1.0}


def test_equal_gates_are_grouped(spark):
    gates = [(v, w, 0, not (v == 4 and w == 1)) for v in (2, 3, 4, 5) for w in (0, 1)]
    found = indicators.gate_groups(spark.createDataFrame(gates, "vol_period int, week_idx int, ticker_idx int, ok boolean"))
    assert sorted((r.representative, r.vol_values) for r in found.collect()) == [(2, [2, 3, 5]), (4, [4])]


def test_momentum_and_gate_shapes(spark):
    m = synthetic(spark, days=60, tickers=1)
    assert indicators.momentum(m.candles, [5]).where("score is null").count() == 5
    assert indicators.vol_gate(m.candles, [21]).where("ok").count() == 40
