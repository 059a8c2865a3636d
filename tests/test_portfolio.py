import itertools

import pytest

from gridloom.config import Costs, Grid
from gridloom.functions.money import affordable, affordable_by_scan
from gridloom.operators import portfolio, ranking, replay, topk
from gridloom.plans import grid as vector
from gridloom.plans.market import backtest, week_arrays
from pyspark.sql import functions as F
from tests.helpers import fold_input, synthetic

FREE = Costs(100.0, 0.0, 0.0, 0.0)


# Hand cases of the portfolio's rules, with the results that the rules give.
@pytest.mark.parametrize(
    ("targets", "opens", "scores", "wanted"),
    [
        ([0, 0], [[60.0], [40.0]], None, (40.0, 1, 0, 1, 0)),
        ([0, 1], [[40.0, 30.0], [50.0, 30.0]], None, (0.0, 4, 1, 3, 0)),
        ([0, 1], [[40.0, 30.0], [50.0, 1000.0]], None, (20.0, 2, 0, 1, 1)),
        ([0, -1], [[40.0], [50.0]], None, (120.0, 0, -1, 2, 0)),
        ([1, 0], [[1000.0, 50.0], [50.0, 50.0]], [[0.1, 0.2], [0.2, 0.2]], (0.0, 2, 1, 1, 0)),
        ([0, 1], [[40.0, 30.0], [None, 30.0]], None, (20.0, 2, 0, 1, 1)),
        ([-1, -1], [[40.0], [50.0]], None, (100.0, 0, -1, 0, 0)),
    ],
    ids=["same target", "switch", "failed switch", "to cash", "tie", "no price to sell", "cash"],
)
def test_hand_cases(spark, targets, opens, scores, wanted):
    p = portfolio.fold(fold_input(spark, targets, opens, scores), FREE).first().p
    assert (p.cash, p.shares, p.holding, p.trades, p.skipped) == wanted


def test_switch_with_costs(spark):
    p = portfolio.fold(fold_input(spark, [0, 1], [[50.0, 25.0], [60.0, 30.0]]), Costs(1000.0)).first().p
    assert p.holding == 1 and p.trades == 3 and p.fees > 0 and p.slip > 0 and p.cash >= 0


@pytest.mark.parametrize("costs", [FREE, Costs(), Costs(1000.0, 12.5, 40.0, 20.0)], ids=["free", "usual", "dear"])
def test_quantity_equals_a_scan_of_all_quantities(spark, costs):
    """Around the edges of lots, for prices from cents to hundreds. Where the cash is a
    quantity's cost to the last bit, rounding may make the formula one less."""
    rows = [(n, float(lots * 100 + loose) * price * (1 + nudge), price) for n, (lots, loose, price, nudge) in enumerate(itertools.product((0, 1, 3), (0, 1, 50, 99), (0.07, 1.0, 12.34, 512.0), (1e-7, 0.0015, 0.02)))]
    rows += [(9000, 0.0, 5.0), (9001, -3.0, 5.0), (9002, 50.0, 0.0), (9003, None, 5.0), (9004, 50.0, None), (9005, 50.0, 49.99)]
    frame = spark.createDataFrame(rows, "n int, cash double, price double")
    scanned = {r.n: r.quantity for r in affordable_by_scan(frame, ["n"], *costs.rates).collect()}
    found = {r.n: r.q for r in frame.withColumn("q", affordable(F.col("cash"), F.col("price"), *costs.rates)).collect()}
    assert found == scanned and len(found) == len(rows) and max(found.values()) > 300


def test_scan_of_a_fortune_takes_few_tries(spark):
    """Some 1e15 shares: trying each one by one would never end."""
    fee, base, extra = Costs().rates
    cash, price = 1e13, 0.01
    (row,) = affordable_by_scan(spark.createDataFrame([(1, cash, price)], "n int, cash double, price double"), ["n"], fee, base, extra).collect()
    cost = lambda q: price * ((1.0 + base) * q + extra * (q % 100)) * (1.0 + fee)
    assert row.quantity > 9e14 and cost(row.quantity) <= cash + 1e-9
    assert cost(row.quantity + 1) > cash + 1e-9 and cost(row.quantity // 100 * 100 + 100) > cash + 1e-9


def test_close_scores_rank_as_floats(spark):
    rows = spark.createDataFrame([(5, 0, 0, 1.00000001), (5, 0, 1, 1.00000002), (5, 1, 0, 0.5), (5, 1, 1, 0.5)], "momentum_period int, week_idx int, ticker_idx int, score double")
    best = ranking.ranked(rows).where("rank = 1").orderBy("week_idx").collect()
    assert [r.ticker_idx for r in best] == [1, 0]


@pytest.mark.parametrize("skip", [0.0, 0.2])
def test_both_plans_agree_to_the_bit_and_reconcile(spark, skip):
    m, costs = synthetic(spark, skip=skip), Costs()
    grid = Grid((5, 20), (2, 5), (5, 30), (5, 21))
    slow, fast = backtest(m, grid, costs), vector.grid_results(m, grid, costs)
    assert fast.count() == grid.size and vector.agreement(slow, fast).count() == 0
    history = portfolio.history(week_arrays(m, grid), costs)
    checks = replay.reconcile(slow, replay.curves(history, m.candles, m.calendar, m.weeks, costs), history).collect()
    assert len(checks) == grid.size and all(all(r[4:]) for r in checks)


def test_top_k_breaks_ties_by_parameters(spark):
    """Equities of few values, so that most rows tie."""
    rows = [(g, s, m, 21, float(100 + (g * 7 + s * 5 + m * 3) % 6), 1) for g in (9, 4, 12) for s in (3, 8) for m in range(20, 30)]
    frame = spark.createDataFrame(rows, "gap_period int, signal_period int, momentum_period int, vol_period int, final_equity double, trades int").repartition(5)
    wanted = sorted(rows, key=lambda r: (-r[4], r[:4]))[:23]
    assert [tuple(r) for r in topk.top_k(frame, 23).collect()] == wanted
    parts = [topk.top_k(frame.where(f"gap_period = {g}"), 23) for g in (4, 9, 12)]
    assert [tuple(r) for r in topk.merge_top_k(parts, 23).collect()] == wanted
    twin = frame.unionByName(frame.withColumn("vol_period", F.lit(22)))
    assert [tuple(r) for r in topk.top_k(twin, 23, dedupe_equivalent=True).collect()] == wanted
