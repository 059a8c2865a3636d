import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.config import Costs
from gridloom.operators import audits, indicators, metrics
from gridloom.plans import catalog
from gridloom.plans import walk_forward as wf
from tests.helpers import day, synthetic


def curve(spark, rows):
    return spark.createDataFrame([(day(d), e) for d, e in rows], "date date, equity double")


@pytest.mark.parametrize(("first", "last", "complete"), [("2020-01-02", "2020-12-20", False), ("2020-01-02", "2020-12-28", True), ("2020-07-01", "2020-12-31", False), ("2020-01-08", "2020-12-31", False)])
def test_complete_years(spark, first, last, complete):
    row = metrics.annual(curve(spark, [(first, 1.0), (last, 2.0)]), 1.0).first()
    assert row.complete_year == complete and row["return"] == 1.0


def test_risk_by_hand(spark):
    r = metrics.risk(curve(spark, [("2020-01-01", 100.0), ("2020-01-02", 110.0), ("2021-01-01", 99.0)]), 100.0).first()
    days = [0.1, -0.1]
    sd = math.sqrt(sum((x - 0.0) ** 2 for x in days))
    years = 366 / 365.2425
    assert math.isclose(r.max_drawdown, -0.1) and math.isclose(r.annual_volatility, sd * math.sqrt(252)) and math.isclose(r.cagr, 0.99 ** (1 / years) - 1)
    one = metrics.risk(curve(spark, [("2020-01-01", 100.0)]), 100.0).first()
    assert one.sharpe is None and one.annual_volatility is None and one.cagr is None


def test_bad_curves_fail_and_repeats_keep_the_last(spark):
    with pytest.raises(Exception, match="finite"):
        metrics.normalised(curve(spark, [("2020-01-01", -1.0)])).collect()
    rows = spark.createDataFrame([(day("2020-01-01"), 1.0, 0), (day("2020-01-01"), 2.0, 1)], "date date, equity double, row int")
    assert [r.equity for r in metrics.normalised(rows).collect()] == [2.0]


def test_geometric_mean_of_a_total_loss_is_null(spark):
    years = spark.createDataFrame([(2020, -1.0, True), (2021, 0.5, True), (2022, 9.0, False)], "year int, return double, complete_year boolean")
    row = metrics.complete_year_means(years).first()
    assert row.complete_years == 2 and row.average_return == -0.25 and row.geometric_mean is None


GOOD = ("T0", "2020-01-10", "2020-01-09", 2.0, "split", "exchange", "https://example.org/x")


@pytest.mark.parametrize(
    ("change", "problem"),
    [({}, None), ({3: 1.0}, "ratio"), ({3: None}, "missing field"), ({0: "T9"}, "not in universe"), ({2: "2020-01-10"}, "dates"), ({6: "http://example.org"}, "source"), ({5: " "}, "authority")],
)
def test_overrides(spark, change, problem):
    row = tuple(change.get(i, v) for i, v in enumerate(GOOD))
    found = {r.problem for r in audits.overrides(spark.createDataFrame([row], schemas.OVERRIDE), spark.createDataFrame([("T0",)], "ticker string")).collect()}
    assert (problem in found) if problem else not found


def test_shards_fail_closed(spark):
    meta = lambda *rows: spark.createDataFrame(rows, "shard int, gap_values array<int>, fee double, run string, tested_rows long")
    good = [(0, [5, 7], 3.25, "a", 2), (1, [6], 3.25, "a", 1)]
    check = lambda rows: audits.shard_contract(meta(*rows), ["fee", "run"], 2).count()
    assert check(good) == 0
    for bad in ([good[0]], [*good, good[0]], [good[0], (1, [6], 3.0, "a", 1)], [good[0], (1, [6], 3.25, "b", 1)], [good[0], (1, [5], 3.25, "a", 1)], [good[0], (2, [6], 3.25, "a", 1)]):
        assert check(bad) > 0
    gaps = lambda *x: spark.createDataFrame([(v,) for v in x], "gap_period int")
    found = lambda *x: [(r.problem, r.what) for r in audits.shard_contract(meta(*good), ["fee", "run"], 2, gaps(*x)).collect()]
    assert found(5, 6, 7) == [] and found(5, 6, 7, 8) == [("gap without owner", "8")] and found(5, 6) == [("unknown gap", "7")]
    rows = spark.createDataFrame([(0,), (0,), (1,)], "shard int")
    assert audits.row_counts(rows, meta(*good)).count() == 0
    assert audits.row_counts(rows, meta(good[0], (1, [6], 3.25, "a", 9))).count() == 1
    with pytest.raises(audits.AuditError):
        audits.require("rows", rows)


def test_stale_age_counts_sessions_and_cash_is_fresh(spark):
    m = synthetic(spark, days=10, tickers=2)
    days = [r.date for r in m.candles.where("ticker_idx = 0").orderBy("date").collect()]
    candles = m.candles.where(~((m.candles.ticker_idx == 0) & (m.candles.seq.isin(3, 4))))
    rows = spark.createDataFrame([(days[2], "T0"), (days[4], "T0"), (days[5], "CASH")], "date date, holding string")
    stale = audits.stale_prices(rows, candles, m.calendar)
    assert {r.date: r.stale_sessions for r in stale.collect()} == {days[2]: 0, days[4]: 2}
    assert tuple(audits.stale_summary(stale, rows, 1).first()) == (2, 1, "CASH", 0)


def test_golden_differences(spark):
    row = (day("2020-01-02"), "T0", 1, 2.0, 3.0, "T0")
    make = lambda *rows: spark.createDataFrame(list(rows), schemas.GOLDEN)
    assert audits.golden(make(row), make(row)).count() == 0
    assert [r.column for r in audits.golden(make(row), make((*row[:4], 3.1, "T0"))).collect()] == ["equity"]
    assert audits.golden(make(row), make((day("2020-01-03"), *row[1:]))).count() == 5
    assert {r.column for r in audits.golden(make(row, row), make(row)).collect()} == {"date"}
    large = (*row[:3], 2e8, 1e8, "T0")
    assert audits.golden(make(large), make((*row[:3], 2e8 + 1e-3, 1e8 + 1.0, "T0"))).count() == 1  # beyond a relative 1e-10


def test_golden_query_tells_days_of_any_equity(spark, monkeypatch):
    days = [(day(f"2020-01-0{d}"), "T0", 1, 2.0, e, "T0") for d, e in ((1, 3.7e12), (2, 3.7e12), (3, 3.7e12))]
    monkeypatch.setattr(catalog, "_curve", lambda spark, sf_dir: spark.createDataFrame(days, schemas.GOLDEN))
    assert sorted((r.date.day, r.column) for r in catalog.golden_diff(spark, "").collect()) == [(1, "equity"), (1, "shares"), (2, "equity")]


def test_golden_gate_and_indicators(spark):
    meta = dict.fromkeys(audits.GOLDEN_FIELDS, 1) | {"source": audits.GOLDEN_SOURCE, "fixture_sha256": HEX[0]}
    assert audits.golden_gate(meta, HEX[0]) == []
    for bad, sha in (({"source": "x"}, HEX[0]), ({}, HEX[1]), ({"fixture_sha256": ""}, "")):
        assert audits.golden_gate(meta | bad, sha)
    assert audits.golden_gate({k: v for k, v in meta.items() if k != "end"}, HEX[0]) == ["end is missing"]
    make = lambda *rows: spark.createDataFrame(list(rows), "decision_date date, ticker string, gap_state boolean, momentum double, vol_valid boolean, selected_top1 string")
    d = day("2020-01-02")
    own = make((d, "T0", True, 0.5, True, "T0"), (d, "T1", False, None, True, "T0"))
    assert audits.golden_indicators(make((d, "t0", True, 0.5, True, "T0"), (d, "T0", True, 0.5, True, "T0"), (d, "T1", False, float("nan"), True, "T0")), own).count() == 0
    found = audits.golden_indicators(make((d, "T0", False, 0.5 + 1e-9, True, "CASH"), (d, "T1", False, 0.1, False, "T0"), (d, "T2", True, 0.1, True, "T0")), own)
    assert sorted((r.ticker, r.column) for r in found.collect()) == [("T0", "gap_state"), ("T0", "momentum"), ("T0", "selected_top1"), ("T1", "momentum"), ("T1", "vol_valid"), ("T2", "context")]


HEX = [hashlib.sha256(bytes([i])).hexdigest() for i in range(5)]


def manifest(**change):
    """A manifest with the published field names (fixed values)."""
    span = {"start": "2018-01-02", "end": "2019-12-30"}
    costs = {"initial_cash": 1000.0, "fee_bps_per_side": 3.25, "slippage_bps_per_side": 10.0, "odd_lot_extra_bps_weighted": 5.0}
    good = {"schema_version": 2, "optimizer_sha": HEX[0][:40].upper(), "upstream_sha": HEX[1][:40], "optimizer_source_sha256": {"x": HEX[2]}, "execution": span | costs}
    good["selection_provenance"] = {"mode": "training_only", "training_start": span["start"], "training_end": span["end"], "top_100_sha256": HEX[3]}
    for path, value in change.items():
        *head, last = path.split("__")
        at = good
        for k in head:
            at = at[k]
        at[last] = value
    return good


WINDOW = wf.WindowRow("w", "2018-01-02", "2019-12-31", "2020-01-01", None)


@pytest.mark.parametrize(
    "bad",
    [
        {"schema_version": 1}, {"schema_version": "x"}, {"optimizer_sha": "abc"}, {"upstream_sha": None}, {"optimizer_source_sha256": {}}, {"optimizer_source_sha256": {"x": "1"}},
        {"selection_provenance__mode": "full"}, {"selection_provenance__training_end": "2020-01-01"}, {"selection_provenance__training_start": "2018-01-03"},
        {"selection_provenance__top_100_sha256": HEX[4]}, {"execution__initial_cash": 1.0}, {"execution__fee_bps_per_side": 1.0}, {"execution__slippage_bps_per_side": None},
        {"execution__odd_lot_extra_bps_weighted": 4.0}, {"execution__start": "2018-01-03"}, {"execution__end": "2019-12-20"}, {"execution__end": "2020-01-01"}, {"execution__end": "soon"},
    ],
)
def test_training_provenance(bad):
    wf.verify_training(manifest(), WINDOW, Costs(), HEX[3])
    with pytest.raises(ValueError):
        wf.verify_training(manifest(**bad), WINDOW, Costs(), HEX[3])


def test_walk_forward_carries_capital_only(spark):
    from gridloom.plans.market import market

    base = synthetic(spark, days=800)
    windows = [wf.WindowRow("a", "2017-01-02", "2018-06-29", "2018-07-02", "2018-12-31", (5, 2, 10, 21)), wf.WindowRow("b", "2017-01-02", "2018-12-31", "2019-01-01", "2019-06-28", (10, 3, 5, 21)), wf.WindowRow("c", "2017-01-02", "2029-01-01", "2030-01-01", None, (5, 2, 5, 21))]
    rows = wf.walk_forward(lambda s, e: market(base.candles, 3, start=s, end=e), windows, Costs()).orderBy("date").collect()
    a, b = [r for r in rows if r.window_id == "a"], [r for r in rows if r.window_id == "b"]
    assert a[0].date >= dt.date(2018, 7, 2) and a[-1].date <= dt.date(2018, 12, 31) and len(a) + len(b) == len(rows)
    before = next(i for i, r in enumerate(b) if r.holding != "CASH")
    assert b[0].cash == a[-1].equity or before == 0
    with pytest.raises(ValueError):
        wf.check_windows([windows[1], windows[0]])
    load = lambda s, e: market(base.candles, 3, start=s, end=e)
    cut = wf.walk_forward(load, windows, Costs(), "2018-09-28")
    assert max(r.date for r in cut.collect()) <= dt.date(2018, 9, 28) and {r.window_id for r in cut.collect()} == {"a"}
    with pytest.raises(ValueError, match="no window"):
        wf.walk_forward(load, windows, Costs(), "2017-01-01")


def test_calendar_gate(spark):
    cal = spark.createDataFrame([(day("2020-01-02"),), (day("2020-01-03"),)], "session_date date")
    meta = {"status": "PASS", "requested_end": "2020-01-05", "calendar_sha256": "x", "first_session": "2020-01-02", "last_session": "2020-01-03", "session_count": 2}
    assert audits.calendar_gate(cal, meta, "x", "2020-01-05") == []
    assert audits.calendar_gate(cal, meta | {"session_count": 3}, "x", "2020-01-05")
    assert audits.calendar_gate(cal, meta, "y", "2020-01-05")


def test_curves_are_checked_before_they_are_measured(spark):
    curve = lambda *rows, schema="date date, equity double": spark.createDataFrame(list(rows), schema)
    good = curve((day("2020-01-02"), 5.0), (day("2020-01-03"), 6.0))
    assert [r.equity for r in metrics.normalised(good).orderBy("date").collect()] == [5.0, 6.0]
    with pytest.raises(ValueError, match="no column equity"):
        metrics.normalised(good.drop("equity"))
    with pytest.raises(ValueError, match="no column k"):
        metrics.normalised(good, ["k"])
    with pytest.raises(ValueError, match="has no row"):
        metrics.normalised(good.where("false"))
    assert metrics.normalised(good.where("false"), least=0).count() == 0
    text = curve(("2020-01-02 10:00", "5"), ("2020-01-02", "7"), schema="date string, equity string").withColumn("row", F.monotonically_increasing_id())
    assert [tuple(r) for r in metrics.normalised(text.coalesce(1)).collect()] == [(day("2020-01-02"), 7.0)]
    for bad in (("soon", "5"), ("2020-01-02", "x"), ("2020-01-02", "-1"), ("2020-01-02", "inf"), (None, "5")):
        with pytest.raises(Exception, match="must be"):
            metrics.normalised(curve(bad, schema="date string, equity string")).collect()


def test_vol_islands_and_annual_map(spark):
    rows = [(5, v, e) for v, e in ((2, 1.0), (3, 1.0), (4, 2.0), (6, 1.0), (7, 1.0), (8, 1.0), (21, 2.0))]
    found = indicators.vol_islands(spark.createDataFrame(rows, "gap_period int, vol_period int, final_equity double"), ["gap_period"], ["final_equity"])
    assert sorted((r.vols, r.final_equity) for r in found.collect()) == [("2..3", 1.0), ("21", 2.0), ("4", 2.0), ("6..8", 1.0)]
    years = spark.createDataFrame([("a", 2020, 0.5), ("a", 2021, None), ("b", 2020, -0.1)], "k string, year int, return double")
    assert {r.k: r.returns for r in metrics.annual_map(years, ["k"]).collect()} == {"a": {2020: 0.5}, "b": {2020: -0.1}}
