import pytest

from gridloom.config import Costs, Grid, check_dates, ranges, required_warmup


def test_published_grid_size():
    assert ranges((5, 80), (2, 60), (5, 252)).size == 1_112_032
    assert ranges((5, 80), (2, 60), (5, 252), (2, 60)).size == 65_609_888


def test_shards_cover_every_gap_once():
    grid = ranges((5, 80), (2, 3), (5, 6))
    shards = [grid.shard(i, 20) for i in range(20)]
    assert sorted(g for s in shards for g in s.gaps) == list(grid.gaps)
    assert Grid((5,), (2,), (5,)).shard(1, 2) is None


@pytest.mark.parametrize("bad", [{"initial_cash": 0}, {"initial_cash": float("nan")}, {"fee_bps": -1}, {"fee_bps": 325}, {"slippage_bps": float("nan")}])
def test_costs_are_checked(bad):
    with pytest.raises(ValueError):
        Costs(**bad)


@pytest.mark.parametrize("bad", [((0,), (2,), (5,), (21,)), ((5,), (2,), (5,), (1,)), ((5, 5), (2,), (5,), (21,)), ((5.0,), (2,), (5,), (21,)), ((), (2,), (5,), (21,)), ((True,), (2,), (5,), (21,))])
def test_periods_are_checked(bad):
    with pytest.raises(ValueError):
        Grid(*bad)


def test_dates_and_warmup():
    assert required_warmup(80, 60, 252, 21) == 263
    assert check_dates("2018-01-02", "")[1] is None
    for pair in (("2018-01-02", "2018-01-02"), ("x", None)):
        with pytest.raises(ValueError):
            check_dates(*pair)
    with pytest.raises(ValueError):
        ranges((9, 5), (2, 3), (5, 6))
