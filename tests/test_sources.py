import json
import zipfile

import pytest

from gridloom import schemas
from gridloom.operators import schedule
from gridloom.plans.market import market
from gridloom.sources import candles, sinks
from tests.helpers import day


# The places and codes of the archive's lines.
def line(kind: str, date: str = "", bdi: str = "02", market_: str = "010") -> str:
    return (kind + date.ljust(8) + bdi + "TICK".ljust(12) + market_).ljust(245)


def archive(path, lines):
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("PRICES.TXT", "\r\n".join(lines))


def test_archive_sessions_and_cut(spark, tmp_path):
    archive(tmp_path / "a.zip", [line("00"), line("01", "20200102"), line("01", "20200102", "08"), line("01", "20200103"), line("01", "20200104", "58"), line("01", "20200105", "02", "020"), line("01", "20200106"), line("99")])
    found = candles.archive_sessions(spark, str(tmp_path / "*.zip"))
    days = sorted(r[0] for r in candles.build_calendar(found, "2020-01-05").collect())
    assert days == [day("2020-01-02"), day("2020-01-03")]


@pytest.mark.parametrize("lines", [[line("00"), line("01", "20200102")], [line("01", "20200102"), line("99")], [line("00"), line("00"), line("99")], [line("00"), "01short", line("99")]])
def test_broken_archives_fail(spark, tmp_path, lines):
    archive(tmp_path / "a.zip", lines)
    with pytest.raises(Exception, match="truncated|header"):
        candles.archive_sessions(spark, str(tmp_path / "a.zip")).collect()


def test_candle_files_are_cleaned_in_order(spark, tmp_path):
    (tmp_path / "abc_1d.csv").write_text("date,open,close\n2020-01-03,2,3\n2020-01-02 00:00:00,1,2\n2020-01-06,1,1\n2020-01-06,1,-1\n2020-01-07,x,1\n2020-01-08,NaN,1\n2020-01-09,inf,1\n2020-01-03,4,5\n")
    (tmp_path / "u.json").write_text(json.dumps({"tickers": ["zzz", "abc"]}))
    rows = candles.clean(candles.candle_files(spark, str(tmp_path / "*_1d.csv")))
    table = candles.sequenced(rows, candles.universe(spark, str(tmp_path / "u.json"))).orderBy("seq").collect()
    assert [(r.ticker_idx, r.ticker, r.date, r.seq, r.open, r.close) for r in table] == [(1, "ABC", day("2020-01-02"), 0, 1.0, 2.0), (1, "ABC", day("2020-01-03"), 1, 4.0, 5.0)]


def test_calendar_file_must_increase(spark, tmp_path):
    (tmp_path / "c.csv").write_text("date\n2020-01-02\n2020-01-03\n")
    assert candles.calendar_file(spark, str(tmp_path / "c.csv")).count() == 2
    (tmp_path / "d.csv").write_text("date\n2020-01-03\n2020-01-03\n")
    with pytest.raises(ValueError):
        candles.calendar_file(spark, str(tmp_path / "d.csv"))


def sessions(spark, *days):
    return spark.createDataFrame([(day(d),) for d in days], "session_date date")


def one_ticker(spark, *days):
    return spark.createDataFrame([(0, "T0", day(d), i, 1.0, 1.0) for i, d in enumerate(days)], schemas.CANDLES)


def test_session_that_no_ticker_traded_still_makes_a_week(spark):
    m = market(one_ticker(spark, "2020-01-02", "2020-01-03", "2020-01-07"), 1, sessions(spark, "2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07"))
    assert [tuple(r) for r in m.weeks.collect()] == [(0, day("2020-01-03"), day("2020-01-06"))]


def test_candle_outside_calendar_fails(spark):
    with pytest.raises(ValueError):
        market(one_ticker(spark, "2020-01-02", "2020-01-06"), 1, sessions(spark, "2020-01-02", "2020-01-03"))


def test_start_in_midweek_and_iso_year_end(spark):
    cal = sessions(spark, "2018-12-27", "2018-12-28", "2018-12-31", "2019-01-02", "2019-01-07")
    every = [r.execution_date for r in schedule.weekly_schedule(cal).collect()]
    assert every == [day("2018-12-31"), day("2019-01-07")]
    assert [r.execution_date for r in schedule.weekly_schedule(cal, "2019-01-02").collect()] == [day("2019-01-07")]
    assert schedule.weekly_schedule(cal, None, "2018-12-30").count() == 0


def test_sinks_round_trip(spark, tmp_path):
    empty = sinks.empty_results(spark)
    assert [f.name for f in empty.schema] == [x.split()[0] for x in schemas.RESULT.split(", ")]
    row = spark.createDataFrame([(5, 2, 5, 21, 1 / 3, 0.5, 1, 0, 0.1, 0.2, "T0", day("2020-01-02"), day("2020-02-02"), 0)], schemas.RESULT)
    sinks.write_csv(row, str(tmp_path / "r"), "gzip")
    back = sinks.read_results(spark, str(tmp_path / "r")).first()
    assert abs(back.final_equity - 1 / 3) < 1e-12 and back.start == day("2020-01-02")
    assert "| 5 | 2 |" in sinks.markdown("x", row)
    sinks.write_cache(row, str(tmp_path / "c"), {"data": "a"})
    assert sinks.read_cache(spark, str(tmp_path / "c"), {"data": "a"}).count() == 1
    with pytest.raises(ValueError):
        sinks.read_cache(spark, str(tmp_path / "c"), {"data": "b"})
    (tmp_path / "f.txt").write_text("abc")
    assert sinks.file_hashes(spark, str(tmp_path / "f.txt")).first().sha256.startswith("ba7816bf")
