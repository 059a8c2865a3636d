import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

from gridloom.plans import catalog, file_catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, dt.datetime):
        return str(v.date())
    if isinstance(v, bool) or not isinstance(v, (int, float, decimal.Decimal)):
        return str(v)
    return f"{float(v):.4f}"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql() | file_catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = (catalog.queries() | file_catalog.queries())[name](spark, SF)
    want = con.sql((catalog.oracle_sql() | file_catalog.oracle_sql())[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) | set(file_catalog.queries()) <= set(entry.queries())


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    from gridloom.streaming import bars

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = bars.daily_bars(bars.read_events(spark, str(tmp_path / "in")), "40 days").writeStream.outputMode("update").format("memory").queryName("bars").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    wanted = {tuple(r) for r in bars.daily_bars(events).collect()}
    assert wanted <= {tuple(r) for r in spark.table("bars").collect()}
