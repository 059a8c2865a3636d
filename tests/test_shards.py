import json

import numpy as np
import pytest

from gridloom.__main__ import main
from gridloom.config import Costs
from gridloom.plans import reports
from gridloom.sources import candles, shards
from tests.helpers import day
from tests.test_sources import archive, line

HEX = "0123456789abcdef" * 4
PROVENANCE = {"github_run_id": "77", "optimizer_sha": HEX[:40], "github_repository": "someone/something", "snapshot_upstream_sha": HEX[24:], "snapshot_universe_sha256": HEX, "snapshot_requested_end": "2019-06-28"}
AXES = ["--gap-min=5", "--gap-max=6", "--signal-min=2", "--signal-max=3", "--momentum-min=5", "--momentum-max=6", "--shards=3", f"--provenance={json.dumps(PROVENANCE)}"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two tickers' candle files, and three shards of two gaps, so the last is empty."""
    base = tmp_path_factory.mktemp("shards")
    draw = np.random.default_rng(8)
    dates = np.busday_offset("2017-01-02", np.arange(650))
    for name in ("aaa", "bbb"):
        close = 20 * np.cumprod(1 + draw.normal(0.0003, 0.012, len(dates)))
        rows = [f"{d},{c * 1.001:.6f},{c:.6f}" for d, c in zip(dates, close, strict=True)]
        (base / f"{name}_1d.csv").write_text("date,open,close\n" + "\n".join(rows) + "\n")
    (base / "universe.json").write_text(json.dumps({"tickers": ["AAA", "BBB"]}))
    for i in range(3):
        assert main(["run", f"--results={base}/out", f"--shard={i}", *source(base), *AXES], spark) == 0
    return base


def rewrite(path, text):
    """Also without the checksum that the local file system keeps beside a file."""
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    path.write_text(text)


def source(base):
    return [f"--candles={base}/*_1d.csv", f"--universe={base}/universe.json", "--start=2018-01-02", "--end=2019-06-28"]


def test_programs_run_audit_and_reduce(spark, folder, capsys):
    assert main(["audit", f"--results={folder}/out", *AXES], spark) == 0
    assert main(["reduce", f"--results={folder}/out", f"--output={folder}/best", "--top=3", *source(folder), *AXES], spark) == 0
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    best = spark.read.csv(f"{folder}/best/top.csv", header=True, inferSchema=True).orderBy("final_equity", ascending=False).collect()
    assert said["status"] == "PASS" and len(best) == 3 and [best[0][c] for c in ("gap_period", "signal_period", "momentum_period", "vol_period")] == said["best"]
    assert (folder / "best" / "grid.md").read_text().startswith("# Exhaustive grid") and "| 2018 |" in (folder / "best" / "annual.md").read_text()
    meta = [json.loads((folder / "out" / f"shard_{i}.json").read_text()) for i in range(3)]
    assert [m["gap_values"] for m in meta] == [[5], [6], []] and [m["rows"] for m in meta] == [4, 4, 0]


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"rows": 5}, "rows"), ({"rows": 5}, "rows of ranges"), ({"csv_sha256": HEX}, "csv_sha256"), ({"gap_values": [6]}, "gap_values"), ({"fee_bps": 3.0}, "fee_bps"), ({"fee_bps": 3.0}, "contract"),
        ({"shard": 2}, "shard"), ({"schema_version": 1}, "schema_version"), ({"signal_max": 4}, "signal range"), ({"vol_period": 20}, "vol_period"), ({"end": "2019-06-27"}, "end"),
        ({"optimizer_sha": "abc"}, "optimizer_sha"), ({"github_run_id": ""}, "github_run_id"), ({"snapshot_requested_end": "soon"}, "snapshot_requested_end"), ({"initial_cash": None}, "initial_cash"),
    ],
)
def test_a_spoilt_sidecar_fails(spark, folder, change, problem):
    at = folder / "out" / "shard_0.json"
    good = at.read_text()
    rewrite(at, json.dumps(json.loads(good) | change))
    try:
        assert problem in {r.problem for r in shards.audit(spark, f"{folder}/out", 3, Costs()).collect()}
    finally:
        rewrite(at, good)


def test_spoilt_sets_fail(spark, folder):
    found = lambda n=3, **p: {(r.shard, r.problem) for r in shards.audit(spark, f"{folder}/out", n, Costs(), p).collect()}
    assert found() == set() and found(github_run_id="77") == set()
    assert found(4) >= {(3, "no table"), (0, "shards")} and (2, "unknown shard") in found(2) and (1, "expected github_run_id") in found(github_run_id="78")
    for name, problem in (("shard_1.json", (1, "no sidecar")), ("shard_1.csv", (1, "no table"))):
        at = folder / "out" / name
        at.rename(folder / "away")
        assert problem in found()
        (folder / "away").rename(at)
    part = next((folder / "out" / "shard_1.csv").glob("part-*"))
    good = part.read_bytes()
    part.write_bytes(good + good.splitlines(keepends=True)[-1])
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert found() >= {(1, "rows"), (1, "csv_sha256")}
    assert main(["audit", f"--results={folder}/out", *AXES], spark) == 1
    part.write_bytes(good)
    with pytest.raises(ValueError):
        shards.audit(spark, f"{folder}/out", 0, Costs())


def test_calendar_is_materialised_once_and_gated(spark, tmp_path):
    archive(tmp_path / "a.zip", [line("00"), line("01", "20200102"), line("01", "20200103"), line("01", "20200106"), line("99")])
    make = lambda end="2020-01-05": candles.ensure_calendar(spark, str(tmp_path / "cal"), str(tmp_path / "*.zip"), end)
    days, made = make()
    assert made and sorted(r[0] for r in days.collect()) == [day("2020-01-02"), day("2020-01-03")]
    assert make()[1] is False
    with pytest.raises(ValueError, match="requested_end"):
        make("2020-01-06")
    facts = tmp_path / "cal" / "sessions.json"
    meta = json.loads(facts.read_text())
    for change in ({"source": "else"}, {"session_count": 3}, {"calendar_sha256": HEX}):
        rewrite(facts, json.dumps(meta | change))
        with pytest.raises(ValueError):
            make()
    facts.unlink()
    with pytest.raises(ValueError, match="both"):
        make()


def test_sessions_and_first_year(spark):
    rows = spark.createDataFrame([("A", day("2011-05-03")), ("B", day("2010-01-04")), ("B", day("2011-05-03"))], "ticker string, date date")
    days, label = candles.sessions(spark, rows)
    assert label == candles.OBSERVED and days.count() == 2 and candles.first_year(rows) == 2010
    with pytest.raises(ValueError):
        candles.first_year(rows.where("false"))


def test_reports(spark):
    one = lambda columns, *rows: spark.createDataFrame(list(rows), columns)
    combo = "gap_period int, signal_period int, momentum_period int, vol_period int"
    oos = reports.oos_report(one(f"training_rank int, {combo}, total_return double, cagr double, max_drawdown double", (2, 5, 2, 9, 21, 0.5, None, -0.1), (1, 6, 2, 9, 21, 0.25, 0.1, -0.2)), ("a", "b"), ("c", "d"))
    assert "| 1 | 6 | 2 | 9 | 21 | 25.00 % | 10.00 % | -20.00 % |\n| 2 | 5 | 2 | 9 | 21 | 50.00 % | n/a | -10.00 % |" in oos
    risk = one("total_return double, cagr double, max_drawdown double", (0.2, 0.1, -0.3))
    forward = reports.walk_forward_report(one(f"window_id string, first date, last date, {combo}, start_equity double, end_equity double", ("w1", day("2020-01-02"), day("2020-12-30"), 5, 2, 9, 21, 100.0, 120.0)), risk, 0)
    assert "| w1 | 2020-01-02 to 2020-12-30 | 5/2/9/21 | 20.00 % | 120.00 |" in forward and "changes of parameters: 0" in forward
    near = one("count long, median_return double, mean_return double, min_return double, max_return double, share_positive double, share_top_1pct double", (3, 0.1, 0.1, 0.0, 0.2, 1.0, None))
    robust = reports.robustness_report(one("point double, total_return double", (0.5, 0.1)), near, one(f"direction string, {combo}, total_return double", ("gap+1", 6, 2, 9, 21, 0.1)), one("axis string, value int, share double", ("gap_period", 6, 0.5)))
    assert "- quantile 0.5: 10.00 %" in robust and "| gap+1 | 6 | 2 | 9 | 21 | 10.00 % |" in robust and "share_top_1pct: n/a" in robust
    assert reports.table(["a|b"], [["x|y"]])[0] == "| a\\|b |"
