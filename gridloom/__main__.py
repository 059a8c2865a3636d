"""python -m gridloom PROGRAM: a shard of a grid (run), the reduction of a set of shards
(reduce) and its audit (audit); the test of training's best on a later span (oos), a
walk-forward with windows and artefacts (walk-forward), a grid's robustness (robustness);
the audit of a snapshot (snapshot), its calendar (calendar) and a final manifest
(manifest). Exit status 1: an audit or a gate found a problem."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom import config
from gridloom.operators import audits, metrics, portfolio, replay, topk
from gridloom.operators.ranking import COMBO
from gridloom.plans import grid as vector
from gridloom.plans import programs, reports
from gridloom.plans.market import periods, week_arrays
from gridloom.plans.programs import costs as _costs
from gridloom.plans.programs import load_market
from gridloom.plans.walk_forward import COST_FIELDS
from gridloom.sources import shards, sinks

MONEY = (("initial-cash", 1000.0), ("fee-bps", 3.25), ("slippage-bps", 10.0), ("odd-lot-extra-bps", 5.0))


def _money(s: argparse.ArgumentParser, defaults: bool = True) -> None:
    for cost, value in MONEY:
        s.add_argument(f"--{cost}", type=float, default=value if defaults or cost == "initial-cash" else None)


def _market_files(s: argparse.ArgumentParser) -> None:
    s.add_argument("--candles", required=True, help="glob of <ticker>_1d.csv files")
    s.add_argument("--universe", required=True)
    s.add_argument("--calendar")


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    sub = p.add_subparsers(dest="program", required=True)
    for name in ("run", "reduce", "audit"):
        s = sub.add_parser(name)
        s.add_argument("--results", required=True, help="the shards' folder")
        # What an audit isn't told it takes from the environment or the first sidecar.
        s.add_argument("--shards", type=int, default=None if name == "audit" else 1)
        for axis, low, high in (("gap", 5, 80), ("signal", 2, 40), ("momentum", 5, 120), ("vol", 21, 21)):
            s.add_argument(f"--{axis}-min", type=int, default=low)
            s.add_argument(f"--{axis}-max", type=int, default=high)
        _money(s, name != "audit")
        s.add_argument("--provenance", default="{}", help="JSON of the fields that all sidecars share")
        if name != "audit":
            _market_files(s)
            s.add_argument("--start", default="2018-01-02")
            s.add_argument("--end", default="")
        if name == "audit":
            s.add_argument("--snapshot-meta", help="JSON metadata of the snapshot, which must be in PASS")
            s.add_argument("--universe", help="names that a final holding may have")
        if name == "run":
            s.add_argument("--shard", type=int, default=0)
        if name == "reduce":
            s.add_argument("--top", type=int, default=100)
            s.add_argument("--output", required=True)
    for name in ("oos", "walk-forward"):
        s = sub.add_parser(name)
        _market_files(s)
        _money(s)
        s.add_argument("--training", required=True, help="an artefact's folder" if name == "oos" else "the folder of the artefacts' folders")
        s.add_argument("--end", default="")
        s.add_argument("--output", required=True)
        if name == "oos":
            s.add_argument("--start", required=True)
            s.add_argument("--top", type=int, default=3)
        else:
            s.add_argument("--windows", required=True)
            s.add_argument("--as-of", action="store_true", help="choose artefacts by their span, not by their name")
    s = sub.add_parser("robustness")
    s.add_argument("--results", required=True)
    s.add_argument("--vol", type=int, default=0, help="look at one vol period only")
    s.add_argument("--radius", type=int, default=2)
    s.add_argument("--output", required=True)
    for name in ("snapshot", "calendar"):
        s = sub.add_parser(name)
        s.add_argument("--calendar", required=True, help="folder of sessions.csv and sessions.json")
        s.add_argument("--archives", required=name == "calendar", help="glob of the exchange's archives")
        s.add_argument("--requested-end", required=True)
        if name == "snapshot":
            s.add_argument("--candles", required=True)
            s.add_argument("--universe", required=True)
            s.add_argument("--overrides", required=True)
            s.add_argument("--upstream-sha", required=True)
            s.add_argument("--start", default="2018-01-02")
            s.add_argument("--tickers", type=int, default=40)
            s.add_argument("--least-rows", type=int, default=300)
            s.add_argument("--must", nargs="*", default=[])
            s.add_argument("--must-not", nargs="*", default=[])
            s.add_argument("--output", required=True)
    s = sub.add_parser("manifest")
    s.add_argument("--manifest", required=True)
    s.add_argument("--root", required=True)
    s.add_argument("--top")
    s.add_argument("--check", action="store_true")
    s.add_argument("--sources", nargs="*", default=["*"])
    s.add_argument("--required", nargs="*", default=[])
    s.add_argument("--optimizer-sha", default="")
    s.add_argument("--mode", default="in_sample_full")
    a = p.parse_args(argv)
    if a.program == "manifest" and not a.check and not (a.top and a.optimizer_sha):
        p.error("manifest needs --top and --optimizer-sha unless it checks")
    return a


def _grid(a: argparse.Namespace) -> config.Grid:
    return config.ranges(*((getattr(a, f"{x}_min"), getattr(a, f"{x}_max")) for x in ("gap", "signal", "momentum", "vol")))


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    grid, costs = _grid(a), _costs(a)
    own = grid.shard(a.shard, a.shards)
    m = load_market(spark, a, a.start, a.end)
    last = m.calendar.agg(F.max("session_date").cast("string")).first()[0]
    found = vector.grid_results(m, own, costs, shard=a.shard) if own else None
    span = (a.start, a.end or last)
    if found is not None:
        found = found.withColumns({"start": F.to_date(F.lit(span[0])), "end": F.to_date(F.lit(span[1]))})
    meta = shards.write_shard(found, a.results, a.shard, a.shards, grid, own.gaps if own else (), span, costs, json.loads(a.provenance), spark)
    print(json.dumps({k: meta[k] for k in ("shard", "rows", "csv_sha256")}))
    return 0


def _settings(spark: SparkSession, a: argparse.Namespace, environment: dict[str, str]) -> tuple[dict[str, config.Setting], dict[str, str]]:
    """What an audit expects, layer by layer, and the provenance that shards must share.
    The first sidecar is read only where a setting isn't told otherwise."""
    told = {k: getattr(a, k) for k in config.VARIABLES}
    first: dict = {}
    if any(v is None and not environment.get(config.VARIABLES[k]) for k, v in told.items()):
        row = shards.sidecars(spark, a.results).orderBy("file_shard").first()
        first = row.asDict() if row else {}
    found = {k: config.layered(k, int if k == "shards" else float, told[k], v, environment, first) for k, v in config.VARIABLES.items()}
    expected = json.loads(a.provenance)
    if getattr(a, "snapshot_meta", None):
        expected |= config.expected_provenance(environment, sinks.read_json(spark, a.snapshot_meta))
    return found, expected


def audit(spark: SparkSession, a: argparse.Namespace, environment: dict[str, str] | None = None) -> int:
    """The shard set first, then whether the rows are the grid, then the rows themselves;
    each only counts once those before it hold."""
    try:
        settings, provenance = _settings(spark, a, dict(os.environ) if environment is None else environment)
        costs = config.Costs(a.initial_cash, *(settings[k].value for k in ("fee_bps", "slippage_bps", "odd_lot_extra_bps")))
    except (ValueError, AnalysisException) as e:  # no file at all is an AnalysisException
        return programs.said(False, problems=[str(e)])
    problems = [(r["shard"], r["problem"]) for r in shards.audit(spark, a.results, settings["shards"].value, costs, provenance).limit(100).collect()]
    rows = sinks.read_results(spark, f"{a.results}/shard_*.csv")
    if not problems:
        problems = [(None, f"{r['problem']} {tuple(r[c] for c in COMBO)}") for r in audits.grid_coverage(rows, periods(spark, _grid(a))).limit(100).collect()]
    if not problems and a.universe:
        names = programs.candles.universe(spark, a.universe)
        problems = [(None, f"{r['check']}: {r['bad']} rows") for r in audits.integrity(rows, a.initial_cash, names).where("bad > 0").collect()]
    return programs.said(not problems, problems=problems, settings={k: [v.value, v.source] for k, v in settings.items()})


def reduce(spark: SparkSession, a: argparse.Namespace) -> int:
    if audit(spark, a):
        return 1
    costs, m = _costs(a), load_market(spark, a, a.start, a.end)
    rows = sinks.read_results(spark, f"{a.results}/shard_*.csv")
    best = topk.top_k(rows, a.top).cache()  # at most ``top`` rows
    winner = best.first()
    combo = tuple(winner[c] for c in COMBO)
    one = config.Grid(*((c,) for c in combo))
    curve = replay.curves(portfolio.history(week_arrays(m, one), costs), m.candles, m.calendar, m.weeks, costs, a.start).cache()  # a row a session
    problems = audits.integrity(rows, costs.initial_cash, m.candles.select("ticker").distinct()).where("bad > 0").collect()
    final = curve.agg(F.max_by("equity", "date")).first()[0]
    if problems or abs(final - winner["final_equity"]) > max(1e-7, 1e-10 * abs(final)):
        print(json.dumps({"status": "FAIL", "problems": [tuple(r) for r in problems] or ["the replay doesn't reach the final equity"]}))
        return 1
    annual = metrics.annual(curve, costs.initial_cash)
    risk = metrics.risk(curve, costs.initial_cash)
    sinks.write_csv(best, f"{a.output}/top.csv")
    sinks.write_csv(curve, f"{a.output}/curve.csv")
    sinks.put_text(spark, f"{a.output}/grid.md", reports.grid_report(best, rows.count(), (a.start, a.end or "open"), m.tickers, annual, risk))
    sinks.put_text(spark, f"{a.output}/annual.md", reports.annual_report(annual, metrics.complete_year_means(annual), risk.first()["total_return"]))
    last = m.calendar.agg(F.max("session_date").cast("string")).first()[0]
    ran = {"start": a.start, "end": last} | {field: getattr(costs, k) for k, field in COST_FIELDS.items()}
    told = {"schema_version": 2, "upstream_sha": json.loads(a.provenance).get("snapshot_upstream_sha", ""), "execution": ran, "best": winner.asDict()}
    sinks.write_json(spark, told, f"{a.output}/manifest.json")  # the manifest program completes it
    for held in (best, curve):
        held.unpersist()
    print(json.dumps({"status": "PASS", "best": combo, "final_equity": final}))
    return 0


PROGRAMS = {
    "run": run,
    "reduce": reduce,
    "audit": audit,
    "oos": programs.out_of_sample,
    "walk-forward": programs.walk_forward,
    "robustness": programs.robust,
    "snapshot": programs.snapshot,
    "calendar": programs.calendar,
    "manifest": programs.final_manifest,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("gridloom").getOrCreate()
    return PROGRAMS[a.program](spark, a)


if __name__ == "__main__":
    sys.exit(main())
