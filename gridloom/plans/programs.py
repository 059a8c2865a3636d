"""Programs over files: out-of-sample test, walk-forward, robustness, snapshot audit,
calendar and final manifest. Each takes the parsed arguments, writes what it finds and
returns an exit status; 1 means that a gate failed, and then nothing is evaluated."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import config
from gridloom.operators import audits, metrics, robustness
from gridloom.operators.ranking import COMBO
from gridloom.plans import reports, training
from gridloom.plans import walk_forward as wf
from gridloom.plans.market import Market, market
from gridloom.sources import artefacts, candles, manifest, sinks

MOST_TOLD = 100  # problems that a program prints


def costs(a: argparse.Namespace) -> config.Costs:
    return config.Costs(a.initial_cash, a.fee_bps, a.slippage_bps, a.odd_lot_extra_bps)


def load_market(spark: SparkSession, a: argparse.Namespace, start: str, end: str | None) -> Market:
    config.check_dates(start, end or None)
    tickers = candles.universe(spark, a.universe)
    rows = candles.sequenced(candles.clean(candles.candle_files(spark, a.candles)), tickers)
    days, _ = candles.sessions(spark, rows, a.calendar)
    return market(rows, tickers.count(), days if a.calendar else None, start, end or None)


def said(status: bool, **facts: object) -> int:
    print(json.dumps({"status": "PASS" if status else "FAIL"} | facts, default=str))
    return int(not status)


def _told(problems: DataFrame) -> list[tuple]:
    return [tuple(r) for r in problems.limit(MOST_TOLD).collect()]


def _artefacts(spark: SparkSession, folders: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return artefacts.facts(artefacts.manifests(spark, folders)), artefacts.top_hashes(spark, folders), artefacts.tops(spark, folders)


def _held(spark: SparkSession, folder: str):
    """Writes curves into ``folder`` and reads them back, so that each is computed once."""
    made: list[str] = []

    def store(curve: DataFrame) -> DataFrame:
        made.append(f"{folder}/curve-{len(made)}.parquet")
        curve.write.mode("overwrite").parquet(made[-1])
        return spark.read.schema(curve.schema).parquet(made[-1])

    return store


def walk_forward(spark: SparkSession, a: argparse.Namespace) -> int:
    """Every window with the leader of its own training, capital carried."""
    windows, money = artefacts.windows(spark, a.windows), costs(a)
    known, hashes, tops = _artefacts(spark, f"{a.training}/*")
    chosen = training.latest_training(windows, known) if a.as_of else windows.select(F.col("id").alias("window_id"), F.col("id").alias("artefact"))
    problems = _told(training.order_problems(windows).unionByName(training.gate(windows, known, hashes, tops, money, chosen)))
    if problems:
        return said(False, problems=problems)
    best = windows.join(training.leaders(chosen, tops), F.col("id") == F.col("window_id")).orderBy("place").collect()  # a row a window
    if not best:
        return said(False, problems=["no window"])
    rows = [wf.WindowRow(r["id"], r["train_start"], r["train_end"], r["oos_start"], r["oos_end"] or None, tuple(r[c] for c in COMBO)) for r in sorted(best, key=lambda r: r["oos_start"])]
    curves = wf.walk_forward(lambda start, end: load_market(spark, a, start, end), rows, money, a.end or None, _held(spark, f"{a.output}/curves"))
    found = _held(spark, f"{a.output}/windows")(training.window_results(curves, money.initial_cash))
    one = curves.select("date", "equity")
    risk, annual = metrics.risk(one, money.initial_cash), metrics.annual(one, money.initial_cash)
    changes = wf.parameter_changes(found).first()
    results = [r.asDict() for r in found.orderBy("first").collect()]
    sinks.write_csv(found.orderBy("first"), f"{a.output}/windows.csv")
    sinks.write_csv(curves, f"{a.output}/curve.csv")
    payload = {"status": "PASS", "initial_cash": money.initial_cash, "final_equity": results[-1]["end_equity"], "parameter_changes": changes["changes"]}
    payload |= {"risk": risk.first().asDict(), "annual": [r.asDict() for r in annual.orderBy("year").collect()], "windows": results}
    sinks.write_json(spark, payload, f"{a.output}/walk_forward.json")
    sinks.put_text(spark, f"{a.output}/walk_forward.md", reports.walk_forward_report(found, risk, changes["changes"]))
    return said(True, windows=len(results), final_equity=payload["final_equity"], parameter_changes=changes["changes"])


def out_of_sample(spark: SparkSession, a: argparse.Namespace) -> int:
    """The best rows of one training artefact on a later span."""
    if a.top < 1:
        raise ValueError("--top must be 1 at least")
    money, name = costs(a), a.training.rstrip("/").rsplit("/", 1)[-1]
    window = spark.createDataFrame([(name, None, None, a.start, a.end)], "id string, train_start string, train_end string, oos_start string, oos_end string")
    known, hashes, tops = _artefacts(spark, a.training.rstrip("/"))
    problems = _told(training.gate(window, known, hashes, tops, money, most=a.top))
    if problems:
        return said(False, problems=problems)
    best = training.leaders(window.select(F.col("id").alias("window_id"), F.col("id").alias("artefact")), tops, a.top).cache()  # --top rows
    m = load_market(spark, a, a.start, a.end or None)
    curves = _held(spark, f"{a.output}/curves")(wf.evaluate(m, [tuple(r[c] for c in COMBO) for r in best.collect()], money))
    rank = F.broadcast(best.select("training_rank", *COMBO))
    found = metrics.risk(curves, money.initial_cash, [*COMBO]).join(rank, [*COMBO])
    last = curves.groupBy(*COMBO).agg(F.max_by("equity", "date").alias("final_equity"), F.max("date").alias("last"))
    found = found.join(last, [*COMBO]).orderBy("training_rank")
    results = [r.asDict() for r in found.collect()]
    best.unpersist()
    span = known.select("training_start", "training_end").first()
    ends = (a.start, str(max(r["last"] for r in results)))
    sinks.write_csv(found.drop("last"), f"{a.output}/oos.csv")
    sinks.write_csv(curves.join(rank, [*COMBO]), f"{a.output}/oos_curve.csv")
    payload = {"status": "PASS", "training_start": span["training_start"], "training_end": span["training_end"], "oos_start": ends[0], "oos_end": ends[1], "results": results}
    sinks.write_json(spark, payload, f"{a.output}/oos.json")
    sinks.put_text(spark, f"{a.output}/oos.md", reports.oos_report(found, (span["training_start"], span["training_end"]), ends))
    return said(True, results=[(r["training_rank"], r["final_equity"]) for r in results])


def robust(spark: SparkSession, a: argparse.Namespace) -> int:
    """How the results of a grid lie around its winner. Not a proof: it looks at the
    span that the winner was chosen on."""
    if a.radius < 0:
        raise ValueError("--radius must be 0 at least")
    rows = sinks.read_results(spark, a.results).where(f"vol_period = {a.vol}") if a.vol else sinks.read_results(spark, a.results)
    good = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(~good("final_equity") | ~good("total_return")).alias("not finite"), F.count_if(F.greatest(*(F.col(c).isNull() for c in COMBO))).alias("no period")).first()
    problems = [k for k in ("not finite", "no period") if counts[k]] + ["empty"] * (counts["rows"] == 0)
    problems += [f"repeated {tuple(r)[:4]}" for r in audits.duplicate_keys(rows, [*COMBO]).limit(3).collect()]
    if problems:
        return said(False, problems=problems)
    q, near, axis, often = robustness.quantiles(rows), robustness.neighbourhood(rows, a.radius), robustness.axis_neighbours(rows), robustness.concentration(rows)
    found = {"rows": counts["rows"], "radius": a.radius}
    found |= {"quantiles": {str(r["point"]): r["total_return"] for r in q.collect()}, "neighbourhood": near.first().asDict()}
    found |= {"one_step": [r.asDict() for r in axis.collect()], "concentration": [r.asDict() for r in often.collect()], "verdict": "not established by an analysis in sample"}
    sinks.write_json(spark, found, f"{a.output}/robustness.json")
    sinks.put_text(spark, f"{a.output}/robustness.md", reports.robustness_report(q, near, axis, often))
    return said(True, rows=counts["rows"], neighbours=found["neighbourhood"]["count"])


def snapshot(spark: SparkSession, a: argparse.Namespace) -> int:
    """The rules a snapshot of candle files must keep, all told at once."""
    days, made = (candles.ensure_calendar(spark, a.calendar, a.archives, a.requested_end) if a.archives else (candles.calendar_file(spark, f"{a.calendar}/sessions.csv"), False))
    names = candles.universe(spark, a.universe).select("ticker")
    events = candles.override_file(spark, a.overrides)
    limits = audits.SnapshotLimits(tickers=a.tickers, least_rows=a.least_rows)
    found = audits.snapshot_rules(candles.candle_files(spark, a.candles), days, names, events, a.start, a.requested_end, limits, tuple(a.must), tuple(a.must_not))
    rows = [r.asDict() for r in found.orderBy("severity", "ticker", "rule").collect()]  # some rules for each ticker of a universe
    blocking = [r for r in rows if r["severity"] == audits.BLOCKING]
    universe_sha = sinks.file_hashes(spark, a.universe).first()["sha256"]
    payload = {"status": "FAIL" if blocking else "PASS", "upstream_sha": a.upstream_sha, "requested_end": a.requested_end, "universe_sha256": universe_sha, "calendar_materialised": made, "findings": rows}
    payload["candle_sha256"] = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in sinks.file_hashes(spark, a.candles).collect()}
    sinks.write_json(spark, payload, f"{a.output}/snapshot.json")
    return said(not blocking, blocking=[(r["ticker"], r["rule"]) for r in blocking[:MOST_TOLD]], diagnostic=len(rows) - len(blocking))


def calendar(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        days, made = candles.ensure_calendar(spark, a.calendar, a.archives, a.requested_end)
    except ValueError as e:
        return said(False, problems=[str(e)])
    return said(True, sessions=days.count(), made=made)


def final_manifest(spark: SparkSession, a: argparse.Namespace) -> int:
    """Complete a manifest, or check files against one that is complete."""
    if a.check:
        problems = _told(manifest.verify(spark, a.manifest, a.root, a.top))
        return said(not problems, problems=problems)
    try:
        found = manifest.finalise(spark, a.manifest, a.root, a.sources, a.required, a.top, a.optimizer_sha, a.mode)
    except ValueError as e:
        return said(False, problems=[str(e)])
    return said(True, files=found["source_identity"]["tracked_file_count"], tree_sha256=found["source_identity"]["tree_sha256"])
