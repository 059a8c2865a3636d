"""Out-of-sample evaluation and walk-forward with carried capital."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import Costs, Grid
from gridloom.operators import portfolio, replay
from gridloom.operators.ranking import COMBO
from gridloom.plans.market import Market, week_arrays
from gridloom.sources.scratch import fresh

SHA = re.compile(r"[0-9a-f]{40}")
SHA256 = re.compile(r"[0-9a-f]{64}")
MOST_LAG = 7  # days between the requested and the last traded training day


@dataclass(frozen=True)
class WindowRow:
    id: str
    train_start: str
    train_end: str
    oos_start: str
    oos_end: str | None
    combo: tuple[int, int, int, int] | None = None


def check_windows(windows: list[WindowRow]) -> None:
    """Each window trains before it is evaluated, and evaluations don't overlap."""
    before: str | None = None
    for w in windows:
        if not w.train_start < w.train_end < w.oos_start:
            raise ValueError(f"{w.id}: training isn't wholly before the evaluation")
        if w.oos_end and w.oos_end < w.oos_start:
            raise ValueError(f"{w.id}: the evaluation ends before it starts")
        if before is not None and w.oos_start <= before:
            raise ValueError(f"{w.id}: evaluations overlap")
        before = w.oos_end or "9999-12-31"


def overlaps(windows: DataFrame) -> DataFrame:
    """Windows whose evaluation begins before the one ahead of them ends."""
    order = Window.orderBy("oos_start")
    rows = windows.withColumn("before", F.lag(F.coalesce(F.nullif("oos_end", F.lit("")), F.lit("9999-12-31"))).over(order))
    return rows.where(F.col("before") >= F.col("oos_start")).drop("before")


#: The names under which a published manifest has the costs of a run.
COST_FIELDS = {"initial_cash": "initial_cash", "fee_bps": "fee_bps_per_side", "slippage_bps": "slippage_bps_per_side", "odd_lot_extra_bps": "odd_lot_extra_bps_weighted"}


def _day(value: object) -> date | None:
    try:
        return date.fromisoformat(str(value)[:10])
    except ValueError:
        return None


def _same_number(a: object, b: float) -> bool:
    try:
        return math.isclose(float(a), b, rel_tol=0.0, abs_tol=1e-12)
    except (TypeError, ValueError):
        return False


def verify_training(manifest: dict, window: WindowRow, costs: Costs, top_sha256: str) -> None:
    """Fail unless a training artefact may be used for a window: provenance is complete,
    it was selected on training data only, covers the window's training span (the last
    traded day may be some days before its end) and had the same costs."""
    made, run = manifest.get("selection_provenance") or {}, manifest.get("execution") or {}
    span = manifest.get("training") or {}
    start, end = (str(span.get(k) or run.get(k) or "") for k in ("start", "end"))
    sources = manifest.get("optimizer_source_sha256")
    low = lambda x: str(x or "").lower()
    first, last = _day(start), _day(end)
    version = manifest.get("schema_version", 0)
    problems = {
        "schema": not (isinstance(version, int) and version >= 2),
        "optimizer_sha": not SHA.fullmatch(low(manifest.get("optimizer_sha"))),
        "upstream_sha": not SHA.fullmatch(low(manifest.get("upstream_sha"))),
        "source hashes": not isinstance(sources, dict) or not sources or not all(SHA256.fullmatch(low(x)) for x in sources.values()),
        "mode": made.get("mode") != "training_only",
        "training span": first is None or last is None or first >= last,
        "leak": last is None or last >= date.fromisoformat(window.oos_start),
        "dates": str(made.get("training_start") or "") != start or str(made.get("training_end") or "") != end,
        "window": start != window.train_start or last is None or not 0 <= (date.fromisoformat(window.train_end) - last).days <= MOST_LAG,
        "top rows": not SHA256.fullmatch(low(made.get("top_100_sha256"))) or low(made.get("top_100_sha256")) != top_sha256.lower(),
        "costs": not all(_same_number(run.get(field), getattr(costs, k)) for k, field in COST_FIELDS.items()),
    }
    if found := [k for k, bad in problems.items() if bad]:
        raise ValueError(f"{window.id}: {', '.join(found)}")


def evaluate(m: Market, combos: list[tuple[int, int, int, int]], costs: Costs) -> DataFrame:
    """Daily curves of chosen combinations, all in one job."""
    axes = [tuple(sorted({c[i] for c in combos})) for i in range(4)]
    own = m.candles.sparkSession.createDataFrame(combos, ", ".join(f"{c} int" for c in COMBO))
    arrays = week_arrays(m, Grid(*axes)).join(F.broadcast(own), COMBO, "left_semi")
    return replay.curves(portfolio.history(arrays, costs), m.candles, m.calendar, m.weeks, costs, m.start)


def _stored(curve: DataFrame) -> DataFrame:
    path = fresh(curve.sparkSession, "curve")
    curve.write.parquet(path)
    return curve.sparkSession.read.schema(curve.schema).parquet(path)


def walk_forward(load: Callable[[str, str | None], Market], windows: list[WindowRow], costs: Costs, data_end: str | None = None, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Curves of the windows one after the other: each starts with the capital, not the
    position, that the one before ended with. ``load`` gives the market of a span; its
    candles go further back, so indicators are warm. Windows that start after
    ``data_end`` or without a week to trade are passed over, later ends are cut to it; it
    fails if no window is left or two curves share a date. The loop is over windows (a
    handful). ``store`` writes a curve and reads it back, so that it is computed once;
    without it curves are written to the folder that all executors share."""
    check_windows(windows)
    capital, out = costs.initial_cash, None
    for w in windows:
        if data_end and w.oos_start > data_end:
            continue
        end = min(w.oos_end or data_end, data_end) if data_end else w.oos_end
        m = load(w.oos_start, end)
        if m.weeks.limit(1).count() == 0:
            continue
        curve = evaluate(m, [w.combo], replace(costs, initial_cash=capital)).withColumn("window_id", F.lit(w.id))
        curve = store(curve) if store else _stored(curve)
        capital = float(curve.agg(F.max_by("equity", "date")).first()[0])
        out = curve if out is None else out.unionByName(curve)
    if out is None:
        raise ValueError("no window lies within the data")
    twice = out.groupBy("date").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"evaluations share dates: {[str(r['date']) for r in twice]}")
    return out


def parameter_changes(windows: DataFrame) -> DataFrame:
    """How often (gap, signal, momentum), and with it vol, changed from window to window."""
    order = Window.orderBy("window_id")
    moved = windows.select(
        F.greatest(*(F.coalesce((F.col(c) != F.lag(c).over(order)).cast("int"), F.lit(0)) for c in COMBO[:3])).alias("three"),
        F.greatest(*(F.coalesce((F.col(c) != F.lag(c).over(order)).cast("int"), F.lit(0)) for c in COMBO)).alias("four"),
    )
    return moved.agg(F.sum("three").alias("changes"), F.sum("four").alias("changes_with_vol"))
