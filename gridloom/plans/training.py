"""Which training artefact a window is evaluated with, and whether it may be.

All of it is joins of three small tables: windows, what the artefacts' manifests tell
(``sources.artefacts.facts``), and their leading rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import Costs
from gridloom.operators.ranking import COMBO
from gridloom.operators.topk import order
from gridloom.plans.walk_forward import MOST_LAG
from gridloom.sources.artefacts import MONEY

LEAST_VERSION = 2


def _day(c: str) -> Column:
    """A date, or null for what isn't one; a time of day is left out."""
    return F.substring(c, 1, 10).try_cast("date")


def _all(*rules: Column) -> Column:
    every = F.lit(True)
    for rule in rules:
        every = every & rule
    return every


def latest_training(windows: DataFrame, trained: DataFrame, lag: int = MOST_LAG) -> DataFrame:
    """(window_id, artefact, training_end) by an as-of join: of the artefacts trained from
    the window's start on, the one that was trained longest without going beyond its end,
    and at most ``lag`` days short of it; null where there is none. Of artefacts alike the
    name that is last counts."""
    spans = trained.select("artefact", _day("training_start").alias("start"), _day("training_end").alias("end"))
    w = windows.select(F.col("id").alias("window_id"), _day("train_start").alias("start"), _day("train_end").alias("latest"))
    met = w.join(spans, (w["start"] == spans["start"]) & spans["end"].between(F.date_sub("latest", lag), F.col("latest")), "left")
    best = met.groupBy("window_id").agg(F.max(F.when(F.col("artefact").isNotNull(), F.struct("end", "artefact"))).alias("best"))
    return best.select("window_id", F.col("best.artefact").alias("artefact"), F.col("best.end").cast("string").alias("training_end"))


def leaders(chosen: DataFrame, tops: DataFrame, most: int = 1) -> DataFrame:
    """(window_id, training_rank, the parameters, final_equity): the ``most`` best rows of
    the artefact of each window. ``chosen``: (window_id, artefact)."""
    rows = chosen.select("window_id", "artefact").join(tops.select("artefact", *COMBO, "final_equity"), "artefact")
    if most == 1:  # no order of the rows is needed
        key = F.struct(F.col("final_equity").alias("e"), *((-F.col(c)).alias(c) for c in COMBO))
        best = rows.groupBy("window_id").agg(F.max_by(F.struct(*COMBO, "final_equity"), key).alias("best"))
        return best.select("window_id", F.lit(1).alias("training_rank"), *(F.col(f"best.{c}").alias(c) for c in (*COMBO, "final_equity")))
    nth = F.row_number().over(Window.partitionBy("window_id").orderBy(*order()))
    return rows.select("window_id", nth.alias("training_rank"), *COMBO, "final_equity").where(F.col("training_rank") <= most)


def gate(windows: DataFrame, told: DataFrame, hashes: DataFrame, tops: DataFrame, costs: Costs, chosen: DataFrame | None = None, most: int = 1) -> DataFrame:
    """(window_id, problem): why a window may not be evaluated with its artefact; no row
    if all may. ``told``: the manifests' facts; ``hashes``: (artefact, sha256) of the
    leading rows as they are; ``chosen``: (window_id, artefact), by default the artefact
    named like the window. A window whose training span is null asks for none.

    An absent or unreadable fact fails the rules that need it."""
    w = windows.select(F.col("id").alias("window_id"), *(F.col(c).alias(f"asked_{c}") for c in ("train_start", "train_end")), _day("train_start").alias("first"), _day("train_end").alias("last"), _day("oos_start").alias("holdout"))
    chosen = windows.select(F.col("id").alias("window_id"), F.col("id").alias("artefact")) if chosen is None else chosen.select("window_id", "artefact")
    keys = tops.groupBy("artefact", *COMBO).agg(F.count("*").alias("n"))
    whole = _all(*(F.col(c).isNotNull() for c in COMBO))
    listed = keys.groupBy("artefact").agg(F.sum("n").alias("rows"), F.count_if((F.col("n") > 1) | ~whole).alias("bad_rows"))
    met = w.join(chosen, "window_id", "left").join(told, "artefact", "left").join(hashes, "artefact", "left").join(listed, "artefact", "left")
    start, end, made_start, made_end = (_day(c) for c in ("training_start", "training_end", "selected_start", "selected_end"))
    ran_start, ran_end = _day("execution_start"), _day("execution_end")
    free = F.col("asked_train_start").isNull() & F.col("asked_train_end").isNull()
    good_hash = lambda c: F.lower(c).rlike("^[0-9a-f]{64}$")
    rules = {
        "artefact": F.col("mode").isNotNull() | F.col("training_start").isNotNull() | F.col("schema_version").isNotNull(),
        "schema": F.col("schema_version") >= LEAST_VERSION,
        "optimizer_sha": F.lower("optimizer_sha").rlike("^[0-9a-f]{40}$"),
        "upstream_sha": F.lower("upstream_sha").rlike("^[0-9a-f]{40}$"),
        "source hashes": (F.size("sources") > 0) & F.forall(F.map_values("sources"), good_hash),
        "mode": F.col("mode") == "training_only",
        "training span": start < end,
        "leak": (end < F.col("holdout")) & (free | (F.col("last") < F.col("holdout"))),
        "dates": _all(F.col("selected_start") == F.col("training_start"), F.col("selected_end") == F.col("training_end")),
        "window": free | _all(ran_start == F.col("first"), made_start == ran_start, ran_end == made_end, F.datediff("last", ran_end).between(0, MOST_LAG)),
        "top rows": good_hash(F.col("top_sha256")) & (F.lower("top_sha256") == F.lower("sha256")),
        "top table": (F.col("rows") >= most) & (F.col("bad_rows") == 0),
        "costs": _all(*(F.abs(F.col(c) - getattr(costs, c)) <= 1e-12 for c in MONEY)),
    }
    failed = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(k)) for k, rule in rules.items())), lambda x: x.isNotNull())
    # Of an artefact that isn't there nothing else can be said.
    absent = F.when(F.array_contains(failed, "artefact"), F.array(F.lit("artefact"))).otherwise(failed)
    return met.select("window_id", F.explode(absent).alias("problem"))


def order_problems(windows: DataFrame) -> DataFrame:
    """(window_id, problem) of windows that aren't in order by themselves: a date that
    isn't one, training that isn't wholly before the evaluation, an evaluation that ends
    before it starts or begins before the one ahead of it ends, and repeated names."""
    first, last, start = (_day(c) for c in ("train_start", "train_end", "oos_start"))
    open_ = F.coalesce(F.nullif("oos_end", F.lit("")), F.lit("9999-12-31"))
    rows = windows.select("id", first.alias("first"), last.alias("last"), start.alias("start"), F.substring(open_, 1, 10).try_cast("date").alias("stop"))
    line = Window.orderBy("start", "id")  # a row a window
    rows = rows.select("*", F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.count("*").over(Window.partitionBy("id")).alias("n"))
    rules = {
        "date": _all(*(F.col(c).isNotNull() for c in ("first", "last", "start", "stop"))),
        "training": (F.col("first") < F.col("last")) & (F.col("last") < F.col("start")),
        "empty": F.col("stop") >= F.col("start"),
        "overlap": F.coalesce(F.col("before") < F.col("start"), F.lit(True)),
        "repeated": F.col("n") == 1,
    }
    failed = F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(k)) for k, rule in rules.items()))
    return rows.select(F.col("id").alias("window_id"), F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("problem"))


def window_results(curves: DataFrame, initial_cash: float) -> DataFrame:
    """A row for each window of a walk-forward: first, last, the parameters, start_equity,
    end_equity, return and the largest drawdown. Each starts with what the one before left."""
    peak = F.max("equity").over(Window.partitionBy("window_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    rows = curves.withColumn("drawdown", F.when(peak > 0, F.col("equity") / peak - 1).otherwise(F.lit(0.0)))
    agg = rows.groupBy("window_id", *COMBO).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.max_by("equity", "date").alias("end_equity"), F.min("drawdown").alias("max_drawdown"))
    before = F.lag("end_equity", 1, float(initial_cash)).over(Window.orderBy("first"))  # a row a window
    agg = agg.withColumn("start_equity", before)
    return agg.select("window_id", "first", "last", *COMBO, "start_equity", "end_equity", (F.col("end_equity") / F.col("start_equity") - 1).alias("return"), "max_drawdown")
