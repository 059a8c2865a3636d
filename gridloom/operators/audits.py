"""Audits: each is a query that returns its evidence. ``require`` makes one fail closed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.money import close_to
from gridloom.operators.ranking import COMBO
from gridloom.operators.replay import filled_closes
from gridloom.sources.candles import calendar_gate  # noqa: F401  (kept under its earlier name)


class AuditError(RuntimeError):
    """An audit found what it must not find."""


def require(name: str, evidence: DataFrame, empty: bool = True) -> None:
    """Fail unless ``evidence`` has no row (or, with empty=False, has one)."""
    found = evidence.limit(3).collect()
    if bool(found) == empty:
        raise AuditError(f"{name}: {found or 'nothing found'}")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def grid_coverage(results: DataFrame, grid: DataFrame) -> DataFrame:
    """Combinations that are missing, extra or repeated; none in a complete table.
    ``grid``: the parameter product."""
    count = results.groupBy(*COMBO).agg(F.count("*").alias("rows"))
    problem = F.when(F.col("rows").isNull(), "missing").when(~F.col("expected"), "extra").when(F.col("rows") > 1, "repeated")
    met = count.join(grid.select(*COMBO).withColumn("expected", F.lit(True)), COMBO, "full_outer").withColumn("expected", F.coalesce("expected", F.lit(False)))
    return met.select(*COMBO, "rows", problem.alias("problem")).where("problem is not null")


def integer_valued(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bad): values that aren't finite whole numbers."""
    bad = [F.count_if(F.coalesce(F.col(c).cast("double") != F.rint(F.col(c).cast("double")), F.lit(True)) | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns]
    agg = rows.agg(*bad)
    return agg.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in columns))).alias("x")).select("x.*")


def within(rows: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows with a period out of its range."""
    inside: Column = F.lit(True)
    for c, (low, high) in bounds.items():
        inside = inside & F.col(c).between(low, high)
    return rows.where(~F.coalesce(inside, F.lit(False)))


def integrity(results: DataFrame, initial_cash: float, universe: DataFrame) -> DataFrame:
    """(check, bad): rows that break a rule of the result table, from one pass."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    whole = lambda c: finite(F.col(c).cast("double")) & (F.col(c).cast("double") == F.rint(F.col(c).cast("double")))
    known = F.broadcast(universe.select(F.col("ticker").alias("final_holding"), F.lit(True).alias("known")))
    expected = F.col("final_equity") / initial_cash - 1
    rules = {
        "final_equity": finite("final_equity") & (F.col("final_equity") >= 0),
        "total_return": finite("total_return") & close_to(F.col("total_return"), expected, 1e-10, 1e-10),
        "fees_paid": finite("fees_paid") & (F.col("fees_paid") >= 0),
        "slippage_impact": finite("slippage_impact") & (F.col("slippage_impact") >= 0),
        "trades": whole("trades") & (F.col("trades") >= 0),
        "skipped_executions": whole("skipped_executions") & (F.col("skipped_executions") >= 0),
        "periods": whole(COMBO[0]) & whole(COMBO[1]) & whole(COMBO[2]) & whole(COMBO[3]),
        "final_holding": (F.col("final_holding") == "CASH") | F.col("known").isNotNull(),
        "dates": F.col("start") <= F.col("end"),
    }
    bad = results.join(known, "final_holding", "left").agg(*(F.count_if(~F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()))
    return bad.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("bad")) for k in rules))).alias("x")).select("x.*")


def shard_summary(results: DataFrame) -> DataFrame:
    """Per shard its rows, ranges and gaps."""
    return results.groupBy("shard").agg(
        F.count("*").alias("rows"),
        *(f(c).alias(f"{n}_{c}") for c in COMBO for n, f in (("min", F.min), ("max", F.max))),
        F.array_sort(F.collect_set("gap_period")).alias("gaps"),
    )


def shard_contract(metadata: DataFrame, contract: list[str], shards: int, gaps: DataFrame | None = None) -> DataFrame:
    """Problems of a set of shard metadata (shard, gap_values and the contract's columns):
    missing, repeated or unknown shards, a contract that differs, and a gap with several
    owners or, of the expected ``gaps`` (gap_period), with none; an owned gap that isn't
    expected is unknown."""
    ids = metadata.groupBy("shard").agg(F.count("*").alias("n"))
    wanted = metadata.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(True).alias("wanted"))
    odd = ids.join(wanted, "shard", "full_outer").where((F.coalesce("n", F.lit(0)) != 1) | F.col("wanted").isNull())
    odd = odd.select(F.lit("shard").alias("problem"), F.col("shard").cast("string").alias("what"))
    differs = metadata.agg(F.count_distinct(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in contract))).alias("n")).where("n > 1")
    differs = differs.select(F.lit("contract").alias("problem"), F.col("n").cast("string").alias("what"))
    owners = metadata.select(F.explode("gap_values").alias("gap_period")).groupBy("gap_period").agg(F.count("*").alias("n"))
    problem = F.when(F.col("n") > 1, "gap owned twice")
    if gaps is not None:
        owners = owners.join(gaps.select("gap_period").distinct().withColumn("expected", F.lit(True)), "gap_period", "full_outer")
        problem = F.when(F.col("n").isNull(), "gap without owner").when(F.col("expected").isNull(), "unknown gap").when(F.col("n") > 1, "gap owned twice")
    owners = owners.select(problem.alias("problem"), F.col("gap_period").cast("string").alias("what")).where("problem is not null")
    return odd.union(differs).union(owners)


def row_counts(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """Shards whose rows aren't those their metadata tell (tested_rows)."""
    count = results.groupBy("shard").agg(F.count("*").alias("rows"))
    return count.join(metadata.select("shard", "tested_rows"), "shard", "full_outer").where(~F.col("rows").eqNullSafe(F.col("tested_rows")))


def warmup(candles: DataFrame, start: str, required: int, archive_start_year: int) -> DataFrame:
    """Candles before the start per ticker. A short history is accepted if it began
    after the archive's first year."""
    day = F.to_date(F.lit(start))
    agg = candles.groupBy("ticker").agg(F.count_if(F.col("date") < day).alias("sessions_before"), F.min("date").alias("first_date"))
    enough = F.col("sessions_before") >= required
    young = ~enough & (F.year("first_date") > archive_start_year)
    return agg.select("ticker", "sessions_before", "first_date", enough.alias("enough"), young.alias("young"), (enough | young).alias("ok"))


def coverage(candles: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Per ticker the share of sessions it traded on, and the days since its last."""
    low, high = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    sessions = calendar.where(F.col("session_date").between(low, high))
    total = sessions.agg(F.count("*").alias("total"), F.max("session_date").alias("last"))
    met = candles.join(F.broadcast(sessions.select(F.col("session_date").alias("date"))), "date", "left_semi")
    own = candles.groupBy("ticker").agg(F.max("date").alias("end_date"))
    agg = own.join(met.groupBy("ticker").agg(F.count("*").alias("met")), "ticker", "left").crossJoin(F.broadcast(total))
    met = F.coalesce("met", F.lit(0))
    return agg.select("ticker", met.alias("sessions"), (met / F.col("total")).alias("ratio"), F.datediff("last", "end_date").alias("stale_days"))


def snapshot(candles: DataFrame, calendar: DataFrame, start: str, end: str, least_rows: int = 300, least_ratio: float = 0.95, most_stale: int = 10) -> DataFrame:
    """Tickers that a snapshot can't be used with, and why."""
    rows = candles.groupBy("ticker").agg(F.count("*").alias("rows"))
    met = coverage(candles, calendar, start, end).join(rows, "ticker")
    why = F.filter(F.array(F.when(F.col("rows") < least_rows, F.lit("history")), F.when(F.col("ratio") < least_ratio, F.lit("coverage")), F.when(F.col("stale_days") > most_stale, F.lit("stale"))), lambda x: x.isNotNull())
    return met.select("ticker", F.explode(why).alias("problem"))


@dataclass(frozen=True)
class SnapshotLimits:
    """Bounds of a usable snapshot: tickers, rows a ticker, share of sessions, days that a
    ticker, the calendar or the newest candle may lag, and what counts as an extreme move."""

    tickers: int = 40
    least_rows: int = 300
    least_ratio: float = 0.95
    most_stale: int = 10
    most_lag: int = 4
    extreme: float = 3.0
    near_days: int = 5


BLOCKING, DIAGNOSTIC = "blocking", "diagnostic"


def snapshot_rules(raw: DataFrame, calendar: DataFrame, universe: DataFrame, events: DataFrame, start: str, requested_end: str, limits: SnapshotLimits | None = None, must: tuple[str, ...] = (), must_not: tuple[str, ...] = ()) -> DataFrame:
    """(ticker, rule, severity, evidence): all that is wrong with a snapshot as its files
    are. ``raw``: (ticker, row, date, open, close) of the candle files, nothing cleaned;
    ``universe``: (ticker), repeated where the list repeats it; ``events``: the
    corporate-action overrides. A null ticker stands for the set. Moves are diagnostic,
    all else blocks.

    The candles are passed once: one window by ticker in file order and one aggregation."""
    limits, number = limits or SnapshotLimits(), lambda c: F.col(c).try_cast("double")
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(requested_end))
    good = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False)) & ~F.isnan(c)
    line = Window.partitionBy("ticker").orderBy("row")
    rows = raw.select(F.upper("ticker").alias("ticker"), "row", F.substring("date", 1, 10).try_cast("date").alias("day"), number("open").alias("open"), number("close").alias("close"))
    rows = rows.select("*", F.lag("day").over(line).alias("before"), (F.col("close") / F.nullif(F.lag("close").over(line), F.lit(0.0))).alias("ratio"))
    span = F.broadcast(calendar.agg(F.max(F.when(F.col("session_date").between(first, last), F.col("session_date"))).alias("official_end"), F.count_if(F.col("session_date").between(first, last)).alias("sessions")))
    known = F.broadcast(calendar.select(F.col("session_date").alias("day"), F.lit(True).alias("session")))
    near = F.broadcast(events.groupBy(F.upper("ticker").alias("ticker")).agg(F.collect_list(F.col("ex_date").try_cast("date")).alias("ex_dates")))
    rows = rows.join(known, "day", "left").join(near, "ticker", "left").crossJoin(span)
    moved = F.coalesce((F.col("ratio") > limits.extreme) | (F.col("ratio") < 1 / limits.extreme), F.lit(False))
    explained = F.coalesce(F.exists("ex_dates", lambda d: F.abs(F.datediff(d, F.col("day"))) <= limits.near_days), F.lit(False))
    own = rows.groupBy("ticker").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("day").isNull()).alias("bad_dates"),
        F.count_if(F.col("before") >= F.col("day")).alias("disorder"),
        F.count_if(~good("open") | ~good("close")).alias("bad_prices"),
        F.count_if(F.col("day").isNotNull() & F.col("session").isNull()).alias("outside"),
        F.max("day").alias("end"),
        F.count_distinct(F.when(F.col("session") & F.col("day").between(first, F.col("official_end")), F.col("day"))).alias("met"),
        F.count_if(moved).alias("moves"),
        F.count_if(moved & ~explained).alias("unexplained"),
    )
    listed = universe.groupBy(F.upper("ticker").alias("ticker")).agg(F.count("*").alias("times"))
    both = listed.join(own, "ticker", "left").crossJoin(span)
    ratio, stale = F.coalesce("met", F.lit(0)) / F.col("sessions"), F.datediff("official_end", "end")
    there = F.col("rows").isNotNull()
    problem = lambda rule, bad, evidence, severity=BLOCKING: F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), evidence.cast("string").alias("evidence")))
    some = lambda rule, c, severity=BLOCKING: problem(rule, F.coalesce(F.col(c), F.lit(0)) > 0, F.col(c), severity)
    rules = [
        problem("repeated in the universe", F.col("times") > 1, F.col("times")),
        problem("no candles", ~there, F.lit(None)),
        some("dates", "bad_dates"),
        some("order", "disorder"),
        some("prices", "bad_prices"),
        some("outside the calendar", "outside"),
        problem("history", there & (F.col("rows") < limits.least_rows), F.col("rows")),
        problem("coverage", there & (ratio < limits.least_ratio), F.col("met")),
        problem("stale", there & (stale > limits.most_stale), stale),
        some("extreme moves", "moves", DIAGNOSTIC),
        some("moves without an override", "unexplained", DIAGNOSTIC),
    ]
    per_ticker = both.select("ticker", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("p")).select("ticker", "p.*")
    names = listed.agg(F.count("*").alias("n"), F.sum("times").alias("times"), F.collect_list(F.when(F.col("ticker").isin(*must, *must_not), F.col("ticker"))).alias("named"))
    newest = own.join(listed, "ticker", "left_semi").agg(F.max("end").alias("newest"))
    whole = names.crossJoin(newest).crossJoin(span)
    missed = F.size(F.filter("named", lambda x: x.isin(*must))) != len(must)
    lag, behind = F.datediff(last, "official_end"), F.datediff("official_end", "newest")
    set_rules = [
        problem("universe", (F.col("n") != limits.tickers) | (F.col("times") != F.col("n")), F.col("times")),
        problem("universe members", missed | F.exists("named", lambda x: x.isin(*must_not)), F.array_join(F.array_sort("named"), ",")),
        problem("calendar", F.col("sessions") == 0, F.col("sessions")),
        problem("calendar lag", F.coalesce(lag > limits.most_lag, F.lit(False)), lag),
        problem("candle lag", F.coalesce(behind > limits.most_lag, F.lit(False)), behind),
    ]
    of_set = whole.select(F.lit(None).cast("string").alias("ticker"), F.explode(F.filter(F.array(*set_rules), lambda x: x.isNotNull())).alias("p")).select("ticker", "p.*")
    wrong = overrides(events, universe.select("ticker").distinct())
    of_events = wrong.select(F.upper("ticker").alias("ticker"), F.concat(F.lit("override: "), "problem").alias("rule"), F.lit(BLOCKING).alias("severity"), F.col("ex_date").alias("evidence"))
    return per_ticker.unionByName(of_set).unionByName(of_events)


def extreme_moves(candles: DataFrame, overrides: DataFrame, ratio: float = 3.0, days: int = 5) -> DataFrame:
    """Closes that moved by more than ``ratio`` either way, and whether an override of
    the ticker lies within so many days. Overrides are a short hand-kept list."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    moved = candles.select("ticker", "date", (F.col("close") / before).alias("close_ratio")).where((F.col("close_ratio") > ratio) | (F.col("close_ratio") < 1 / ratio))
    near = F.broadcast(overrides.select(F.col("ticker").alias("t"), F.to_date("ex_date").alias("ex_date")))
    hit = moved.join(near, (F.col("ticker") == F.col("t")) & (F.abs(F.datediff("ex_date", "date")) <= days), "left_semi").select("ticker", "date", F.lit(True).alias("near_override"))
    return moved.join(hit, ["ticker", "date"], "left").withColumn("near_override", F.coalesce("near_override", F.lit(False)))


def overrides(events: DataFrame, universe: DataFrame) -> DataFrame:
    """Corporate-action events that break a rule, and which."""
    ratio, day, before = F.expr("try_cast(split_ratio AS double)"), F.expr("try_cast(ex_date AS date)"), F.expr("try_cast(last_date_prior AS date)")
    known = F.broadcast(universe.select(F.upper("ticker").alias("known")))
    rows = events.withColumn("key", F.upper("ticker")).join(known, F.col("key") == F.col("known"), "left")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("key", "ex_date")))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = {
        "missing field": F.greatest(*(F.col(c).isNull() for c in ("ticker", "ex_date", "last_date_prior", "split_ratio", "event", "source_authority", "source_url"))),
        "repeated": F.col("n") > 1,
        "not in universe": F.col("known").isNull(),
        "ratio": no((ratio > 0) & (ratio != 1) & (ratio < float("inf"))),
        "dates": no(before < day),
        "authority": no(F.trim("source_authority") != ""),
        "source": no(F.startswith("source_url", F.lit("https://"))),
    }
    why = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return rows.select("ticker", "ex_date", F.explode(why).alias("problem"))


def stale_prices(curve: DataFrame, candles: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per invested day of a curve the sessions since its holding last traded: an as-of
    join, made of carried-forward dates."""
    number = F.broadcast(calendar.select(F.col("session_date").alias("date"), (F.row_number().over(Window.orderBy("session_date")) - 1).alias("session_idx")))
    last = filled_closes(candles, calendar).select("date", F.col("ticker").alias("holding"), "traded")
    rows = curve.where("holding <> 'CASH'").join(last, ["date", "holding"], "left").join(number, "date")
    traded = number.select(F.col("date").alias("traded"), F.col("session_idx").alias("traded_idx"))
    rows = rows.join(F.broadcast(traded), "traded", "left")
    return rows.select("date", "holding", F.col("traded").alias("last_trade_date"), (F.col("session_idx") - F.col("traded_idx")).alias("stale_sessions"))


def stale_summary(stale: DataFrame, curve: DataFrame, warn: int = 3) -> DataFrame:
    """Greatest age while invested, number of warnings and the terminal position's age
    (0 in cash)."""
    s = F.col("stale_sessions")
    agg = stale.agg(F.coalesce(F.max(s), F.lit(0)).alias("max_stale"), F.count_if(s.isNull() | (s > warn)).alias("warnings"), F.max_by(s, "date").alias("latest"))
    end = curve.agg(F.max_by("holding", "date").alias("terminal_holding"))
    return agg.crossJoin(end).select("max_stale", "warnings", "terminal_holding", F.when(F.col("terminal_holding") == "CASH", 0).otherwise(F.col("latest")).alias("terminal_stale"))


#: What the metadata of an external curve must declare.
GOLDEN_SOURCE = "TradingView Pine external export"
GOLDEN_FIELDS = ("pine_script_sha256", "exported_at", "start", "end", "gap_period", "signal_period", "momentum_period", "vol_period")


def golden_gate(meta: dict, sha256: str) -> list[str]:
    """Why an external curve may not be used: its declared source, its file's hash, or
    metadata that are missing."""
    found = ["source"] if meta.get("source") != GOLDEN_SOURCE else []
    found += ["fixture_sha256"] if not sha256 or str(meta.get("fixture_sha256") or "") != sha256 else []
    return found + [f"{k} is missing" for k in GOLDEN_FIELDS if k not in meta]


def _differences(pairs: dict[str, tuple[Column, Column, Column]]) -> list[Column]:
    """A struct (column, expected, found) for each (same, expected, found) that isn't the same."""
    as_struct = lambda c, a, b: F.struct(F.lit(c).alias("column"), a.cast("string").alias("expected"), b.cast("string").alias("found"))
    return [F.when(~F.coalesce(same, F.lit(False)), as_struct(c, a, b)) for c, (same, a, b) in pairs.items()]


def golden(golden_rows: DataFrame, curve: DataFrame) -> DataFrame:
    """Differences of a curve from an external one: (date, column, expected, found).
    Money is equal within a relative 1e-10 or an absolute 1e-7. A date that is repeated
    or unmatched is a difference."""
    twice = golden_rows.groupBy("date").agg(F.count("*").alias("n"))
    met = golden_rows.alias("g").join(curve.alias("c"), "date", "left").join(twice, "date")
    pairs = {}
    for c in ("holding", "shares", "cash", "equity", "weekly_target"):
        a, b = F.col(f"g.{c}"), F.col(f"c.{c}")
        pairs[c] = (close_to(a, b) if c in ("cash", "equity") else a == b, a, b)
    pairs["date"] = (F.col("n") == 1, F.lit("once"), F.col("n"))
    return met.select("date", F.explode(F.filter(F.array(*_differences(pairs)), lambda x: x.isNotNull())).alias("d")).select("date", "d.*")


def golden_indicators(golden_rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Differences of the indicators at decisions from external ones: (decision_date,
    ticker, column, expected, found). Both tables have decision_date, ticker, gap_state,
    momentum, vol_valid and selected_top1; of external rows repeated for a decision and
    ticker one counts, and one that is unknown here differs in its ``context``. A null
    momentum equals a null or NaN one."""
    own = decisions.withColumn("known", F.lit(True)).alias("c")
    rows = golden_rows.withColumn("ticker", F.upper("ticker")).dropDuplicates(["decision_date", "ticker"]).alias("g")
    met = rows.join(own, ["decision_date", "ticker"], "left")
    a, b = (F.when(~F.isnan(f"{x}.momentum"), F.col(f"{x}.momentum")) for x in ("g", "c"))
    same = close_to(a, b, abs_=1e-10) | (a.isNull() & b.isNull())
    pairs = {c: (F.col(f"g.{c}") == F.col(f"c.{c}"), F.col(f"g.{c}"), F.col(f"c.{c}")) for c in ("gap_state", "vol_valid", "selected_top1")}
    found = _differences(pairs | {"momentum": (same, a, b)})
    unknown = F.struct(F.lit("context").alias("column"), F.lit("known").alias("expected"), F.lit(None).cast("string").alias("found"))
    every = F.when(F.col("known").isNull(), F.array(unknown)).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return met.select("decision_date", "ticker", F.explode(every).alias("d")).select("decision_date", "ticker", "d.*")
