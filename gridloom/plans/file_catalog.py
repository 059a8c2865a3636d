"""Named queries that go through files, artefacts and manifests: what the demonstration
market or the order table gives is written to shared storage by the sinks and read again
by the sources. Each has its DuckDB twin."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import Grid
from gridloom.functions.money import affordable_by_scan
from gridloom.operators import audits, indicators, metrics
from gridloom.operators.ranking import COMBO
from gridloom.plans import catalog as c
from gridloom.plans import grid as vector
from gridloom.plans import oracle as o
from gridloom.plans import reports, training
from gridloom.plans.market import market, periods
from gridloom.sources import artefacts, candles, manifest, shards, sinks
from gridloom.sources.scratch import fresh

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _queries[f.__name__], _sql[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


# Candle files, archives and caches.


@_query(o.query("SELECT ticker_idx, ticker, date, seq, open, close FROM c"))
def candle_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candle table through a universe file and a CSV file a ticker."""
    folder = fresh(spark, "candles")
    rows = c._candles(spark, sf_dir)
    dealt = rows.withColumn("file", F.concat("ticker", F.lit("_1d.csv"))).repartition(c.TICKERS, "ticker_idx").sortWithinPartitions("ticker_idx", "date")
    dealt.select("file", F.concat(F.col("date").cast("string"), F.lit(" 00:00:00")).alias("date"), "open", "close").write.partitionBy("file").option("header", True).csv(f"{folder}/data")
    names = [r["ticker"] for r in rows.select("ticker_idx", "ticker").distinct().orderBy("ticker_idx").collect()]
    sinks.write_json(spark, {"tickers": [n.lower() for n in names]}, f"{folder}/universe.json")
    raw = candles.candle_files(spark, f"{folder}/data/*")
    return candles.sequenced(candles.clean(raw), candles.universe(spark, f"{folder}/universe.json"))


def _archives(orders: DataFrame, folder: str) -> None:
    """An archive a year with a line an order day, and lines of other markets, as the
    exchange writes them. Tasks make the archives; there is one a year to be stored."""

    def zipped(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lines = ["00".ljust(candles.LINE), *("01" + d.ljust(8) + b + "TICK".ljust(12) + m for d, b, m in zip(rows["day"], rows["bdi"], rows["market"], strict=True)), "99".ljust(candles.LINE)]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"PRICES_{key[0]}.TXT", "\r\n".join(x.ljust(candles.LINE) for x in lines))
        return pd.DataFrame({"year": [key[0]], "content": [out.getvalue()]})

    day = F.to_date("o_orderdate")
    # A fifth of the days has orders of another market only, which make no session.
    other = F.dayofyear(day) % 5 == 0
    lines = orders.select(F.year(day).alias("year"), F.date_format(day, "yyyyMMdd").alias("day"), F.when(other, "58").otherwise("02").alias("bdi"), F.lit("010").alias("market")).distinct()
    for r in lines.groupBy("year").applyInPandas(zipped, "year int, content binary").collect():
        sinks.put_bytes(orders.sparkSession, f"{folder}/A{r['year']}.ZIP", bytes(r["content"]))


_DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS session_date FROM orders WHERE dayofyear(CAST(o_orderdate AS DATE)) % 5 <> 0"


@_query(f"SELECT CAST(year(session_date) AS INTEGER) AS year, count(*) AS sessions, min(session_date) AS first_session FROM ({_DAYS}) GROUP BY 1")
def archive_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by zipped fixed-width archive."""
    folder = fresh(spark, "archives")
    _archives(_orders(spark, sf_dir), folder)
    found = candles.archive_sessions(spark, f"{folder}/*.ZIP")
    return found.groupBy(F.regexp_extract("path", r"A(\d+)\.ZIP$", 1).cast("int").alias("year")).agg(F.count("*").alias("sessions"), F.min("session_date").alias("first_session"))


@_query(f"SELECT session_date, count(*) OVER () AS session_count FROM ({_DAYS}) WHERE session_date <= DATE '1997-06-30'")
def calendar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar that is materialised from the archives with its metadata, gated, and
    read again on the second call."""
    folder = fresh(spark, "calendar")
    _archives(_orders(spark, sf_dir), f"{folder}/zip")
    for _ in range(2):
        days, _made = candles.ensure_calendar(spark, f"{folder}/official", f"{folder}/zip/*.ZIP", "1997-06-30")
    told = sinks.read_json(spark, f"{folder}/official/sessions.json")
    return days.select("session_date", F.lit(told["session_count"]).cast("long").alias("session_count"))


@_query(o.query("SELECT momentum_period, ticker_idx, seq, round(score, 6) AS score FROM mom WHERE score IS NOT NULL", o.momenta(c.GRID.momenta)))
def indicator_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momenta from a cache that is bound to its data and periods."""
    rows = c._candles(spark, sf_dir)
    data = rows.agg(F.count("*").alias("rows"), F.sum(F.xxhash64("ticker_idx", "date", "open", "close").cast("decimal(20,0)")).cast("string").alias("hash")).first().asDict()
    facts, path = {"data": data, "momenta": list(c.GRID.momenta)}, fresh(spark, "cache")
    sinks.write_cache(indicators.momentum(rows, c.GRID.momenta), path, facts)
    return sinks.read_cache(spark, path, facts).where("score is not null").select("momentum_period", "ticker_idx", "seq", c._r("score"))


# Result shards.


def _shard_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The wide grid in a shard for each of its three gaps, and a fourth that is empty."""
    m = c._market(spark, sf_dir)
    ends = m.calendar.agg(F.min("session_date").cast("string").alias("a"), F.max("session_date").cast("string").alias("b")).first()
    told = {k: "0" * 40 for k in shards.PROVENANCE} | {"github_run_id": "1", "snapshot_universe_sha256": "0" * 64, "snapshot_requested_end": ends["b"]}
    for i in range(4):
        own = c.WIDE.shard(i, 4)
        rows = vector.grid_results(m, own, c.COSTS, shard=i).withColumns({"start": F.to_date(F.lit(ends["a"])), "end": F.to_date(F.lit(ends["b"]))}) if own else None
        shards.write_shard(rows, folder, i, 4, c.WIDE, own.gaps if own else (), (ends["a"], ends["b"]), c.COSTS, told, spark)


_WIDE_RES = o.query(f"SELECT {c._KEYS}, CAST(gap_period - 5 AS INTEGER) AS shard, round(final_equity, 4) AS final_equity, trades, final_holding FROM res", *c._folded(c.WIDE))


@_query(_WIDE_RES)
def shard_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid's results by way of its shards' CSV files."""
    folder = fresh(spark, "shards")
    _shard_files(spark, sf_dir, folder)
    rows = sinks.read_results(spark, f"{folder}/shard_*.csv")
    return rows.select(*COMBO, "shard", c._r("final_equity", 4), "trades", "final_holding")


@_query(
    o.query(
        """SELECT shard, rows, gaps FROM (SELECT CAST(gap_period - 5 AS INTEGER) AS shard, count(*) AS rows, CAST(any_value(gap_period) AS VARCHAR) AS gaps FROM res GROUP BY 1)
        UNION ALL SELECT 3, 0, ''""",
        *c._folded(c.WIDE),
    )
)
def shard_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards' JSON sidecars tell."""
    folder = fresh(spark, "shards")
    _shard_files(spark, sf_dir, folder)
    return shards.sidecars(spark, folder).select("shard", "rows", F.array_join("gap_values", ",").alias("gaps"))


@_query(
    "SELECT * FROM (VALUES (0, 'fee_bps'), (0, 'github_run_id'), (1, 'rows'), (1, 'csv_sha256'), (2, 'gap_values'), (2, 'signal range'), (2, 'rows of ranges'), (3, 'no sidecar'), (CAST(NULL AS INTEGER), 'contract')) v(shard, problem)"
)
def shard_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of shard files after a fee, a run id and ranges were changed in sidecars,
    a row was added to a table and a sidecar was lost."""
    folder, away = fresh(spark, "shards"), fresh(spark, "spoilt")
    _shard_files(spark, sf_dir, folder)
    change = {0: {"fee_bps": 9.0, "github_run_id": "x"}, 1: {}, 2: {"gap_values": [9], "signal_max": 5}}
    for i, fields in change.items():
        rows = sinks.read_results(spark, f"{folder}/shard_{i}.csv")
        sinks.write_csv(rows.unionByName(rows.limit(1)) if i == 1 else rows, f"{away}/shard_{i}.csv")
        told = sinks.read_json(spark, f"{folder}/shard_{i}.json") | fields
        if i != 1:  # the other tables are as they were: their hashes are those of what was written now
            told["csv_sha256"] = shards.hashes(spark, away, f"shard_{i}.csv").first()["csv_sha256"]
        sinks.write_json(spark, told, f"{away}/shard_{i}.json")
    sinks.write_csv(sinks.empty_results(spark), f"{away}/shard_3.csv")
    return shards.audit(spark, away, 4, c.COSTS)


# Windows, artefacts and manifests.

_ARTEFACTS = """t AS (SELECT CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR) || '-' || (o_custkey % 6) AS artefact, year(CAST(o_orderdate AS DATE)) AS y, CAST(o_orderdate AS DATE) AS d, o_custkey % 6 AS k,
    CAST(5 + o_custkey % 7 AS INTEGER) AS gap_period, CAST(2 + o_orderkey % 3 AS INTEGER) AS signal_period, CAST(5 + o_orderkey % 4 AS INTEGER) AS momentum_period, 21 AS vol_period, o_totalprice FROM orders),
  spans AS (SELECT artefact, y, max(d) - CAST(k * 2 AS INTEGER) AS training_end FROM t GROUP BY artefact, y, k),
  chosen AS (SELECT CAST(y AS VARCHAR) AS window_id, max_by(artefact, (training_end, artefact)) FILTER (training_end >= make_date(y, 12, 31) - 7) AS artefact, max(training_end) FILTER (training_end >= make_date(y, 12, 31) - 7) AS training_end FROM spans GROUP BY y)"""


def _yearly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A window for each year of orders, six artefacts trained on it, which end sooner or
    later, and their leading rows."""
    day = F.to_date("o_orderdate")
    k, year = F.col("o_custkey") % 6, F.year(day)
    rows = _orders(spark, sf_dir).select(
        F.concat_ws("-", year, k).alias("artefact"), year.alias("year"), day.alias("day"), k.alias("k"),
        (5 + F.col("o_custkey") % 7).cast("int").alias("gap_period"), (2 + F.col("o_orderkey") % 3).cast("int").alias("signal_period"),
        (5 + F.col("o_orderkey") % 4).cast("int").alias("momentum_period"), F.lit(21).alias("vol_period"), "o_totalprice",
    )
    first = F.concat("year", F.lit("-01-01"))
    spans = rows.groupBy("artefact", "year", "k").agg(F.max("day").alias("last")).select("artefact", first.alias("training_start"), F.date_sub("last", (F.col("k") * 2).cast("int")).cast("string").alias("training_end"))
    windows = rows.select("year").distinct().select(F.col("year").cast("string").alias("id"), first.alias("train_start"), F.concat("year", F.lit("-12-31")).alias("train_end"), F.concat(F.col("year") + 1, F.lit("-01-01")).alias("oos_start"), F.lit("").alias("oos_end"))
    tops = rows.groupBy("artefact", *COMBO).agg(F.max("o_totalprice").alias("final_equity"))
    return windows, spans, tops


@_query(f"WITH {_ARTEFACTS} SELECT window_id, artefact, CAST(training_end AS VARCHAR) AS training_end FROM chosen")
def latest_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows, spans, _ = _yearly(spark, sf_dir)
    return training.latest_training(windows, spans)


@_query(
    f"""WITH {_ARTEFACTS}, p AS (SELECT artefact, {c._KEYS}, max(o_totalprice) AS final_equity FROM t GROUP BY ALL)
    SELECT window_id, 1 AS training_rank, {c._KEYS}, final_equity FROM chosen JOIN p USING (artefact) QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY final_equity DESC, {c._KEYS}) = 1"""
)
def training_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best parameters of the artefact that each window is to be evaluated with."""
    windows, spans, tops = _yearly(spark, sf_dir)
    return training.leaders(training.latest_training(windows, spans), tops)


_TRAINED = [
    *o.grid_parts(c.WIDE)[:-1],
    *(x for w in c.WINDOWS for x in (
        *o.span(f"t{w.id}", "SELECT * FROM gs, ss, ms, vs", c.COSTS, w.train_start, w.train_end)[:-1],
        f"best_{w.id} AS (SELECT {c._KEYS} FROM res_t{w.id} ORDER BY final_equity DESC, {c._KEYS} LIMIT 1)",
    )),
    *o.span("w1", f"SELECT {c._KEYS} FROM best_w1", c.COSTS, c._W1.oos_start, c._W1.oos_end),
    *o.span("w2", f"SELECT {c._KEYS} FROM best_w2", c.COSTS, c._W2.oos_start, c._W2.oos_end, "(SELECT max_by(equity, date) FROM curve_w1)"),
]


@_query(
    o.query(
        f"""SELECT window_id, {c._KEYS}, min(date) AS first, max(date) AS last, round(max_by(equity, date), 4) AS end_equity
        FROM (SELECT 'w1' AS window_id, * FROM curve_w1 UNION ALL SELECT 'w2', * FROM curve_w2) GROUP BY ALL""",
        *_TRAINED,
    )
)
def trained_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk-forward from a table of windows: each window's grid is searched on its own
    training span, its leader is found by a join, and capital is carried on."""
    rows = c._candles(spark, sf_dir)
    load = lambda start, end: market(rows, c.TICKERS, start=start, end=end)
    windows = spark.createDataFrame([(w.id, w.train_start, w.train_end, w.oos_start, w.oos_end) for w in c.WINDOWS], "id string, train_start string, train_end string, oos_start string, oos_end string")
    tops = None
    for w in c.WINDOWS:
        found = vector.grid_results(load(w.train_start, w.train_end), c.WIDE, c.COSTS, top_k=5).withColumn("artefact", F.lit(w.id))
        tops = found if tops is None else tops.unionByName(found)
    best = {r["window_id"]: tuple(r[k] for k in COMBO) for r in training.leaders(windows.select(F.col("id").alias("window_id"), F.col("id").alias("artefact")), tops).collect()}
    chosen = [c.wf.WindowRow(w.id, w.train_start, w.train_end, w.oos_start, w.oos_end, best[w.id]) for w in c.WINDOWS]
    curves = c.wf.walk_forward(load, chosen, c.COSTS)
    return training.window_results(curves, c.COSTS.initial_cash).select("window_id", *COMBO, "first", "last", c._r("end_equity", 4))


@_query(
    """SELECT artefact, training_start, training_end, CASE WHEN k % 5 > 0 THEN n % 7 + 0.25 END AS fee_bps, array_to_string(list_sort(sources), ' ') AS sources, CAST(bad AS BIGINT) AS bad_sources FROM (
      SELECT 'a' || k AS artefact, k, count(*) AS n, CAST(CASE WHEN k % 3 = 0 THEN max(CAST(o_orderdate AS DATE)) ELSE min(CAST(o_orderdate AS DATE)) END AS VARCHAR) AS training_start,
        CASE WHEN k % 4 > 0 THEN CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) END AS training_end,
        list(DISTINCT 'src/' || o_orderstatus || '.py') AS sources, count(DISTINCT o_orderstatus) FILTER (k % 11 = 0 AND o_orderstatus = 'F') AS bad
      FROM (SELECT *, o_custkey % 50 AS k FROM orders) GROUP BY k)"""
)
def manifest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of manifests as JSON text: fall-back paths, fields of another kind, absent
    objects, and a map of path to hash of which some hashes are broken."""
    day, k = F.to_date("o_orderdate"), (F.col("o_custkey") % 50).alias("k")
    rows = _orders(spark, sf_dir).select(k, day.alias("day"), F.concat(F.lit("src/"), "o_orderstatus", F.lit(".py")).alias("path"))
    hashes = F.transform(F.array_sort(F.collect_set("path")), lambda p: F.struct(p.alias("key"), F.when((F.col("k") % 11 == 0) & (p == "src/F.py"), F.lit("none")).otherwise(F.sha2(p, 256)).alias("value")))
    agg = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("day").cast("string").alias("low"), F.max("day").cast("string").alias("high"), hashes.alias("hashes"))
    execution = F.struct(F.col("high").alias("start"), F.when(F.col("k") % 4 > 0, F.col("high")).alias("end"), F.when(F.col("k") % 5 > 0, (F.col("n") % 7 + 0.25).cast("string")).otherwise("n/a").alias("fee_bps_per_side"))
    text = F.to_json(F.struct(F.lit(3).alias("schema_version"), F.when(F.col("k") % 3 > 0, F.struct(F.col("low").alias("start"))).alias("training"), execution.alias("execution"), F.map_from_entries("hashes").alias("optimizer_source_sha256")))
    told = artefacts.facts(agg.select(F.concat(F.lit("a"), "k").alias("artefact"), text.alias("manifest")))
    bad = F.size(F.map_filter("sources", lambda p, h: ~h.rlike("^[0-9a-f]{64}$"))).cast("long")
    return told.select("artefact", "training_start", "training_end", "fee_bps", F.array_join(F.array_sort(F.map_keys("sources")), " ").alias("sources"), bad.alias("bad_sources"))


@_query(
    """WITH f AS (SELECT 'n' || c_nationkey AS a, c_mktsegment AS b, c_custkey || '.txt' AS name, sha256(c_name) AS sha FROM customer),
    l2 AS (SELECT a, b, count(*) AS files, sha256(array_to_string(list_sort(list(name || ':' || sha)), chr(10))) AS sha FROM f GROUP BY a, b),
    l1 AS (SELECT a, CAST(sum(files) AS BIGINT) AS files, sha256(array_to_string(list_sort(list(b || '/:' || sha)), chr(10))) AS sha FROM l2 GROUP BY a)
    SELECT a || '/' || b AS folder, files, sha AS sha256 FROM l2 UNION ALL SELECT a, files, sha FROM l1
    UNION ALL SELECT '', CAST(sum(files) AS BIGINT), sha256(array_to_string(list_sort(list(a || '/:' || sha)), chr(10))) FROM l1"""
)
def hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash tree of a customer list as a folder a nation and segment."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    path = F.concat(F.lit("n"), "c_nationkey", F.lit("/"), "c_mktsegment", F.lit("/"), "c_custkey", F.lit(".txt"))
    return manifest.tree(rows.select(path.alias("path"), F.sha2("c_name", 256).alias("sha256")))


@_query(
    """WITH f AS (SELECT 'n' || c_nationkey || '/' || c_custkey AS path, sha256(c_name) AS sha, c_custkey AS k FROM customer)
    SELECT path, CASE WHEN k % 10 = 1 THEN 'changed' WHEN k % 10 = 2 THEN 'missing' ELSE 'new' END AS problem FROM f WHERE k % 10 BETWEEN 1 AND 3"""
)
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against a manifest, when some changed, some went and some are new."""
    k = F.col("c_custkey") % 10
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("n"), "c_nationkey", F.lit("/"), "c_custkey").alias("path"), F.sha2("c_name", 256).alias("sha256"), k.alias("k"))
    now = rows.where("k <> 2").withColumn("sha256", F.when(F.col("k") == 1, F.reverse("sha256")).otherwise(F.col("sha256")))
    return manifest.compare(now, rows.where("k <> 3"))


# Labels, maps and a second way to the quantity.

_VOLS = Grid((5, 10), (2,), (5, 10), (2, 3, 4, 5, 6, 7, 8, 21))


@_query(
    o.query(
        """SELECT gap_period, signal_period, momentum_period, CASE WHEN min(vol_period) = max(vol_period) THEN CAST(min(vol_period) AS VARCHAR) ELSE min(vol_period) || '..' || max(vol_period) END AS vols, any_value(trades) AS trades, round(any_value(final_equity), 4) AS final_equity
        FROM (SELECT *, vol_period - row_number() OVER (PARTITION BY gap_period, signal_period, momentum_period, final_equity, trades ORDER BY vol_period) AS island FROM res)
        GROUP BY gap_period, signal_period, momentum_period, final_equity, trades, island""",
        *c._folded(_VOLS),
    )
)
def vol_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vol periods with one outcome, labelled as a range."""
    rows = vector.grid_results(c._market(spark, sf_dir), _VOLS, c.COSTS)
    found = indicators.vol_islands(rows, ["gap_period", "signal_period", "momentum_period"], ["final_equity", "trades"])
    return found.select("gap_period", "signal_period", "momentum_period", "vols", "trades", c._r("final_equity", 4))


@_query(o.query("SELECT array_to_string(list(year || ':' || CAST(CAST(floor(1e6 * (end_equity / start_equity - 1)) AS BIGINT) AS VARCHAR) ORDER BY year), ' ') AS years, count(*) FILTER (end_equity < start_equity) AS losses FROM yr", *c._CURVE, c._YEARS))
def annual_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns as a map of year to return."""
    rows = metrics.annual_map(metrics.annual(c._curve(spark, sf_dir), c.COSTS.initial_cash))
    entry = lambda y: F.concat_ws(":", y, F.floor(F.lit(1e6) * F.element_at("returns", y)).cast("long"))
    losses = F.size(F.map_filter("returns", lambda y, r: r < 0)).cast("long")
    return rows.select(F.array_join(F.transform(F.array_sort(F.map_keys("returns")), entry), " ").alias("years"), losses.alias("losses"))


@_query("SELECT o_orderkey, " + o.quantity("o_totalprice", "CAST(o_orderkey % 997 + 0.37 AS DOUBLE)", c.COSTS) + " AS shares FROM orders")
def quantity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affordable quantity found by trying every one, a second plan beside the formula."""
    price = (F.col("o_orderkey") % 997 + F.lit(0.37)).cast("double")
    rows = _orders(spark, sf_dir).select("o_orderkey", F.col("o_totalprice").alias("cash"), price.alias("price"))
    return affordable_by_scan(rows, ["o_orderkey"], *c.COSTS.rates).withColumnRenamed("quantity", "shares")


@_query(
    o.query(
        """SELECT gap_period, signal_period, momentum_period, vol_period, rows, problem FROM (
          SELECT gap_period, signal_period, momentum_period, vol_period, 2 AS rows, 'repeated' AS problem FROM res WHERE gap_period = 5 AND signal_period = 2
          UNION ALL SELECT 99, signal_period, momentum_period, vol_period, 1, 'extra' FROM res WHERE gap_period = 6 AND momentum_period = 6
          UNION ALL SELECT gap_period, signal_period, momentum_period, vol_period, NULL, 'missing' FROM res WHERE gap_period = 6 AND momentum_period = 6)""",
        *c._folded(c.WIDE),
    )
)
def result_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a searched grid's own result table, some rows of it repeated and some
    under another gap."""
    rows = vector.grid_results(c._market(spark, sf_dir), c.WIDE, c.COSTS)
    moved = rows.withColumn("gap_period", F.when(F.expr("gap_period = 6 and momentum_period = 6"), 99).otherwise(F.col("gap_period")))
    broken = moved.unionByName(moved.where("gap_period = 5 and signal_period = 2"))
    return audits.grid_coverage(broken, periods(spark, c.WIDE)).withColumn("rows", F.col("rows").cast("int"))


@_query(
    """SELECT CAST(y AS VARCHAR) AS window_id, problem FROM (SELECT DISTINCT year(CAST(o_orderdate AS DATE)) AS y FROM orders)
    JOIN (VALUES (1998, 'mode'), (1999, 'schema'), (2000, 'optimizer_sha'), (2000, 'source hashes'), (1995, 'costs'), (1996, 'top rows'), (1996, 'top table'), (1997, 'dates'), (1997, 'window'), (2001, 'artefact')) v(y, problem) USING (y)"""
)
def artefact_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provenance gate over a window for each year of orders, whose artefacts are
    spoilt in one way or another; the last year has none."""
    year, day = F.year("o_orderdate"), F.to_date("o_orderdate")
    rows = _orders(spark, sf_dir).select(year.alias("y"), day.alias("day"), (5 + F.col("o_custkey") % 7).cast("int").alias("gap_period"), "o_totalprice")
    spans = rows.groupBy("y").agg(F.max("day").cast("string").alias("last"))
    at = lambda n, bad, good: F.when(F.col("y") == n, bad).otherwise(good)
    first, sha, other = F.concat("y", F.lit("-01-01")), F.sha2(F.col("y").cast("string"), 256), F.sha2(F.lit("x"), 256)
    costs = (F.lit(c.COSTS.initial_cash).alias("initial_cash"), at(1995, c.COSTS.fee_bps + 1, F.lit(c.COSTS.fee_bps)).alias("fee_bps_per_side"), F.lit(c.COSTS.slippage_bps).alias("slippage_bps_per_side"), F.lit(c.COSTS.odd_lot_extra_bps).alias("odd_lot_extra_bps_weighted"))
    selected = F.struct(at(1998, "in_sample_full", F.lit("training_only")).alias("mode"), first.alias("training_start"), at(1997, F.lit("1997-01-31"), F.col("last")).alias("training_end"), at(1996, other, sha).alias("top_100_sha256"))
    hashes = F.create_map(F.lit("src/a.py"), at(2000, F.lit("none"), other))
    text = F.to_json(F.struct(at(1999, 1, F.lit(3)).alias("schema_version"), at(2000, "short", F.lit("a" * 40)).alias("optimizer_sha"), F.lit("b" * 40).alias("upstream_sha"), hashes.alias("optimizer_source_sha256"), F.struct(first.alias("start"), F.col("last").alias("end"), *costs).alias("execution"), selected.alias("selection_provenance")))
    told = artefacts.facts(spans.where("y < 2001").select(F.col("y").cast("string").alias("artefact"), text.alias("manifest")))
    windows = spans.select(F.col("y").cast("string").alias("id"), first.alias("train_start"), F.concat("y", F.lit("-12-31")).alias("train_end"), F.concat(F.col("y") + 1, F.lit("-01-01")).alias("oos_start"), F.lit("").alias("oos_end"))
    tops = rows.groupBy(F.col("y").cast("string").alias("artefact"), "gap_period").agg(F.max("o_totalprice").alias("final_equity")).select("artefact", "gap_period", F.lit(2).alias("signal_period"), F.when(F.col("artefact") != "1996", 5).alias("momentum_period"), F.lit(21).alias("vol_period"), "final_equity")
    return training.gate(windows, told, spans.select(F.col("y").cast("string").alias("artefact"), sha.alias("sha256")), tops, c.COSTS)


@_query(
    """WITH w AS (SELECT y, y % 3 = 0 AS late, y % 4 = 0 AS wide FROM (SELECT DISTINCT year(CAST(o_orderdate AS DATE)) AS y FROM orders))
    SELECT CAST(y AS VARCHAR) AS window_id, 'training' AS problem FROM w WHERE late
    UNION ALL SELECT CAST(y AS VARCHAR), 'overlap' FROM w WHERE y - 1 IN (SELECT y FROM w WHERE wide)
    UNION ALL SELECT CAST(y AS VARCHAR), 'empty' FROM w WHERE y = 1995 UNION ALL SELECT CAST(y AS VARCHAR), 'date' FROM w WHERE y = 1997 UNION ALL SELECT CAST(y AS VARCHAR), 'training' FROM w WHERE y = 1997"""
)
def window_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a year each, of which some train into their evaluation, reach into the
    next one, end before they start or have no date."""
    y = F.col("y")
    rows = _orders(spark, sf_dir).select(F.year("o_orderdate").alias("y")).distinct()
    end = F.when(y == 1995, F.lit("1995-12-31")).when(y % 4 == 0, F.concat(y + 2, F.lit("-01-02"))).otherwise(F.concat(y + 1, F.lit("-12-31")))
    last = F.when(y == 1997, F.lit("open")).when(y % 3 == 0, F.concat(y + 1, F.lit("-01-01"))).otherwise(F.concat(y, F.lit("-12-31")))
    return training.order_problems(rows.select(y.cast("string").alias("id"), F.concat(y, F.lit("-01-01")).alias("train_start"), last.alias("train_end"), F.concat(y + 1, F.lit("-01-01")).alias("oos_start"), end.alias("oos_end")))


@_query(
    o.query(
        """SELECT CASE WHEN complete_year THEN 'complete' ELSE 'partial' END AS coverage, count(*) AS lines, CAST(sum(year) AS BIGINT) AS years FROM yr GROUP BY 1""",
        *c._CURVE,
        c._YEARS,
    )
)
def annual_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown report by year, written and read again line by line."""
    years = metrics.annual(c._curve(spark, sf_dir), c.COSTS.initial_cash)
    path = f"{fresh(spark, 'report')}/annual.md"
    sinks.put_text(spark, path, reports.annual_report(years, metrics.complete_year_means(years), 0.0))
    cells = F.split("value", r" \| ")
    found = spark.read.text(path).where(F.col("value").rlike(r"^\| \d{4} \|"))
    return found.select(F.regexp_replace(F.element_at(cells, -1), r"[ |]", "").alias("coverage"), F.regexp_extract("value", r"(\d{4})", 1).cast("long").alias("year")).groupBy("coverage").agg(F.count("*").alias("lines"), F.sum("year").alias("years"))


@_query(o.query("SELECT 'OBSERVED_UNION_FALLBACK' AS source, count(*) AS sessions, CAST(min(year(session_date)) AS INTEGER) AS first_year FROM cal"))
def session_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session list with where it comes from, and the archive's first year."""
    rows = c._candles(spark, sf_dir)
    days, label = candles.sessions(spark, rows)
    return days.agg(F.count("*").alias("sessions")).select(F.lit(label).alias("source"), "sessions", F.lit(candles.first_year(rows)).alias("first_year"))
