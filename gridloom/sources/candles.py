"""Candle, universe and calendar sources."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.sources import sinks

# Fixed values of the exchange's yearly price archive: record types, and the codes of
# standard-lot equity trading.
HEADER, QUOTE, TRAILER = "00", "01", "99"
EQUITY_BDI = ("02", "05", "06", "07", "08", "09", "11")
STANDARD_MARKET = "010"
LINE = 245


def universe(spark: SparkSession, path: str) -> DataFrame:
    """(ticker_idx, ticker) from a JSON file with a ``tickers`` list, whose order counts."""
    found = spark.read.schema("tickers array<string>").json(path, multiLine=True)
    return found.select(F.posexplode("tickers")).select(F.col("pos").alias("ticker_idx"), F.upper("col").alias("ticker"))


def candle_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of candle files named <ticker>_1d.csv, or of part files in a folder of that
    name, as they are: ticker, row, date, open, close. ``row`` is the place in the file."""
    read = spark.read.schema(schemas.CANDLE_FILE).csv(pattern, header=True, enforceSchema=False)
    ticker = F.upper(F.regexp_extract(F.input_file_name(), r"([^/=]+)_1d\.csv(?:/[^/]*)?$", 1))
    return read.select(ticker.alias("ticker"), F.monotonically_increasing_id().alias("row"), "date", "open", "close")


def clean(raw: DataFrame) -> DataFrame:
    """(ticker, date, open, close): the last row of each date in file order, then only
    rows with finite and positive prices. A bad last row therefore removes its date."""
    day = F.substring("date", 1, 10).cast("date")
    last = Window.partitionBy("ticker", "date").orderBy(F.desc("row"))
    rows = raw.select("ticker", "row", day.alias("date"), *(F.expr(f"try_cast({c} AS double)").alias(c) for c in ("open", "close")))
    rows = rows.withColumn("nth", F.row_number().over(last)).where("nth = 1")
    for c in ("open", "close"):
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf")))
    return rows.select("ticker", "date", "open", "close")


def sequenced(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """The candle table: with the universe's index and each candle's number in its ticker."""
    order = Window.partitionBy("ticker_idx").orderBy("date")
    seq = (F.row_number().over(order) - 1).alias("seq")
    return rows.join(F.broadcast(tickers), "ticker").select("ticker_idx", "ticker", "date", seq, "open", "close")


def calendar_file(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a calendar file with a ``date`` column; it must be strictly increasing."""
    rows = spark.read.schema("date string").csv(path, header=True, enforceSchema=False)
    rows = rows.select(F.substring("date", 1, 10).cast("date").alias("session_date"), F.monotonically_increasing_id().alias("row"))
    before = F.lag("session_date").over(Window.orderBy("row"))
    wrong = rows.select(before.alias("before"), "session_date").where(F.col("before") >= F.col("session_date"))
    if wrong.limit(1).count():
        raise ValueError(f"{path}: dates aren't strictly increasing")
    return rows.select("session_date")


# How a session list tells where it comes from.
OFFICIAL, OBSERVED = "B3_COTAHIST_ANNUAL_ARCHIVES", "OBSERVED_UNION_FALLBACK"


def override_file(spark: SparkSession, path: str) -> DataFrame:
    """Corporate-action events of a JSON file with an ``events`` list; fields that are
    absent are null."""
    fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in schemas.OVERRIDE.split(", "))
    return spark.read.schema(f"events array<struct<{fields}>>").json(path, multiLine=True).select(F.explode("events").alias("e")).select("e.*")


def sessions(spark: SparkSession, candles: DataFrame, calendar: str | None = None) -> tuple[DataFrame, str]:
    """The sessions of a calendar file, or else all days with a candle, and which."""
    if calendar:
        return calendar_file(spark, calendar), OFFICIAL
    return candles.select(F.col("date").alias("session_date")).distinct(), OBSERVED


def first_year(candles: DataFrame) -> int:
    """The year of the earliest candle; a ticker without one fails."""
    years = candles.groupBy("ticker").agg(F.min(F.year("date")).alias("year")).agg(F.min("year").alias("year"), F.count_if(F.col("year").isNull()).alias("empty")).first()
    if years["year"] is None or years["empty"]:
        raise ValueError("a calendar's first year needs a candle of each ticker")
    return years["year"]


def calendar_gate(calendar: DataFrame, meta: dict, sha256: str, requested_end: str) -> list[str]:
    """Problems of a calendar against its metadata."""
    row = calendar.agg(F.min("session_date").cast("string").alias("first_session"), F.max("session_date").cast("string").alias("last_session"), F.count("*").alias("session_count")).first()
    wanted = row.asDict() | {"status": "PASS", "requested_end": requested_end, "calendar_sha256": sha256}
    found = [f"{k}: {meta.get(k)!r} is not {v!r}" for k, v in wanted.items() if meta.get(k) != v]
    return found + ["a session after the end"] * bool(row["last_session"] and row["last_session"] > requested_end)


def ensure_calendar(spark: SparkSession, folder: str, archives: str, requested_end: str) -> tuple[DataFrame, bool]:
    """The official calendar of a snapshot, materialised from the exchange's archives
    where it is absent, and whether it was. ``folder`` has or gets ``sessions.csv`` and
    its metadata ``sessions.json``; one without the other fails, and so does a calendar
    that doesn't match its metadata."""
    table, facts = f"{folder}/sessions.csv", f"{folder}/sessions.json"
    there = [sinks.exists(spark, p) for p in (table, facts)]
    if there[0] != there[1]:
        raise ValueError(f"{folder}: a calendar needs both its table and its metadata")
    if not there[0]:
        days = build_calendar(archive_sessions(spark, archives), requested_end).orderBy("session_date").select(F.col("session_date").cast("string").alias("date"))
        days.coalesce(1).write.option("header", True).csv(table)  # a row a session
        row = days.agg(F.min("date").alias("first_session"), F.max("date").alias("last_session"), F.count("*").alias("session_count")).first()
        meta = {"status": "PASS", "source": OFFICIAL, "requested_end": requested_end, "calendar_sha256": _digest(spark, table)} | row.asDict()
        sinks.put_text(spark, facts, json.dumps(meta, indent=2) + "\n")
    found = calendar_file(spark, table)
    meta = sinks.read_json(spark, facts)
    problems = calendar_gate(found, meta, _digest(spark, table), requested_end)
    problems += ["source"] if meta.get("source") != OFFICIAL else []
    if problems:
        raise ValueError(f"{folder}: {'; '.join(problems)}")
    return found, not there[0]


def _digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a table of one file."""
    rows = sinks.file_hashes(spark, path).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: one file is expected, not {len(rows)}")
    return rows[0]["sha256"]


def archive_sessions(spark: SparkSession, pattern: str) -> DataFrame:
    """Distinct (path, session_date) of standard-lot equity trading in zipped fixed-width
    archives. A truncated line, a missing envelope or a bad date fails the job."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if not n.endswith("/")]
                    if len(names) != 1:
                        raise ValueError(f"{path}: one text file is expected, not {names}")
                    text = archive.read(names[0]).decode("latin-1")
                rows = [x for x in text.splitlines() if x]
                short = next((i for i, x in enumerate(rows, 1) if len(x) < LINE), None)
                if short:
                    raise ValueError(f"{path}: line {short} is truncated")
                kinds = [x[:2] for x in rows]
                if kinds.count(HEADER) != 1 or TRAILER not in kinds:
                    raise ValueError(f"{path}: header or trailer missing or repeated")
                yield pd.DataFrame({"path": path, "line": [x[:27] for x in rows]})

    found = spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(lines, "path string, line string")
    line = F.col("line")
    quotes = found.where((line.substr(1, 2) == QUOTE) & line.substr(11, 2).isin(*EQUITY_BDI) & (line.substr(25, 3) == STANDARD_MARKET))
    return quotes.select("path", F.to_date(line.substr(3, 8), "yyyyMMdd").alias("session_date")).distinct()


def build_calendar(sessions: DataFrame, requested_end: str) -> DataFrame:
    """Sessions of all archives up to a date, each once."""
    return sessions.select("session_date").where(F.col("session_date") <= F.to_date(F.lit(requested_end))).distinct()


def demo_candles(orders: DataFrame, tickers: int = 8) -> DataFrame:
    """Candles derived from an order table: per customer group and day the price of the
    first order opens and that of the last one closes."""
    own = orders.select((F.col("o_custkey") % tickers).cast("int").alias("ticker_idx"), F.col("o_orderdate").cast("date").alias("date"), "o_totalprice", "o_orderkey")
    day = own.groupBy("ticker_idx", "date").agg(
        (F.min_by("o_totalprice", "o_orderkey") / 1000).alias("open"), (F.max_by("o_totalprice", "o_orderkey") / 1000).alias("close")
    )
    order = Window.partitionBy("ticker_idx").orderBy("date")
    name = F.concat(F.lit("T"), F.col("ticker_idx").cast("string"))
    return day.select("ticker_idx", name.alias("ticker"), "date", (F.row_number().over(order) - 1).alias("seq"), "open", "close")
