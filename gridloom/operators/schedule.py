"""Trading calendar and weekly schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def observed_calendar(candles: DataFrame) -> DataFrame:
    """All dates on which some ticker traded."""
    return candles.select(F.col("date").alias("session_date")).distinct()


def numbered(sessions: DataFrame) -> DataFrame:
    """(session_idx, session_date) in order. A calendar has a few thousand rows."""
    order = Window.orderBy("session_date")
    return sessions.select((F.row_number().over(order) - 1).alias("session_idx"), "session_date")


def outside(candles: DataFrame, calendar: DataFrame) -> DataFrame:
    """Candles on days that aren't sessions."""
    return candles.join(F.broadcast(calendar.select(F.col("session_date").alias("date"))), "date", "left_anti")


def weekly_schedule(calendar: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(week_idx, decision_date, execution_date): execution is on the first session of
    each ISO week, decision on the session before it. ``start`` in the middle of a week
    makes no execution date; the calendar's first session has no decision before it."""
    sessions = calendar.select("session_date")
    if end:
        sessions = sessions.where(F.col("session_date") <= F.to_date(F.lit(end)))
    order = Window.orderBy("session_date")
    before = F.lag("session_date").over(order)
    new_week = F.date_trunc("week", "session_date") != F.date_trunc("week", before)
    weeks = sessions.select("session_date", before.alias("decision_date"), new_week.alias("new_week")).where("new_week")
    if start:
        weeks = weeks.where(F.col("session_date") >= F.to_date(F.lit(start)))
    return weeks.select((F.row_number().over(order) - 1).alias("week_idx"), "decision_date", F.col("session_date").alias("execution_date"))
