"""Schemas of the tables."""

from __future__ import annotations

CANDLE_FILE = "date string, open string, close string"
CANDLES = "ticker_idx int, ticker string, date date, seq int, open double, close double"
CALENDAR = "session_idx int, session_date date"
SCHEDULE = "week_idx int, decision_date date, execution_date date"
RESULT = (
    "gap_period int, signal_period int, momentum_period int, vol_period int, final_equity double, total_return double, trades int, "
    "skipped_executions int, fees_paid double, slippage_impact double, final_holding string, start date, end date, shard int"
)
CURVE = "date date, equity double, cash double, holding string, shares bigint, weekly_target string"
OVERRIDE = "ticker string, ex_date string, last_date_prior string, split_ratio double, event string, source_authority string, source_url string"
WINDOW = "id string, train_start string, train_end string, oos_start string, oos_end string"
GOLDEN = "date date, holding string, shares bigint, cash double, equity double, weekly_target string"
