"""A PySpark engine for exhaustive strategy-grid backtests on daily price tables."""
