"""Order arithmetic as column expressions: whole lots of 100, odd lots, costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOT = 100


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside a fold."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slippage(price: Column, shares: Column, base: float, extra: float) -> Column:
    return price * (F.lit(base) * shares + F.lit(extra) * (shares % LOT))


def purchase(price: Column, shares: Column, base: float, extra: float) -> Column:
    """Price of shares with slippage, before the fee."""
    return price * (F.lit(1.0 + base) * shares + F.lit(extra) * (shares % LOT))


def affordable(cash: Column, price: Column, fee: float, base: float, extra: float) -> Column:
    """The most shares that ``cash`` buys with all costs; 0 without a valid price."""
    lot, odd = price * F.lit(1.0 + fee) * F.lit(1.0 + base), price * F.lit(1.0 + fee) * F.lit(extra)
    lots = F.floor(cash / (lot * 100.0))
    rest = cash - lots * lot * 100.0
    loose = F.least(F.greatest(F.floor(F.greatest(rest, F.lit(0.0)) / (lot + odd)), F.lit(0).cast("long")), F.lit(99).cast("long"))
    whole = lots * LOT + loose

    def afford(q: Column) -> Column:
        return F.when(purchase(price, q, base, extra) * F.lit(1.0 + fee) > cash + 1e-9, F.greatest(q - 1, F.lit(0).cast("long"))).otherwise(q)

    return F.when((price > 0) & (cash > 0), let(whole, afford)).otherwise(F.lit(0).cast("long"))


def affordable_by_scan(rows: DataFrame, keys: list[str], fee: float, base: float, extra: float) -> DataFrame:
    """(keys, quantity): the most shares that ``cash`` buys at ``price``, found by trying
    quantities: lots by halving steps, then every number of loose shares. It shares no
    arithmetic with ``affordable`` but the cost of a purchase, and is there to be compared
    with it. A row is worked on by itself, with some hundred tries whatever its cash.

    The rates aren't negative, so a lot's first share costs no less than that of the lot
    before, also rounded, and each share of a lot no less than the one before; what a
    quantity that is beyond the last fitting lot costs is never within the cash."""
    valid = (F.col("price") > 0) & (F.col("cash") > 0) & (F.col("price") < float("inf")) & (F.col("cash") < float("inf"))
    none = F.lit(0).cast("long")

    def fits(q: Column) -> Column:
        return purchase(F.col("price"), q, base, extra) * F.lit(1.0 + fee) <= F.col("cash") + 1e-9

    # Lots are below 2 ** bits: without rates, so many cost more than there is.
    bits = F.ceil(F.log2(F.col("cash") / F.col("price") / LOT + 2)).cast("int")
    bits = F.when(bits <= 56, bits).otherwise(F.raise_error(F.lit("more shares than a long holds")).cast("int"))
    steps = F.transform(F.sequence(bits, F.lit(0)), lambda b: F.call_function("shiftleft", F.lit(LOT).cast("long"), b))
    whole = F.aggregate(steps, none, lambda q, step: F.when(fits(q + step), q + step).otherwise(q))
    loose = lambda q: F.aggregate(F.sequence(none, F.lit(LOT - 1).cast("long")), none, lambda most, n: F.when(fits(q + n), n).otherwise(most))
    return rows.select(*keys, F.when(valid, let(whole, lambda q: q + loose(q))).otherwise(none).alias("quantity"))


def close_to(a: Column, b: Column, rel: float = 1e-10, abs_: float = 1e-7) -> Column:
    """Within a relative or an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))
