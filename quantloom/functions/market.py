"""Prices, symbols, sizes and costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the largest signed 64-bit integer marks a missing raw price.
NO_PRICE = 9223372036854775807


def fixed_point(raw: Column) -> Column:
    """A price in units of 1e-9 as a double; the sentinel gives null."""
    return F.when(raw != NO_PRICE, raw / 1e9)


def fine(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column, none: Column | None = None) -> Column:
    """a / b, null (or none) where b is null or zero."""
    q = F.when(b != 0, a / F.when(b != 0, b))
    return q if none is None else F.coalesce(q, none)


def signed_percent(part: Column, whole: Column) -> Column:
    """part as a percentage of whole, to one decimal (half to even), zero where whole is."""
    return F.bround(F.coalesce(ratio(part * 100.0, whole), F.lit(0.0)), 1)


def root_of(symbol: Column) -> Column:
    """Leading letters of a futures symbol without the last, its month code."""
    return F.regexp_extract(symbol, r"^([A-Z]+)[A-Z]", 1)


def asset_of(symbol: Column, prefixes: list[str]) -> Column:
    """The longest of prefixes that a symbol starts with; null for spreads (with a dash) and others."""
    out = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        out = F.when(symbol.startswith(p), F.lit(p)).otherwise(out)
    return F.when(~symbol.contains("-"), out)


def snap(price: Column, tick: float, up: Column) -> Column:
    """The next tick at or above (up) or at or below a price, to ten decimals."""
    steps = price / tick
    return F.round(F.when(up, F.ceil(F.round(steps, 9))).otherwise(F.floor(F.round(steps, 9))) * tick, 10)


def whole_steps(raw: Column, increment: float) -> Column:
    """raw rounded down to increments, to one decimal."""
    return F.bround(F.floor(raw / increment) * increment, 1)


def aggressor(price: Column, bid: Column, ask: Column, side: Column) -> Column:
    """1 for a buyer, -1 for a seller: at or through the quote, a locked quote by the stated side, else 0."""
    stated = F.when(F.upper(side) == "B", 1).when(F.upper(side) == "A", -1).otherwise(0)
    return F.when(bid >= ask, stated).when(price >= ask, 1).when(price <= bid, -1).otherwise(0)


def commission(contracts: Column, full: float, micro: float | None) -> Column:
    """In and out: whole contracts at the full rate, tenths at the micro rate if there is one, else rounded."""
    whole = F.floor(contracts)
    if micro is None:
        return F.bround(contracts) * full * 2
    return (whole * full + F.bround((contracts - whole) * 10) * micro) * 2


def slippage(gross: Column, contracts: Column, ticks: int, dollars_per_tick: float) -> Column:
    """Slipped ticks in dollars, twice as many for a losing trade."""
    return F.when(gross < 0, 2 * ticks).otherwise(ticks) * dollars_per_tick * contracts
