"""Price and certainty rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotvalue.functions.rounding import round_share

# Certainty scale of a visual match.
MARGIN_FULL = 5.0
SCORE_GOOD = 12.0
SCORE_BAD = 40.0
UNKNOWN_CERTAINTY = 0.5

BASES = ("avg24h", "low")


def price_basis(requested: str | None) -> str:
    return requested if requested in BASES else "avg24h"


def nonzero(col: Column) -> Column:
    """Zero counts as missing in every price rule."""
    return F.nullif(col, F.lit(0))


def market_price(avg: Column, low: Column, basis: str = "avg24h") -> Column:
    order = (low, avg) if price_basis(basis) == "low" else (avg, low)
    return F.coalesce(*[nonzero(c) for c in order], F.lit(0))


def best_offer(sell_for: Column) -> Column:
    """Highest price in an array of offers; 0 without offers."""
    prices = F.transform(sell_for, lambda offer: offer["priceRUB"])
    return F.coalesce(F.array_max(prices), F.lit(0))


def effective_value(
    avg: Column, low: Column, vendor: Column, base: Column, basis: str = "avg24h"
) -> Column:
    floor = [F.coalesce(c, F.lit(0)) for c in (vendor, base)]
    return F.greatest(market_price(avg, low, basis), *floor).cast("bigint")


def fallback_price(avg: Column, low: Column, base: Column, default_zero: bool = True) -> Column:
    """First non-zero of average, low, base.

    Without ``default_zero`` a missing base price is returned as it is (null or 0).
    """
    price = F.coalesce(nonzero(avg), nonzero(low), base)
    return F.coalesce(price, F.lit(0)) if default_zero else price


def cells(size: Column) -> Column:
    """Width or height in slots; null and 0 mean one."""
    return F.coalesce(F.nullif(size, F.lit(0)), F.lit(1))


def value_per_slot(value: Column, slots: Column) -> Column:
    return F.bround(value / slots).cast("bigint")


def _unit(col: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col))


def link_certainty(score: Column, margin: Column, override: Column) -> Column:
    """How far an icon-to-item link can be trusted, 0 to 1 with three decimals."""
    closeness = _unit((F.lit(SCORE_BAD) - score) / (SCORE_BAD - SCORE_GOOD))
    return (
        F.when(override, F.lit(1.0))
        .when(score.isNull() | margin.isNull(), F.lit(UNKNOWN_CERTAINTY))
        .otherwise(round_share(_unit(margin / MARGIN_FULL) * closeness, 3))
    )
