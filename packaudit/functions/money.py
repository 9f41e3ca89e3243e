"""Amounts and ratios: two rounding modes, safe division, and money in text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT, RATIO = "decimal(18,2)", "decimal(18,4)"
CENT = Decimal("0.01")


def cents(value: Column) -> Column:
    """A double as an amount: half cents go up."""
    return (F.round(value * 100).cast("decimal(18,0)") * F.lit(CENT)).cast(AMOUNT)


def amount(value: Column) -> Column:
    return value.cast(AMOUNT)


def half_even(value: Column, scale: int) -> Column:
    """Metrics and ratios round half to even."""
    return F.bround(value, scale).cast(f"decimal(18,{scale})")


def half_up(value: Column, scale: int = 2) -> Column:
    """Allocations, cash flow and growth round half up."""
    return F.round(value, scale).cast(f"decimal(18,{scale})")


def ratio(a: Column, b: Column) -> Column:
    """a / b to four places, null where b is zero."""
    return half_even(F.try_divide(amount(a), amount(b)), 4)


def total(value: Column) -> Column:
    """A sum that stays an amount (long-backed)."""
    return F.sum(value).cast(AMOUNT)


def parsed_money(text: Column) -> Column:
    """'1,234.50' or '(1,234.50)', the brackets for a negative amount; null if it is neither."""
    body = F.trim(text)
    negative = body.startswith("(") & body.endswith(")")
    number = F.regexp_replace(body, r"[(),\s]", "").try_cast(AMOUNT)
    return F.when(negative, -number).otherwise(number)
