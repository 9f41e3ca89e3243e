"""Banded ratios of the newest period, and derived lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.functions.money import AMOUNT, RATIO, half_up, ratio


def _band(value: Column, *limits: str, low: bool = False) -> Column:
    """healthy, acceptable, stretched at the limits, else distressed; null gives insufficient_data."""
    out = F.when(value.isNull(), "insufficient_data")
    for limit, name in zip(limits, ("healthy", "acceptable", "stretched"), strict=True):
        at = F.lit(limit).cast(RATIO)
        out = out.when(value <= at if low else value >= at, name)
    return out.otherwise("distressed")


def ratio_set(periods: DataFrame) -> DataFrame:
    """(application_id, document_id, year, name, value, band) of five ratios.

    Without interest there is nothing to cover, which is healthy. Debt service is never known.
    Negative equity makes debt to equity read healthy, as defined.
    """
    c = F.col
    liabilities = (c("current_liabilities") + c("non_current_liabilities")).cast(AMOUNT)
    values = {
        "current_ratio": ratio(c("current_assets"), c("current_liabilities")),
        "debt_to_equity": ratio(liabilities, c("total_equity")),
        "net_profit_margin": ratio(c("net_profit"), c("revenue")),
        "interest_coverage": ratio(c("ebit"), c("interest_expense")),
        "debt_service": F.lit(None).cast(RATIO),
    }
    bands = {
        "current_ratio": _band(c("v_current_ratio"), "1.5", "1.0", "0.75"),
        "debt_to_equity": _band(c("v_debt_to_equity"), "1", "2", "3", low=True),
        "net_profit_margin": _band(c("v_net_profit_margin"), "0.10", "0.05", "0"),
        "interest_coverage": F.when(c("interest_expense") == 0, "healthy").otherwise(_band(c("v_interest_coverage"), "4", "2", "1.5")),
        "debt_service": F.lit("insufficient_data"),
    }
    made = periods.withColumns({f"v_{n}": v for n, v in values.items()})
    rows = F.array(*[F.struct(F.lit(n).alias("name"), c(f"v_{n}").alias("value"), bands[n].alias("band")) for n in values])
    return made.select("application_id", "document_id", "year", F.explode(rows).alias("_r")).select("application_id", "document_id", "year", "_r.*")


INPUTS = ["current_assets", "current_liabilities", "non_current_liabilities", "total_equity", "net_profit", "revenue", "ebit", "interest_expense"]


def newest_ratios(periods: DataFrame) -> DataFrame:
    """ratio_set() of each application's newest period, with the lines that it comes from as text."""
    last = periods.withColumn("_n", F.row_number().over(Window.partitionBy("application_id").orderBy(F.desc("year")))).where("_n = 1").drop("_n")
    inputs = last.select("application_id", F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in INPUTS]).alias("inputs"))
    return ratio_set(last).join(inputs, "application_id")


def derived_lines(periods: DataFrame, tax_rate: str = "0.24") -> DataFrame:
    """Gross profit, EBIT, profit before tax, tax, net profit and the balance-sheet totals."""
    c = F.col
    before = (c("revenue") - c("cost_of_sales") - c("operating_expenses") - c("interest_expense")).cast(AMOUNT)
    made = periods.withColumn("profit_before_tax", before)
    tax = half_up(F.greatest(c("profit_before_tax"), F.lit(0).cast(AMOUNT)) * F.lit(tax_rate).cast("decimal(3,2)"))
    return made.select(
        "application_id",
        "document_id",
        "year",
        (c("revenue") - c("cost_of_sales")).cast(AMOUNT).alias("gross_profit"),
        (c("revenue") - c("cost_of_sales") - c("operating_expenses")).cast(AMOUNT).alias("ebit"),
        "profit_before_tax",
        tax.alias("tax"),
        (c("profit_before_tax") - tax).cast(AMOUNT).alias("net_profit"),
        (c("current_liabilities") + c("non_current_liabilities")).cast(AMOUNT).alias("total_liabilities"),
    )
