"""Calendar allocation, package cash flow and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.functions.money import AMOUNT, half_up, total

FINGERPRINT = ["account_number", "period_start", "period_end", "opening", "closing", "total_credits", "total_debits"]


def unique_statements(statements: DataFrame) -> DataFrame:
    """The first statement (by document id) of each fingerprint in a package."""
    w = Window.partitionBy("application_id", *FINGERPRINT).orderBy("document_id")
    return statements.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def calendar_allocation(rows: DataFrame, amount: str, key: str = "document_id") -> DataFrame:
    """(all columns, month, allocated): an amount spread over its period's months by days.

    Months get cents, rounded half up; what is left goes to the last month.
    """
    days = F.datediff("period_end", "period_start") + 1
    spread = rows.where("period_end >= period_start").withColumn("_m", F.explode(F.expr("sequence(trunc(period_start, 'MM'), period_end, interval 1 month)")))
    overlap = F.datediff(F.least("period_end", F.last_day("_m")), F.greatest("period_start", F.col("_m"))) + 1
    share = half_up(F.col(amount) * overlap / days)
    own = Window.partitionBy(key)
    last = F.col("_m") == F.max("_m").over(own)
    given = F.sum(F.when(~last, F.col("_s")).otherwise(0)).over(own)
    spread = spread.withColumn("_s", share).withColumn("allocated", F.when(last, F.col(amount) - given).otherwise(F.col("_s")).cast(AMOUNT))
    return spread.withColumn("month", F.date_format("_m", "yyyy-MM")).drop("_m", "_s")


def monthly_amounts(statements: DataFrame) -> DataFrame:
    """(application_id, month, credits, debits) over unique statements."""
    unique = unique_statements(statements)
    both = [
        calendar_allocation(unique, f"total_{side}").select("application_id", "month", *[(F.col("allocated") if side == s else F.lit(0).cast(AMOUNT)).alias(s) for s in ("credits", "debits")])
        for side in ("credits", "debits")
    ]
    return both[0].unionByName(both[1]).groupBy("application_id", "month").agg(total(F.col("credits")).alias("credits"), total(F.col("debits")).alias("debits"))


def annualised_credits(monthly: DataFrame) -> DataFrame:
    """A year's credits times twelve over the months present."""
    year = F.substring("month", 1, 4).cast("int").alias("year")
    sums = monthly.groupBy("application_id", year).agg(total(F.col("credits")).alias("_c"), F.count("*").alias("months"))
    return sums.select("application_id", "year", "months", half_up(F.col("_c") * 12 / F.col("months")).alias("annualised_credits"))


def package_cash_flow(statements: DataFrame) -> DataFrame:
    unique = unique_statements(statements)
    heads = unique.groupBy("application_id").agg(
        F.count("*").alias("statement_count"),
        F.countDistinct("account_number").alias("account_count"),
        total(F.col("total_credits")).alias("total_credits"),
        total(F.col("total_debits")).alias("total_debits"),
        total(F.col("total_credits") - F.col("total_debits")).alias("net_change"),
    )
    months = monthly_amounts(statements).groupBy("application_id").agg(F.array_join(F.array_sort(F.collect_set("month")), ",").alias("covered_months"))
    return heads.join(months, "application_id", "left")


def weighted_allocation(rows: DataFrame, amount: str, weight: str, group: list[str], order: str) -> DataFrame:
    """An amount per group shared out by weight to cents; the last member takes the rest."""
    own = Window.partitionBy(*group)
    share = half_up(F.col(amount) * F.col(weight) / F.sum(weight).over(own))
    last = F.row_number().over(own.orderBy(F.desc(order))) == 1
    given = F.sum(F.when(~F.col("_last"), F.col("_s")).otherwise(0)).over(own)
    return rows.withColumns({"_s": share, "_last": last}).withColumn("allocated", F.when(F.col("_last"), F.col(amount) - given).otherwise(F.col("_s")).cast(AMOUNT)).drop("_s", "_last")


def even_sample(rows: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each group, evenly over its order with both ends (all rows where there are no more)."""
    own = Window.partitionBy(*group)
    ranked = rows.withColumns({"_i": F.row_number().over(own.orderBy(*order)) - 1, "_n": F.count("*").over(own)})
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda p: F.bround(p * (F.col("_n") - 1) / (k - 1), 0).cast("int"))
    return ranked.where((F.col("_n") <= k) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")


def latest_period(periods: DataFrame) -> DataFrame:
    """One period per package and year: that of the later accounts, of the later document, of the later line."""
    w = Window.partitionBy("application_id", "year").orderBy(F.desc("financial_year_end"), F.desc("document_id"), F.desc("period_index"))
    return periods.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def revenue_growth(periods: DataFrame) -> DataFrame:
    """Growth in percent over the year available before, where its revenue isn't zero."""
    w = Window.partitionBy("application_id").orderBy("year")
    before = F.lag("revenue").over(w)
    return periods.withColumn("_b", before).where("_b <> 0").select("application_id", "year", half_up((F.col("revenue") - F.col("_b")) * 100 / F.col("_b")).alias("growth_percent"))


def revenue_cagr(periods: DataFrame) -> DataFrame:
    """Compound growth in percent from the first to the last year, by calendar distance."""
    ends = periods.groupBy("application_id").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("revenue", "year").alias("_a"), F.max_by("revenue", "year").alias("_b")
    )
    years = F.col("last_year") - F.col("first_year")
    growth: Column = (F.pow(F.col("_b").cast("double") / F.col("_a").cast("double"), 1.0 / years) - 1) * 100
    return ends.where("last_year > first_year and _a > 0 and _b >= 0").select("application_id", "first_year", "last_year", F.round(growth, 2).alias("cagr_percent"))


def missing_months(statements: DataFrame) -> DataFrame:
    """Months of each package's latest year in which no account's statement starts."""
    start = statements.select("application_id", F.date_format("period_start", "yyyy-MM").alias("month"), F.year("period_start").alias("year"))
    latest = start.groupBy("application_id").agg(F.max("year").alias("year"))
    every = latest.withColumn("month", F.explode(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.format_string("%d-%02d", F.col("year"), m))))
    return every.join(start, ["application_id", "month"], "left_anti").select("application_id", "month")
