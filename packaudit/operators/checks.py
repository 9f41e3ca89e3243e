"""Checks on single documents; each returns finding rows. Amounts may differ by a cent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.functions.money import AMOUNT, CENT


def finding(code: str, severity: str, *citations: Column) -> list[Column]:
    return ["application_id", "document_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.array(*citations).alias("citations")]


def summary_id(document: str = "document_id") -> Column:
    return F.concat(document, F.lit(":summary:0"))


def row_id(index: str | Column = "row_index") -> Column:
    return F.concat("document_id", F.lit(":transaction:"), index)


def balance_arithmetic(statements: DataFrame) -> DataFrame:
    """opening + credits - debits isn't the closing balance."""
    gap = F.abs(F.col("opening") + F.col("total_credits") - F.col("total_debits") - F.col("closing"))
    return statements.where(gap > F.lit(CENT)).select(*finding("BALANCE_ARITHMETIC", "critical", summary_id()))


def running_balance(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """A row's balance doesn't follow from the balance declared before it (the opening for the first row)."""
    w = Window.partitionBy("document_id").orderBy("row_index")
    before = F.coalesce(F.lag("balance").over(w), F.col("opening"))
    expected = before + F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    return (
        rows.join(statements.select("document_id", "opening"), "document_id")
        .withColumn("_gap", F.abs(expected - F.col("balance")))
        .where(F.col("_gap") > F.lit(CENT))
        .select(*finding("RUNNING_BALANCE", "critical", row_id()), "row_index")
    )


def date_outside_period(rows: DataFrame, statements: DataFrame) -> DataFrame:
    head = statements.select("document_id", F.col("period_start").alias("_from"), F.col("period_end").alias("_to"))
    return (
        rows.join(head, "document_id").where(~F.col("txn_date").between(F.col("_from"), F.col("_to"))).select(*finding("DATE_OUTSIDE_PERIOD", "warning", row_id()), "row_index")
    )


def date_out_of_order(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("row_index")
    return rows.withColumn("_before", F.lag("txn_date").over(w)).where("txn_date < _before").select(*finding("DATE_OUT_OF_ORDER", "warning", row_id()), "row_index")


def of_rows(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """running_balance(), date_outside_period() and date_out_of_order() in one pass over the rows; statements has each document once."""
    w = Window.partitionBy("document_id").orderBy("row_index")
    head = statements.select("document_id", "opening", F.col("period_start").alias("_from"), F.col("period_end").alias("_to"), F.lit(True).alias("_has"))
    at = rows.withColumns({"_last": F.lag("balance").over(w), "_before": F.lag("txn_date").over(w)}).join(head, "document_id", "left")
    gap = F.abs(F.coalesce("_last", "opening") + F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0)) - F.col("balance"))
    found = [
        (F.col("_has") & (gap > F.lit(CENT)), "RUNNING_BALANCE", "critical"),
        (F.col("_has") & ~F.col("txn_date").between(F.col("_from"), F.col("_to")), "DATE_OUTSIDE_PERIOD", "warning"),
        (F.col("txn_date") < F.col("_before"), "DATE_OUT_OF_ORDER", "warning"),
    ]
    each = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for holds, code, severity in found]))
    return at.select("application_id", "document_id", "row_index", F.explode(each).alias("_f")).select("application_id", "document_id", "_f.*", F.array(row_id()).alias("citations"))


def possible_duplicate(rows: DataFrame) -> DataFrame:
    """Neighbours in date order with the same text and amounts, a day apart at most; both rows are cited."""
    w = Window.partitionBy("document_id", "description", "debit", "credit").orderBy("txn_date", "row_index")
    return (
        rows.withColumns({"_d": F.lag("txn_date").over(w), "_r": F.lag("row_index").over(w)})
        .where(F.datediff("txn_date", "_d") <= 1)
        .select(*finding("POSSIBLE_DUPLICATE", "info", row_id("_r"), row_id()), "row_index")
    )


def accounting_equation(periods: DataFrame) -> DataFrame:
    """Assets are not liabilities plus equity, in any period."""
    gap = F.abs(F.col("total_assets") - F.col("total_liabilities") - F.col("total_equity"))
    return periods.where(gap > F.lit(CENT)).select(
        *finding("AUDITED_ACCOUNTING_EQUATION", "critical", F.concat("document_id", F.lit(":period:"), "period_index")), "period_index"
    )


def display_reconciliation(metrics: DataFrame) -> DataFrame:
    """Movement, difference and mismatch in whole cents from texts; what is no number counts as a mismatch."""

    def whole(name: str) -> Column:
        return F.round(F.col(name).try_cast("double") * 100).cast("long")

    movement = whole("total_credits") - whole("total_debits")
    difference = whole("net_change") - movement
    return metrics.withColumns(
        {
            "movement": (movement.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(AMOUNT),
            "difference": (difference.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(AMOUNT),
            "mismatch": F.coalesce(difference != 0, F.lit(True)),
        }
    )


def upload_verdict(files: DataFrame, most: int = 50, bytes_: int = 100 * 1024 * 1024) -> DataFrame:
    """Per application the first rule that its files break, or null: none, too_many, not_pdf, empty_file, too_large."""
    sums = files.groupBy("application_id").agg(
        F.count("*").alias("n_files"),
        F.sum("size").alias("n_bytes"),
        F.bool_or(~F.lower("filename").endswith(".pdf")).alias("_other"),
        F.bool_or(F.col("size") == 0).alias("_empty"),
    )
    verdict = F.when(F.col("n_files") < 1, "none").when(F.col("n_files") > most, "too_many").when(F.col("_other"), "not_pdf")
    return sums.select("application_id", "n_files", "n_bytes", verdict.when(F.col("_empty"), "empty_file").when(F.col("n_bytes") > bytes_, "too_large").alias("problem"))


def period_guard(statements: DataFrame) -> DataFrame:
    """Statements that end before they start."""
    return statements.where("period_end < period_start").select("application_id", "document_id", F.lit("period ends before it starts").alias("reason"))


def statement_metrics(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Per statement: days, counts, net change, daily flows, largest amounts, spread of balances."""
    per = rows.groupBy("document_id").agg(
        F.count("*").alias("transaction_count"),
        F.count("credit").alias("deposit_count"),
        F.count("debit").alias("withdrawal_count"),
        F.coalesce(F.max("credit"), F.lit(0).cast(AMOUNT)).alias("largest_credit"),
        F.coalesce(F.max("debit"), F.lit(0).cast(AMOUNT)).alias("largest_debit"),
        F.round(F.stddev_pop(F.col("balance").cast("double")), 4).alias("balance_spread"),
    )
    days = F.datediff("period_end", "period_start") + 1
    return (
        statements.where("period_end >= period_start")
        .join(per, "document_id", "left")
        .select(
            "application_id",
            "document_id",
            days.cast("long").alias("days"),
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("transaction_count", "deposit_count", "withdrawal_count")],
            (F.col("total_credits") - F.col("total_debits")).cast(AMOUNT).alias("net_change"),
            F.bround(F.col("total_credits") / days, 2).cast(AMOUNT).alias("daily_inflow"),
            F.bround(F.col("total_debits") / days, 2).cast(AMOUNT).alias("daily_outflow"),
            *[F.coalesce(c, F.lit(0)).cast(AMOUNT).alias(c) for c in ("largest_credit", "largest_debit")],
            F.col("closing").alias("closing_balance"),
            F.coalesce("balance_spread", F.lit(0.0)).alias("balance_spread"),
        )
    )
