"""The engine's input tables, derived from general business tables.

Each function takes (spark, sf_dir). Orders, events, line items and documents stand in for
ledgers, statements, accounts and uploaded files, keyed by application_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packaudit.functions.money import AMOUNT, cents, total


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str, whole: bool = False, at_once: int | None = None) -> DataFrame:
    """Ledger rows: a statement is a user's week, or with whole a user's account with amounts in full units.

    With at_once documents are dealt so that a task has about that many rows, however large the table.
    """
    week = F.date_trunc("week", "ts").cast("date")
    doc = F.concat(F.lit("acct/"), F.col("user_id")) if whole else F.concat(F.lit("stmt/"), F.col("user_id"), F.lit("-"), week.cast("string"))
    value = F.floor("value").cast(AMOUNT) if whole else cents(F.col("value"))
    credit = F.col("event_type").isin("purchase", "signup")
    order = Window.partitionBy("document_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("app"), F.col("user_id") % 10).alias("application_id"),
        doc.alias("document_id"),
        "user_id",
        "event_id",
        "ts",
        F.col("event_type").alias("description"),
        F.when(credit, value).alias("credit"),
        F.when(~credit, value).alias("debit"),
        F.date_add(F.to_date("ts"), F.when(F.col("event_id") % 211 == 0, -10).otherwise(0)).alias("txn_date"),
        week.alias("period_start"),
        F.date_add(week, 6).alias("period_end"),
    )
    if at_once:
        rows = rows.repartition(rows.count() // at_once + 1, "document_id")
    running = F.sum(F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))).over(order)
    return rows.withColumn("row_index", F.row_number().over(order) - 1).withColumn(
        "balance", (1000 + running + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).cast(AMOUNT)
    )


def statement_sums() -> list[Column]:
    """total_credits and total_debits of a statement's ledger rows."""
    return [F.coalesce(total(F.col(side)), F.lit(0)).cast(AMOUNT).alias(f"total_{side}s") for side in ("credit", "debit")]


def statement_ends(user: Column) -> list[Column]:
    """opening and closing of a statement with its sums."""
    closing = 1000 + F.col("total_credits") - F.col("total_debits") + F.when(user % 13 == 0, 5).otherwise(0)
    return [F.lit(1000).cast(AMOUNT).alias("opening"), closing.cast(AMOUNT).alias("closing")]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header per weekly statement; some closings are wrong by 5, some statements come twice."""
    user = F.col("user_id")
    suffix = F.element_at(F.array(F.lit(" SDN BHD"), F.lit(" S/B"), F.lit(" Sdn. Bhd."), F.lit(" TRADING")), (user % 4 + 1).cast("int"))
    head = (
        ledger(spark, sf_dir)
        .groupBy("application_id", "document_id", "user_id", "period_start", "period_end")
        .agg(*statement_sums())
        .select(
            "application_id",
            "document_id",
            "user_id",
            user.cast("string").alias("account_number"),
            F.concat(F.lit("CUSTOMER "), user, suffix).alias("account_holder"),
            "period_start",
            "period_end",
            *statement_ends(user),
            "total_credits",
            "total_debits",
        )
    )
    again = head.where("user_id % 29 = 0").withColumn("document_id", F.concat("document_id", F.lit("__2")))
    return head.unionByName(again)


def monthly_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by month: package = region, account = nation."""
    month = F.trunc("o_orderdate", "MM")
    price = cents(F.col("o_totalprice"))
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_regionkey", "n_nationkey", month.alias("period_start"))
        .agg(
            F.coalesce(total(F.when(F.col("o_orderstatus").isin("F", "O"), price)), F.lit(0)).cast(AMOUNT).alias("total_credits"),
            F.coalesce(total(F.when(F.col("o_orderstatus") == "P", price)), F.lit(0)).cast(AMOUNT).alias("total_debits"),
        )
        .select(
            F.concat(F.lit("region/"), "n_regionkey").alias("application_id"),
            F.concat(F.lit("bank/"), "n_nationkey", F.lit("/"), F.date_format("period_start", "yyyy-MM")).alias("document_id"),
            F.col("n_nationkey").cast("string").alias("account_number"),
            "period_start",
            F.last_day("period_start").alias("period_end"),
            F.lit(0).cast(AMOUNT).alias("opening"),
            (F.col("total_credits") - F.col("total_debits")).cast(AMOUNT).alias("closing"),
            "total_credits",
            "total_debits",
        )
    )


PERIOD_LINES = ["revenue", "cost_of_sales", "operating_expenses", "interest_expense", "current_assets", "current_liabilities", "non_current_liabilities", "total_equity"]


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts by supplier and year of shipment."""
    price = cents(F.col("l_extendedprice"))
    net = cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    cost = cents(F.col("l_quantity") * F.col("p_retailprice") * 1.2)
    interest = cents(F.col("l_extendedprice") * F.col("l_tax"))

    def part(value, condition=None):
        return F.coalesce(total(value if condition is None else F.when(condition, value)), F.lit(0)).cast(AMOUNT)

    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"))
        .agg(
            part(net).alias("revenue"),
            part(cost).alias("cost_of_sales"),
            part(price, flag == "R").alias("operating_expenses"),
            part(interest).alias("interest_expense"),
            part(price, status == "O").alias("current_assets"),
            part(price, status == "F").alias("current_liabilities"),
            part(price, flag == "A").alias("non_current_liabilities"),
            part(price, flag == "N").alias("total_equity"),
        )
        .select(
            F.concat(F.lit("supplier/"), "l_suppkey").alias("application_id"),
            F.concat(F.lit("fs/"), "l_suppkey", F.lit("/"), "year").alias("document_id"),
            "l_suppkey",
            F.col("year").cast("int").alias("year"),
            *PERIOD_LINES,
        )
        .withColumn("ebit", (F.col("revenue") - F.col("cost_of_sales") - F.col("operating_expenses")).cast(AMOUNT))
        .withColumn("net_profit", ((F.col("ebit") - F.col("interest_expense")) * F.lit(1)).cast(AMOUNT))
    )


KINDS = ["bank_statement", "ssm_registration", "audited_financials", "tax_return", "management_accounts", "debtor_ageing", "facility_letter", "unknown"]


def documents(spark: SparkSession, sf_dir: str, package: str = "source") -> DataFrame:
    """Uploaded files: package = source (or lang), kind from the number, digest of the text."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.floor(F.col("doc_id") / 20) % 8 + 1).cast("int"))
    third = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 3 == 0
    return table(spark, sf_dir, "documents").select(
        F.col(package).alias("application_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("doc_id").alias("upload_ord"),
        F.when((kind == "tax_return") & third, "unknown").otherwise(kind).alias("kind"),
        F.sha2("text", 256).alias("sha256"),
        (F.size(F.split("text", "\n"))).cast("long").alias("page_count"),
        (F.length("text") < 40).alias("needs_ocr"),
        "text",
    )
