"""Package inventory: duplicates, coverage, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.operators.cashflow import missing_months

# Kinds that every package needs
CORE_KINDS = ["audited_financials", "bank_statement", "ssm_registration", "tax_return"]


def document_ids(files: DataFrame) -> DataFrame:
    """Ids without collisions: the second, third... file of a base id gets __2, __3 in upload order."""
    n = F.row_number().over(Window.partitionBy("application_id", "base_id").orderBy("upload_ord"))
    return files.withColumn("_n", n).withColumn("document_id", F.when(F.col("_n") > 1, F.concat("base_id", F.lit("__"), "_n")).otherwise(F.col("base_id"))).drop("_n")


def processing_status(documents: DataFrame) -> DataFrame:
    """parse_failed, ocr_required, indexed (unstructured kinds), extracted, or failed."""
    structured = F.col("kind").isin(*CORE_KINDS)
    status = F.when(F.col("parse_error"), "parse_failed").when(F.col("needs_ocr"), "ocr_required").when(F.col("rejected"), "failed")
    return documents.withColumn("status", status.when(structured, "extracted").when(F.col("kind") != "unknown", "indexed").otherwise("failed"))


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """Later uploads with a digest that the package has already; the first upload is the original."""
    w = Window.partitionBy("application_id", "sha256").orderBy("upload_ord")
    rows = documents.where("sha256 <> ''").withColumns({"_n": F.row_number().over(w), "original": F.first("document_id").over(w)})
    return rows.where("_n > 1").select("application_id", "document_id", "original", "upload_ord")


def missing_kinds(documents: DataFrame) -> DataFrame:
    """Core kinds that no document of the package has, failed ones included."""
    seen = documents.groupBy("application_id").agg(F.collect_set("kind").alias("_k"))
    return seen.select("application_id", F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(k) for k in CORE_KINDS]), "_k")), ",").alias("missing"))


def package_inventory(documents: DataFrame, statements: DataFrame, years: DataFrame) -> DataFrame:
    """One row per package: documents, pages, how many were read, missing kinds and bank months, financial years, duplicates, complete.

    statements: (application_id, period_start) of its bank statements; years: (application_id, year)
    of its audited accounts. A package without statements has no missing months. It is complete if
    no month, no core kind and no document is missing, failed or there twice.
    """
    sums = documents.groupBy("application_id").agg(
        F.count("*").alias("document_count"),
        F.sum("page_count").alias("page_count"),
        F.count(F.when(F.col("status").isin("extracted", "indexed"), 1)).alias("read_count"),
        F.count(F.when(~F.col("status").isin("extracted", "indexed"), 1)).alias("failed_count"),
    )
    joined = lambda rows, column, name: rows.groupBy("application_id").agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias(name))
    twice = duplicate_documents(documents).groupBy("application_id").agg(F.count("*").alias("duplicate_count"))
    out = sums.join(missing_kinds(documents), "application_id").join(twice, "application_id", "left").fillna(0, ["duplicate_count"])
    out = out.join(joined(missing_months(statements), "month", "missing_months"), "application_id", "left").join(joined(years, "year", "financial_years"), "application_id", "left").fillna("", ["missing_months", "financial_years"])
    return out.withColumn("complete", (F.col("missing_months") == "") & (F.col("missing") == "") & (F.col("duplicate_count") == 0) & (F.col("failed_count") == 0))


def by_kind(documents: DataFrame) -> DataFrame:
    return documents.groupBy("application_id", "kind").agg(F.count("*").alias("n"))


def bank_coverage(statements: DataFrame) -> DataFrame:
    """Months in which each account's statements start."""
    month = F.date_format("period_start", "yyyy-MM")
    return statements.groupBy("application_id", "account_number").agg(F.array_join(F.array_sort(F.collect_set(month)), ",").alias("months"))


def account_rollup(statements: DataFrame) -> DataFrame:
    """Per account: statements, earliest start and latest end with their documents (the smallest id on ties)."""
    return statements.groupBy("application_id", "account_number").agg(
        F.count("*").alias("statement_count"),
        F.min("period_start").alias("earliest_start"),
        F.max("period_end").alias("latest_end"),
        F.min(F.struct("period_start", "document_id"))["document_id"].alias("earliest_document"),
        F.min(F.struct(-F.datediff("period_end", F.lit("1970-01-01").cast("date")), "document_id"))["document_id"].alias("latest_document"),
    )


def package_findings(inventory: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(application_id, finding_ord, code, severity, message, detail): what an inventory shows, all warnings, in a fixed order.

    Each duplicate (by its place among the uploads, upload_ord, if there), missing bank months,
    missing core documents, failures.
    """
    order = F.col("upload_ord") if "upload_ord" in duplicates.columns else F.col("document_id")
    nth = F.row_number().over(Window.partitionBy("application_id").orderBy(order)).cast("long")
    spaced = lambda c: F.replace(c, F.lit(","), F.lit(", "))

    def rows(found: DataFrame, place: Column, code: str, message: Column, detail: Column) -> DataFrame:
        return found.select("application_id", place.alias("finding_ord"), F.lit(code).alias("code"), F.lit("warning").alias("severity"), message.alias("message"), detail.alias("detail"))

    last = lambda n: F.lit((1 << 40) + n)
    twice = rows(duplicates, nth, "DUPLICATE_DOCUMENT", F.concat(F.lit("Document "), "document_id", F.lit(" duplicates another uploaded PDF.")), F.col("document_id"))
    months = rows(inventory.where("missing_months <> ''"), last(1), "MISSING_BANK_MONTHS", F.concat(F.lit("Missing bank coverage for: "), spaced("missing_months")), spaced("missing_months"))
    kinds = rows(inventory.where("missing <> ''"), last(2), "MISSING_CORE_DOCUMENTS", F.concat(F.lit("Missing core document types: "), spaced("missing")), spaced("missing"))
    failed = rows(inventory.where("failed_count > 0"), last(3), "DOCUMENT_EXTRACTION_FAILURES", F.concat("failed_count", F.lit(" document(s) could not be extracted or indexed.")), F.col("failed_count").cast("string"))
    return twice.unionByName(months).unionByName(kinds).unionByName(failed)


def all_failed(inventory: DataFrame) -> DataFrame:
    return inventory.select("application_id", (F.col("read_count") == 0).alias("all_failed"))
