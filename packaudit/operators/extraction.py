"""Kinds, labels, units and director lists from the text of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Amounts in thousands; a director's line
THOUSANDS = r"(?i)\bRM\s*(?:['’]\s*000|THOUSANDS?)\b"
DIRECTOR = r"^\d+\.\s+(.+?)\s+-\s+NRIC:\s*(\S+)\s+-\s+Role:\s*(.+)$"


def document_kinds(pages: DataFrame) -> DataFrame:
    """(document_id, kind) of pages (document_id, page, text): by keywords, in a fixed order of kinds.

    Registration, tax and audited accounts may show on any page, the others on the first only.
    """
    upper = F.upper("text")

    def has(*words: str) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & upper.contains(w)
        return out

    on_any = {
        "ssm_registration": has("SURUHANJAYA SYARIKAT MALAYSIA") | has("FORM 9", "INCORPORATION"),
        "tax_return": has("LEMBAGA HASIL DALAM NEGERI") | has("FORM C", "CHARGEABLE INCOME"),
        "audited_financials": has("INCOME STATEMENT") | has("BALANCE SHEET") | has("AUDITED BY:", "FINANCIAL YEAR ENDED"),
    }
    on_first = {
        "bank_statement": has("STATEMENT OF ACCOUNT") | has("ACCOUNT NUMBER", "STATEMENT PERIOD"),
        "management_accounts": has("MANAGEMENT ACCOUNTS"),
        "cash_flow_forecast": has("CASH FLOW FORECAST"),
        "facility_statement": has("FACILITY STATEMENT"),
    }
    flags = pages.select("document_id", "page", *[c.alias(k) for k, c in (on_any | on_first).items()])
    found = flags.groupBy("document_id").agg(*[F.bool_or(k).alias(k) for k in on_any], *[F.min_by(k, "page").alias(k) for k in on_first])
    return found.select("document_id", F.coalesce(*[F.when(F.col(k), k) for k in on_any | on_first], F.lit("unknown")).alias("kind"))


def labelled(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(document_id, label, value): what follows a label on the first row that begins with it. rows: (document_id, page, row_ord, text)."""
    lines = rows.select("document_id", "page", "row_ord", F.trim("text").alias("text"))
    hit = F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: F.col("text").startswith(x))
    hits = lines.withColumn("label", F.explode(hit))
    first = hits.groupBy("document_id", "label").agg(F.min_by("text", F.struct("page", "row_ord")).alias("text"))
    return first.select("document_id", "label", F.trim(F.expr("substring(text, length(label) + 1)")).alias("value"))


def unit_multiplier(pages: DataFrame) -> DataFrame:
    """(document_id, multiplier): 1000 where a page says that amounts are in thousands."""
    return pages.groupBy("document_id").agg(F.when(F.bool_or(F.col("text").rlike(THOUSANDS)), 1000).otherwise(1).alias("multiplier"))


def directors(rows: DataFrame) -> DataFrame:
    """(document_id, row_index, name, nric, role): numbered lines of the right form behind a `Directors:` row."""
    so_far = Window.partitionBy("document_id").orderBy("page", "row_ord").rowsBetween(Window.unboundedPreceding, -1)
    line = F.trim("text")
    behind = rows.withColumn("_in", F.max(line.startswith("Directors:")).over(so_far)).where(F.col("_in") & line.rlike(DIRECTOR) & ~line.startswith("Directors:"))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "row_ord")) - 1
    part = lambda k: F.trim(F.regexp_extract(line, DIRECTOR, k))
    return behind.select("document_id", index.alias("row_index"), part(1).alias("name"), part(2).alias("nric"), part(3).alias("role"))


def tax_evidence(taxes: DataFrame, citable: DataFrame) -> DataFrame:
    """Tax rows whose summary chunk can be cited."""
    return taxes.withColumn("chunk_id", F.concat("document_id", F.lit(":summary:0"))).join(citable.select("chunk_id").distinct(), "chunk_id", "left_semi")
