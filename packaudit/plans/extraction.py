"""Queries over kinds, labels, units and directors in page texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from packaudit.operators import chunks, extraction
from packaudit.plans import packages, texts, views  # noqa: F401  texts adds SQL views
from packaudit.plans.sql_views import VIEWS, oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = oracle(sql)
        return f

    return add


_FIRST = ["Statement of Account", "Account Number 12, Statement Period 2025", "Management Accounts", "Cash Flow Forecast", "Facility Statement RM'000", "Form C in RM thousand", "Form 9", "Audited by: X, RM 000", "Account Number only", "nothing", "Suruhanjaya Syarikat Malaysia"]
_LATER = ["Balance Sheet", "Chargeable Income of Form C", "Audited by: Y, financial year ended 2025", "Incorporation, Form 9", "RM’000", "plain", "plain"]
_QUOTED = {name: ", ".join("'" + x.replace("'", "''") + "'" for x in part) for name, part in (("first", _FIRST), ("later", _LATER))}
VIEWS["f_page_texts"] = f"""SELECT application_id, document_id, page, page % 3 AS row_ord, CASE WHEN page = 1 THEN [{_QUOTED["first"]}][CAST(document_id AS BIGINT) % 11 + 1] WHEN page = 3 AND CAST(document_id AS BIGINT) % 2 = 0 THEN [{_QUOTED["later"]}][CAST(document_id AS BIGINT) % 7 + 1] ELSE 'line' END || ' ' || text AS text FROM f_chunks"""
_PERSON = "page || '. Person ' || length(text) || ' - NRIC: 9' || document_id || ' - Role: ' || CASE WHEN page % 2 = 0 THEN 'Director' ELSE 'Chair of ' || application_id END"
VIEWS["f_rows"] = f"""SELECT document_id, page, page % 3 AS row_ord, CASE page % 6 WHEN 2 THEN ' Directors: below' WHEN 3 THEN {_PERSON} WHEN 4 THEN 'Company Name: Firm ' || page || ' of ' || document_id WHEN 5 THEN 'Name: ' || length(text) WHEN 1 THEN {_PERSON} ELSE text END AS text FROM f_chunks"""


def page_texts(spark, d):
    def part(names):
        return F.array(*[F.lit(x) for x in names])

    doc, page = F.col("document_id").cast("long"), F.col("page")
    head = F.when(page == 1, F.element_at(part(_FIRST), (doc % 11 + 1).cast("int"))).when((page == 3) & (doc % 2 == 0), F.element_at(part(_LATER), (doc % 7 + 1).cast("int"))).otherwise("line")
    return chunks.page_chunks(views.documents(spark, d)).select("application_id", "document_id", "page", (page % 3).alias("row_ord"), F.concat(head, F.lit(" "), "text").alias("text"))


def rows(spark, d):
    page = F.col("page")
    role = F.when(page % 2 == 0, "Director").otherwise(F.concat(F.lit("Chair of "), "application_id"))
    person = F.concat(page, F.lit(". Person "), F.length("text"), F.lit(" - NRIC: 9"), "document_id", F.lit(" - Role: "), role)
    k = page % 6
    text = (
        F.when(k == 2, " Directors: below")
        .when(k.isin(1, 3), person)
        .when(k == 4, F.concat(F.lit("Company Name: Firm "), page, F.lit(" of "), "document_id"))
        .when(k == 5, F.concat(F.lit("Name: "), F.length("text")))
        .otherwise(F.col("text"))
    )
    return chunks.page_chunks(views.documents(spark, d)).select("document_id", "page", (page % 3).alias("row_ord"), text.alias("text"))


@query("""SELECT document_id, CASE WHEN s THEN 'ssm_registration' WHEN t THEN 'tax_return' WHEN a THEN 'audited_financials' WHEN b THEN 'bank_statement' WHEN m THEN 'management_accounts' WHEN c THEN 'cash_flow_forecast' WHEN f THEN 'facility_statement' ELSE 'unknown' END AS kind FROM (
    SELECT document_id, bool_or(contains(u, 'SURUHANJAYA SYARIKAT MALAYSIA') OR contains(u, 'FORM 9') AND contains(u, 'INCORPORATION')) AS s, bool_or(contains(u, 'LEMBAGA HASIL DALAM NEGERI') OR contains(u, 'FORM C') AND contains(u, 'CHARGEABLE INCOME')) AS t,
    bool_or(contains(u, 'INCOME STATEMENT') OR contains(u, 'BALANCE SHEET') OR contains(u, 'AUDITED BY:') AND contains(u, 'FINANCIAL YEAR ENDED')) AS a, bool_or(first AND (contains(u, 'STATEMENT OF ACCOUNT') OR contains(u, 'ACCOUNT NUMBER') AND contains(u, 'STATEMENT PERIOD'))) AS b,
    bool_or(first AND contains(u, 'MANAGEMENT ACCOUNTS')) AS m, bool_or(first AND contains(u, 'CASH FLOW FORECAST')) AS c, bool_or(first AND contains(u, 'FACILITY STATEMENT')) AS f
    FROM (SELECT document_id, upper(text) AS u, page = min(page) OVER (PARTITION BY document_id) AS first FROM f_page_texts) GROUP BY 1)""")
def p3_document_kind(spark, d):
    return extraction.document_kinds(page_texts(spark, d))


@query("""SELECT document_id, label, trim(substr(t, length(label) + 1)) AS value FROM (SELECT document_id, page, row_ord, trim(text) AS t, unnest(['Company Name:', 'Name:', 'Directors:']) AS label FROM f_rows) WHERE starts_with(t, label)
    QUALIFY row_number() OVER (PARTITION BY document_id, label ORDER BY page, row_ord) = 1""")
def p8_labels(spark, d):
    return extraction.labelled(rows(spark, d), ["Company Name:", "Name:", "Directors:"])


@query(r"""SELECT document_id, CASE WHEN bool_or(regexp_matches(text, '(?i)\bRM\s*(?:[''\x{2019}]\s*000|THOUSANDS?)\b')) THEN 1000 ELSE 1 END AS multiplier FROM f_page_texts GROUP BY 1""")
def p10_unit_multiplier(spark, d):
    return extraction.unit_multiplier(page_texts(spark, d))


@query(r"""SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page, row_ord) - 1 AS INT) AS row_index, trim(regexp_extract(t, p, 1)) AS name, trim(regexp_extract(t, p, 2)) AS nric, trim(regexp_extract(t, p, 3)) AS role FROM (
    SELECT document_id, page, row_ord, trim(text) AS t, '^\d+\.\s+(.+?)\s+-\s+NRIC:\s*(\S+)\s+-\s+Role:\s*(.+)$' AS p, max(CAST(starts_with(trim(text), 'Directors:') AS INT)) OVER (PARTITION BY document_id ORDER BY page, row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM f_rows)
    WHERE inside = 1 AND regexp_matches(t, '^\d+\.\s+(.+?)\s+-\s+NRIC:\s*(\S+)\s+-\s+Role:\s*(.+)$')""")
def p12_directors(spark, d):
    return extraction.directors(rows(spark, d))


@query("SELECT document_id, chunk_id FROM (SELECT document_id, document_id || ':summary:0' AS chunk_id FROM f_docs WHERE kind = 'tax_return') WHERE chunk_id IN (SELECT document_id || ':summary:0' FROM f_status WHERE status = 'extracted')")
def j15_tax_evidence(spark, d):
    """Summaries of documents that were extracted can be cited."""
    citable = packages.with_status(spark, d).where("status = 'extracted'").select(F.concat("document_id", F.lit(":summary:0")).alias("chunk_id"))
    return extraction.tax_evidence(views.documents(spark, d).where("kind = 'tax_return'"), citable).select("document_id", "chunk_id")
