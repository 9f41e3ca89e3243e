"""Queries over uploaded documents, inventories, jobs, traces and surveys, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from packaudit.operators import history, inventory
from packaudit.plans import finance, views  # noqa: F401  finance adds SQL views
from packaudit.plans.shared import FRAMES, shared
from packaudit.plans.sql_views import VIEWS, oracle

FRAMES["f_docs"] = views.documents
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = oracle(sql)
        return f

    return add


def with_status(spark, d, package="source"):
    n, tidy = F.col("upload_ord"), F.coalesce(F.regexp_extract("application_id", r"(\d+)", 1).try_cast("int") % 5 == 1, F.lit(False))
    docs = views.documents(spark, d, package).withColumns({"parse_error": (n % 37 == 0) & ~tidy, "rejected": (n % 31 == 0) & ~tidy, "kind": F.when(tidy & (F.col("kind") == "unknown"), "tax_return").otherwise(F.col("kind"))})
    return inventory.processing_status(docs).drop("text")


_STATUS = """CASE WHEN upload_ord % 37 = 0 AND NOT tidy THEN 'parse_failed' WHEN needs_ocr THEN 'ocr_required' WHEN upload_ord % 31 = 0 AND NOT tidy THEN 'failed'
    WHEN kind IN ('audited_financials', 'bank_statement', 'ssm_registration', 'tax_return') THEN 'extracted' WHEN kind <> 'unknown' THEN 'indexed' ELSE 'failed' END"""
_TIDY = "(SELECT * REPLACE (CASE WHEN tidy AND kind = 'unknown' THEN 'tax_return' ELSE kind END AS kind) FROM (SELECT *, coalesce(TRY_CAST(regexp_extract(application_id, '(\\d+)', 1) AS INT) % 5 = 1, false) AS tidy FROM {0}))"
VIEWS["f_status"] = f"SELECT * EXCLUDE (tidy), {_STATUS} AS status FROM {_TIDY.format('f_docs')}"
VIEWS["f_status_lang"] = f"SELECT * EXCLUDE (tidy), {_STATUS} AS status FROM {_TIDY.format('f_docs_lang')}"


@query("""SELECT application_id, upload_ord, base_id || CASE WHEN n > 1 THEN '__' || n ELSE '' END AS document_id FROM (
    SELECT *, row_number() OVER (PARTITION BY application_id, base_id ORDER BY upload_ord) AS n FROM (SELECT *, application_id || '/' || kind AS base_id FROM f_docs))""")
def p1_document_ids(spark, d):
    files = views.documents(spark, d).withColumn("base_id", F.concat("application_id", F.lit("/"), "kind"))
    return inventory.document_ids(files).select("application_id", "upload_ord", "document_id")


@query("SELECT application_id, document_id, needs_ocr FROM f_docs")
def p2_ocr_flag(spark, d):
    """Pages with fewer than 40 characters in their spans need optical recognition."""
    spans = views.documents(spark, d).withColumn("spans", F.split("text", "(?<= )"))
    chars = F.aggregate(F.transform("spans", lambda s: F.length(s)), F.lit(0), lambda a, x: a + x)
    return spans.select("application_id", "document_id", (chars < 40).alias("needs_ocr"))


@query("SELECT application_id, document_id, status FROM f_status")
def p19_processing_status(spark, d):
    return with_status(spark, d).select("application_id", "document_id", "status")


_DUP = "(SELECT application_id, document_id, first_value(document_id) OVER w AS original, row_number() OVER w AS n FROM f_docs_lang WINDOW w AS (PARTITION BY application_id, sha256 ORDER BY upload_ord))"


@query(f"SELECT application_id, document_id, original FROM {_DUP} WHERE n > 1")
def w4_duplicate_documents(spark, d):
    return inventory.duplicate_documents(views.documents(spark, d, "lang")).drop("upload_ord")


VIEWS["f_kinds"] = """SELECT application_id, coalesce(string_agg(k, ',' ORDER BY k) FILTER (WHERE NOT have), '') AS missing FROM (SELECT a.application_id, k, (a.application_id, k) IN (SELECT (application_id, kind) FROM f_docs) AS have
    FROM (SELECT DISTINCT application_id FROM f_docs) a CROSS JOIN (SELECT unnest(['audited_financials', 'bank_statement', 'ssm_registration', 'tax_return']) AS k)) GROUP BY 1"""


@query("SELECT * FROM f_kinds")
def r9_missing_core_kinds(spark, d):
    return inventory.missing_kinds(views.documents(spark, d))


statements = shared(
    "f_doc_stmt",
    """SELECT application_id, document_id, m.month AS period_start FROM (SELECT *, upload_ord - upload_ord AS zero, CAST(regexp_replace(application_id, '^[^0-9]*', '') AS INT) AS number FROM f_docs WHERE kind = 'bank_statement') AS s
    JOIN (VALUES (0, 1, DATE '2024-01-01'), (0, 2, DATE '2024-02-01'), (0, 3, DATE '2024-03-01'), (0, 4, DATE '2024-04-01'), (0, 5, DATE '2024-05-01'), (0, 6, DATE '2024-06-01'), (0, 7, DATE '2024-07-01'), (0, 8, DATE '2024-08-01'), (0, 9, DATE '2024-09-01'), (0, 10, DATE '2024-10-01'), (0, 11, DATE '2024-11-01'), (0, 12, DATE '2024-12-01'), (0, 0, DATE '2023-06-01')) AS m(zero, n, month) ON s.zero = m.zero
    WHERE s.number % 2 = 1 OR (m.n + upload_ord) % 5 < 3""",
)
years = shared("f_doc_year", "SELECT application_id, document_id, CAST(2020 + upload_ord % 4 AS INT) AS year FROM f_docs WHERE kind = 'audited_financials'")


def inventory_of(spark, d):
    return inventory.package_inventory(with_status(spark, d), statements(spark, d), years(spark, d))


VIEWS["f_kinds_tidy"] = VIEWS["f_kinds"].replace("f_docs", "f_status")
VIEWS["f_doc_gap"] = """SELECT application_id, string_agg(m, ',' ORDER BY m) AS missing_months FROM (SELECT application_id, strftime(make_date(y, unnest(range(1, 13)), 1), '%Y-%m') AS m FROM (SELECT application_id, max(year(period_start)) AS y FROM f_doc_stmt GROUP BY 1))
    WHERE (application_id, m) NOT IN (SELECT (application_id, strftime(period_start, '%Y-%m')) FROM f_doc_stmt) GROUP BY 1"""
VIEWS["f_inventory"] = """SELECT *, missing_months = '' AND missing = '' AND duplicate_count = 0 AND failed_count = 0 AS complete FROM (
    SELECT application_id, document_count, page_count, read_count, failed_count, missing, coalesce(n, 0) AS duplicate_count, coalesce(missing_months, '') AS missing_months, coalesce(financial_years, '') AS financial_years FROM (
    SELECT application_id, count(*) AS document_count, CAST(sum(page_count) AS BIGINT) AS page_count, count(*) FILTER (WHERE status IN ('extracted', 'indexed')) AS read_count, count(*) FILTER (WHERE status NOT IN ('extracted', 'indexed')) AS failed_count FROM f_status GROUP BY 1)
    JOIN f_kinds_tidy USING (application_id) LEFT JOIN (SELECT application_id, count(*) AS n FROM (SELECT application_id, row_number() OVER (PARTITION BY application_id, sha256 ORDER BY upload_ord) AS r FROM f_docs) WHERE r > 1 GROUP BY 1) USING (application_id)
    LEFT JOIN f_doc_gap USING (application_id) LEFT JOIN (SELECT application_id, string_agg(DISTINCT year, ',' ORDER BY year) AS financial_years FROM f_doc_year GROUP BY 1) USING (application_id))"""


@query("SELECT * FROM f_inventory")
def a5_package_inventory(spark, d):
    return inventory_of(spark, d)


@query("SELECT application_id, kind, count(*) AS n FROM f_docs GROUP BY ALL")
def a6_documents_by_kind(spark, d):
    return inventory.by_kind(views.documents(spark, d))


@query("SELECT application_id, complete FROM f_inventory")
def a23_complete_flag(spark, d):
    return inventory_of(spark, d).select("application_id", "complete")


@query("SELECT application_id, read_count = 0 AS all_failed FROM f_inventory")
def r12_all_failed(spark, d):
    return inventory.all_failed(inventory_of(spark, d))


@query("SELECT application_id, account_number, string_agg(DISTINCT strftime(period_start, '%Y-%m'), ',' ORDER BY strftime(period_start, '%Y-%m')) AS months FROM f_stmt_m GROUP BY ALL")
def a7_bank_coverage(spark, d):
    return inventory.bank_coverage(views.monthly_statements(spark, d))


@query("""SELECT application_id, account_number, count(*) AS statement_count, min(period_start) AS earliest_start, max(period_end) AS latest_end,
    first(document_id ORDER BY period_start, document_id) AS earliest_document, first(document_id ORDER BY period_end DESC, document_id) AS latest_document FROM f_stmt GROUP BY ALL""")
def a8_account_rollup(spark, d):
    return inventory.account_rollup(views.statements(spark, d))


R8_SQL = """SELECT application_id, CAST(row_number() OVER (PARTITION BY application_id ORDER BY upload_ord) AS BIGINT) AS finding_ord, 'DUPLICATE_DOCUMENT' AS code, 'warning' AS severity, 'Document ' || document_id || ' duplicates another uploaded PDF.' AS message, document_id AS detail
    FROM (SELECT *, row_number() OVER (PARTITION BY application_id, sha256 ORDER BY upload_ord) AS r FROM f_docs) WHERE r > 1
    UNION ALL SELECT application_id, 1099511627777, 'MISSING_BANK_MONTHS', 'warning', 'Missing bank coverage for: ' || replace(missing_months, ',', ', '), replace(missing_months, ',', ', ') FROM f_inventory WHERE missing_months <> ''
    UNION ALL SELECT application_id, 1099511627778, 'MISSING_CORE_DOCUMENTS', 'warning', 'Missing core document types: ' || replace(missing, ',', ', '), replace(missing, ',', ', ') FROM f_inventory WHERE missing <> ''
    UNION ALL SELECT application_id, 1099511627779, 'DOCUMENT_EXTRACTION_FAILURES', 'warning', failed_count || ' document(s) could not be extracted or indexed.', CAST(failed_count AS VARCHAR) FROM f_inventory WHERE failed_count > 0"""
VIEWS["f_package_finding"] = R8_SQL


@query("SELECT * FROM f_package_finding")
def r8_package_findings(spark, d):
    return inventory.package_findings(inventory_of(spark, d), inventory.duplicate_documents(with_status(spark, d)))


def jobs(spark, d):
    """Events as job states: job = user, progress from the value."""
    return views.table(spark, d, "events").select(
        F.col("user_id").alias("job_id"),
        "event_id",
        "ts",
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("running").alias("status"),
        (F.floor("value") % 101).cast("int").alias("progress"),
    )


VIEWS["f_jobs"] = """SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'running' END AS status, CAST(CAST(floor(value) AS BIGINT) % 101 AS INT) AS progress FROM events"""


@query("SELECT job_id, event_id, status, progress FROM f_jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) = 1")
def s10_job_state(spark, d):
    return history.latest_state(jobs(spark, d), "job_id", "event_id").select("job_id", "event_id", "status", "progress")


@query("SELECT job_id, event_id, status, max(CASE WHEN status <> 'failed' THEN progress END) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown_progress FROM f_jobs")
def w14_monotone_progress(spark, d):
    return history.monotone_progress(jobs(spark, d), "job_id", ["ts", "event_id"]).select("job_id", "event_id", "status", "shown_progress")


@query("SELECT event_id, job_id, status FROM f_jobs ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def w15_latest_runs_page(spark, d):
    """The third page of the newest runs: offset and limit are the feature."""
    return history.page(jobs(spark, d), [F.desc("ts"), F.desc("event_id")], 100, 50).select("event_id", "job_id", "status")


@query("SELECT job_id, event_id, status, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous_status FROM f_jobs")
def w16_case_timeline(spark, d):
    return history.timeline(jobs(spark, d), "job_id", ["ts", "event_id"]).select("job_id", "event_id", "status", "previous_status")


A15_SQL = """SELECT run_id, node, n AS steps, round(m, 4) AS p50_ms, round(CASE WHEN n = 1 THEN x[1] ELSE x[j] + (x[j + 1] - x[j]) * (19 * (n + 1) - 20 * j) / 20 END, 4) AS p95_ms FROM (
    SELECT *, greatest(1, least(CAST(floor(19 * (n + 1) / 20) AS INT), n - 1)) AS j FROM (SELECT user_id AS run_id, event_type AS node, count(*) AS n, median(value) AS m, list(value ORDER BY value) AS x FROM events GROUP BY ALL))"""


@query(A15_SQL)
def a15_latency(spark, d):
    return history.latency(views.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("node"), F.col("value").alias("ms")))


@query("SELECT run_id, sum(us) AS total_us FROM (SELECT user_id AS run_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS us FROM events) GROUP BY 1")
def a21_stage_durations(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts"))
    return views.table(spark, d, "events").select(F.col("user_id").alias("run_id"), step.alias("us")).groupBy("run_id").agg(F.sum("us").alias("total_us"))


def survey(spark, d):
    u = F.col("user_id")
    answer = lambda q: F.when(q % 2 == 0, 3 + (u + q) % 3).otherwise(1 + (u * q) % (1 + u % 5)).cast("int")
    return views.table(spark, d, "events").select("user_id").distinct().select(u.alias("participant_id"), F.transform(F.sequence(F.lit(0), F.lit(9)), answer).alias("answers"))


VIEWS["f_survey"] = """SELECT participant_id, CAST(sum(CASE WHEN q % 2 = 0 THEN a - 1 ELSE 5 - a END) * 2.5 AS DOUBLE) AS score FROM (SELECT participant_id, q, CASE WHEN q % 2 = 0 THEN 3 + (participant_id + q) % 3 ELSE 1 + (participant_id * q) % (1 + participant_id % 5) END AS a
    FROM (SELECT DISTINCT user_id AS participant_id, unnest(range(10)) AS q FROM events)) GROUP BY 1"""
_BAND = "CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'OK' ELSE 'Poor' END"


@query(f"SELECT participant_id, score, {_BAND} AS band FROM f_survey")
def a16_survey_score(spark, d):
    s = history.survey_score(survey(spark, d)).withColumn("score", F.col("score").cast("double"))
    return s.select("participant_id", "score", "band")


@query(f"SELECT {_BAND} AS band, count(*) AS n, round(avg(score), 4) AS mean, median(score) AS median, round(coalesce(stddev_samp(score), 0), 4) AS deviation, min(score) AS lowest, max(score) AS highest, avg(score) > 70 AS good_verdict FROM f_survey GROUP BY 1")
def a17_survey_statistics(spark, d):
    s = history.survey_score(survey(spark, d)).withColumn("score", F.col("score").cast("double"))
    return s.groupBy("band").agg(
        F.count("*").alias("n"),
        F.round(F.avg("score"), 4).alias("mean"),
        F.median("score").alias("median"),
        F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 4).alias("deviation"),
        F.min("score").alias("lowest"),
        F.max("score").alias("highest"),
        (F.avg("score") > 70).alias("good_verdict"),
    )


@query("""SELECT doc_id, round(CASE WHEN na = 0 THEN CASE WHEN ne = 0 THEN 1 ELSE 0 END ELSE hits / na END, 6) AS precision, round(CASE WHEN ne = 0 THEN CASE WHEN na = 0 THEN 1 ELSE 0 END ELSE hits / ne END, 6) AS recall FROM (
    SELECT doc_id, CAST(quality = 0 AS INT) + CAST(toxic = 1 AS INT) AS ne, CAST(n_chars < 600 AS INT) + CAST(doc_id % 9 = 0 AS INT) AS na, CAST(quality = 0 AND n_chars < 600 AS INT) + CAST(toxic = 1 AND doc_id % 9 = 0 AS INT) AS hits FROM documents JOIN labels USING (doc_id))""")
def a11_precision_recall(spark, d):
    both = views.table(spark, d, "documents").join(views.table(spark, d, "labels"), "doc_id")

    def codes(low, toxic):
        return F.array_compact(F.array(F.when(low, "LOW_QUALITY"), F.when(toxic, "TOXIC")))

    rows = both.select("doc_id", codes(F.col("quality") == 0, F.col("toxic") == 1).alias("expected"), codes(F.col("n_chars") < 600, F.col("doc_id") % 9 == 0).alias("actual"))
    return history.precision_recall(rows).select("doc_id", "precision", "recall")
