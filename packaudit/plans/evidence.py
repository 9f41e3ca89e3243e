"""Queries over citations, sources, evidence scope, readiness and workload scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from packaudit.operators import chunks, evidence, inventory
from packaudit.plans import packages, records, texts, views
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


VIEWS["f_segment"] = r"SELECT conv_id, turn, unnest(s) AS part, unnest(range(len(s))) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(body, '\[[^\[\]]+\]|[^\[\]]+|[\[\]]') AS s FROM f_summary)"


@query(r"""SELECT conv_id, turn, coalesce(body, '') AS body FROM (SELECT conv_id, turn FROM conversations) LEFT JOIN (SELECT conv_id, turn, string_agg(part, '' ORDER BY pos, n) AS body FROM (
    SELECT conv_id, turn, pos, 0 AS n, part FROM f_segment WHERE NOT regexp_matches(part, '^\[[^\[\]]+\]$')
    UNION ALL SELECT conv_id, turn, pos, n, '[' || c || ']' FROM (SELECT conv_id, turn, pos, trim(unnest(p)) AS c, unnest(range(len(p))) AS n FROM (SELECT *, regexp_split_to_array(substr(part, 2, length(part) - 2), '[,;]') AS p FROM f_segment WHERE regexp_matches(part, '^\[[^\[\]]+\]$')))
    WHERE c IN (SELECT cited FROM f_allowed)) GROUP BY ALL) USING (conv_id, turn)""")
def t3_valid_inline(spark, d):
    return evidence.valid_inline(texts.summaries(spark, d), texts.allowed(spark, d), ["conv_id", "turn"])


_WORDING = ["A critical warning was raised.", "Severity: critical for this account.", "A warning was raised.", "Cash is critically low; a flag is set.", "The system raised a critical system alert."]


@query(r"""SELECT conv_id, turn, conv_id % 3 <> 0 AND regexp_matches(t, '(?i)\bcritical\s+(?:(?:validation|system|risk)\s+)?(?:warning|finding|alert|flag|severity)\b|\b(?:severity|warning|finding|alert|flag)\s*(?:is|was|:|=|of)?\s*["'']?critical\b') AS unsupported
    FROM (SELECT conv_id, turn, text || ' ' || ['A critical warning was raised.', 'Severity: critical for this account.', 'A warning was raised.', 'Cash is critically low; a flag is set.', 'The system raised a critical system alert.'][(conv_id + turn) % 5 + 1] AS t FROM conversations)""")
def t6_unsupported_critical(spark, d):
    rows = views.table(spark, d, "conversations")
    wording = F.element_at(F.array(*[F.lit(w) for w in _WORDING]), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    text = F.concat("text", F.lit(" "), wording)
    return rows.select("conv_id", "turn", evidence.unsupported_critical(text, F.col("conv_id") % 3 == 0).alias("unsupported"))


@query("""SELECT cited, CASE WHEN filename IS NULL THEN regexp_replace(cited, ':[^:]*:[^:]*$', '') ELSE filename || ' · p. ' || page END AS title FROM (SELECT DISTINCT cited FROM f_cited)
    LEFT JOIN (SELECT DISTINCT 'conv-' || conv_id || ':page:' || turn AS cited, 'conv-' || conv_id || '.pdf' AS filename, turn AS page FROM conversations) USING (cited)""")
def t5_citation_titles(spark, d):
    return evidence.citation_titles(texts.t1_citations(spark, d).select("cited").distinct(), sources(spark, d))


def sources(spark, d):
    return (
        views.table(spark, d, "conversations")
        .select(
            F.concat(F.lit("conv-"), "conv_id", F.lit(":page:"), "turn").alias("cited"),
            F.concat(F.lit("conv-"), "conv_id", F.lit(".pdf")).alias("filename"),
            F.array(F.col("turn").cast("string")).alias("pages"),
        )
        .distinct()
    )


VIEWS["f_cited_at"] = r"""SELECT conv_id, turn, i, trim(c) AS cited FROM (SELECT conv_id, turn, unnest(l) AS c, unnest(range(len(l))) AS i FROM (SELECT conv_id, turn, list_filter(flatten([regexp_split_to_array(g, '[,;]') for g in regexp_extract_all(body, '\[([^\[\]]+)\]', 1)]), lambda c: trim(c) <> '' AND lower(trim(c)) NOT IN ('critical', 'warning', 'info')) AS l FROM f_summary))"""
VIEWS["f_first_seen"] = "SELECT conv_id, cited, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS INT) AS number FROM (SELECT conv_id, cited, min(turn * 100000 + i) AS pos FROM f_cited_at GROUP BY ALL)"


def cited_at(spark, d):
    return texts.summaries(spark, d).select("conv_id", "turn", F.posexplode(chunks.citations(F.col("body"))).alias("i", "cited"))


@query("SELECT * FROM f_first_seen")
def w13_first_seen(spark, d):
    return evidence.first_seen(cited_at(spark, d), "conv_id", ["turn", "i"])


@query("SELECT conv_id, string_agg(cited, ' ' ORDER BY number) AS cited FROM f_first_seen GROUP BY 1")
def o6_ordered_distinct(spark, d):
    return evidence.ordered_distinct(cited_at(spark, d), "conv_id", ["turn", "i"])


@query("SELECT event_type AS name, size, event_id, place FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS size, event_id, min(event_id) OVER w AS place, max(event_id) OVER w AS last FROM events WINDOW w AS (PARTITION BY event_type, CAST(floor(value) AS BIGINT))) WHERE event_id = last")
def o7_merged_files(spark, d):
    files = views.table(spark, d, "events").select(F.col("event_type").alias("name"), F.floor("value").alias("size"), "event_id")
    return evidence.merged_files(files, ["name", "size"], "event_id")


VIEWS["f_named"] = "SELECT *, application_id || '/' || document_id || '.pdf' AS filename FROM f_docs"


def named(spark, d):
    return views.documents(spark, d).withColumn("filename", F.concat("application_id", F.lit("/"), "document_id", F.lit(".pdf")))


@query("SELECT c.chunk_id, c.application_id, c.document_id, filename, kind, CAST(page AS VARCHAR) AS pages FROM f_chunks c JOIN f_named USING (document_id)")
def p20_enriched_chunks(spark, d):
    made = evidence.enriched(chunks.page_chunks(views.documents(spark, d)), named(spark, d))
    return made.select("chunk_id", "application_id", "document_id", "filename", "kind", "pages")


VIEWS["f_hits"] = """SELECT CASE WHEN page % 11 = 0 THEN chunk_id || 'x' ELSE chunk_id END AS chunk_id, document_id, CASE WHEN page % 7 = 0 THEN 'elsewhere' ELSE application_id END AS application_id, (page * 37 + length(text)) % 100 / 100.0::DOUBLE AS score, text FROM f_chunks"""
_WANTED = ["bank_statement", "audited_financials", "management_accounts", "debtor_ageing"]


def hits(spark, d):
    p = F.col("page")
    return chunks.page_chunks(views.documents(spark, d)).select(
        F.when(p % 11 == 0, F.concat("chunk_id", F.lit("x"))).otherwise(F.col("chunk_id")).alias("chunk_id"),
        "document_id",
        F.when(p % 7 == 0, "elsewhere").otherwise(F.col("application_id")).alias("application_id"),
        ((p * 37 + F.length("text")) % 100 / F.lit(100.0)).alias("score"),
        "text",
    )


VIEWS["f_scope"] = """SELECT h.*, d.kind, coalesce(h.application_id = d.application_id AND d.kind IN ('bank_statement', 'audited_financials', 'management_accounts', 'debtor_ageing') AND c.document_id = h.document_id AND h.score >= 0.12 AND trim(h.text) <> '', false) AS accepted
    FROM f_hits h LEFT JOIN f_docs d ON d.document_id = h.document_id LEFT JOIN f_chunks c ON c.chunk_id = h.chunk_id"""


@query("SELECT chunk_id, accepted FROM f_scope")
def j10_evidence_scope(spark, d):
    found = evidence.in_scope(hits(spark, d), views.documents(spark, d), chunks.page_chunks(views.documents(spark, d)), _WANTED, 0.12)
    return found.select("chunk_id", "accepted")


@query("SELECT cited, filename, pages[1] AS page FROM (SELECT DISTINCT 'conv-' || conv_id || ':page:' || turn AS cited, 'conv-' || conv_id || '.pdf' AS filename, [CAST(turn AS VARCHAR)] AS pages FROM conversations) WHERE cited IN (SELECT cited FROM f_cited WHERE turn % 2 = 0 UNION SELECT cited FROM f_cited WHERE conv_id % 5 = 0)")
def j11_cited_sources(spark, d):
    """Sources cited by the even turns or by every fifth conversation: two lists of ids."""
    cited = texts.t1_citations(spark, d)
    return evidence.cited_sources(sources(spark, d), cited.where("turn % 2 = 0"), cited.where("conv_id % 5 = 0")).select("cited", "filename", F.col("pages")[0].alias("page"))


@query("SELECT chunk_id, CASE WHEN kind = 'cash_flow_forecast' THEN 'forecast_not_actual' ELSE 'document_reported_not_independently_verified' END AS evidence_type FROM (SELECT chunk_id, CASE WHEN kind = 'facility_letter' THEN 'cash_flow_forecast' ELSE kind END AS kind FROM f_chunks JOIN f_docs USING (document_id))")
def v8_evidence_type(spark, d):
    kind = F.when(F.col("kind") == "facility_letter", "cash_flow_forecast").otherwise(F.col("kind"))
    rows = chunks.page_chunks(views.documents(spark, d)).join(views.documents(spark, d).select("document_id", "kind"), "document_id")
    return rows.select("chunk_id", evidence.evidence_type(kind).alias("evidence_type"))


@query("SELECT chunk_id, kind FROM f_chunks JOIN f_docs USING (document_id) WHERE kind NOT IN ('audited_financials', 'bank_statement', 'ssm_registration', 'tax_return')")
def v9_compact_evidence(spark, d):
    rows = chunks.page_chunks(views.documents(spark, d)).join(views.documents(spark, d).select("document_id", "kind"), "document_id")
    return evidence.compact(rows).select("chunk_id", "kind")


_LINES = sorted(views.PERIOD_LINES)
_ABSENT = ", ".join(f"CASE WHEN coalesce({c}, 0) = 0 THEN '{c}' END" for c in _LINES)


@query(f"SELECT document_id, array_to_string(list_filter([{_ABSENT}], lambda x: x IS NOT NULL), ',') AS missing, len(list_filter([{_ABSENT}], lambda x: x IS NOT NULL)) = 0 AS accepted FROM f_period")
def p13_completeness(spark, d):
    """Accounts in which a line of zero counts as not found."""
    rows = views.periods(spark, d).withColumns({c: F.nullif(F.col(c), F.lit(0).cast("decimal(18,2)")) for c in _LINES})
    return evidence.incomplete(rows, _LINES)


@query("SELECT document_id, bucket, min(x) AS x0, min(y) AS y0, max(x) + 50 AS x1, max(y) + 10 AS y1 FROM (SELECT document_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(round_even(CAST(y AS DOUBLE) / 3.0, 0) * 3 AS INT) AS bucket FROM f_span) GROUP BY ALL")
def p14_row_boxes(spark, d):
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    spans = chunks.word_spans(views.documents(spark, d)).select("document_id", (F.bround(y / 3.0, 0) * 3).cast("int").alias("bucket"), x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 10).alias("y1"))
    return evidence.boxes(spans, ["document_id", "bucket"])


_DETAILS = [
    "The package inventory does not contain this core document type. Confirm whether it is required and obtain it before relying on the assessment.",
    "Inspect extraction errors and re-upload readable source PDFs where necessary.",
    "Confirm whether the repeated PDFs are intentional before counting them as separate evidence.",
    "Debt-service coverage is unavailable for at least one period. Obtain the actual repayment schedule rather than estimating principal payments from liabilities.",
]


@query(f"""SELECT application_id, CAST(place AS INT) AS place, 'missing-' || k AS action, 'Request ' || CASE k {" ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in evidence.GUIDANCE.items())} END AS title, '{_DETAILS[0]}' AS detail, CASE k {" ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in evidence.GUIDANCE.items())} END AS dimensions
    FROM (SELECT application_id, unnest(string_split(missing, ',')) AS k, unnest(range(len(string_split(missing, ',')))) AS place FROM f_inventory WHERE missing <> '')
    UNION ALL SELECT application_id, 10, 'bank-coverage', 'Review ' || n || ' missing bank month' || CASE WHEN n = 1 THEN '' ELSE 's' END, 'No statement coverage was identified for ' || replace(missing_months, ',', ', ') || '. Request missing statements or confirm the review period.', 'Character,Capacity' FROM (SELECT *, len(string_split(missing_months, ',')) AS n FROM f_inventory WHERE missing_months <> '')
    UNION ALL SELECT application_id, 11, 'failed-documents', 'Resolve ' || failed_count || ' unprocessed document' || CASE WHEN failed_count = 1 THEN '' ELSE 's' END, '{_DETAILS[1]}', '' FROM f_inventory WHERE failed_count > 0
    UNION ALL SELECT application_id, 12, 'duplicates', 'Review ' || duplicate_count || ' duplicate upload' || CASE WHEN duplicate_count = 1 THEN '' ELSE 's' END, '{_DETAILS[2]}', '' FROM f_inventory WHERE duplicate_count > 0
    UNION ALL SELECT DISTINCT application_id, 13, 'repayment-schedule', 'Verify debt-service obligations', '{_DETAILS[3]}', 'Capacity' FROM f_status WHERE kind = 'audited_financials' AND status = 'extracted'""")
def r15_readiness(spark, d):
    """Debt service is never known, so each package with accounts that were read has to verify it."""
    read = packages.with_status(spark, d).where("kind = 'audited_financials' and status = 'extracted'").select("application_id", F.lit(None).cast("decimal(18,4)").alias("debt_service"))
    return evidence.readiness(packages.inventory_of(spark, d), read)


@query("SELECT task, count(*) AS participants, round(sum(CAST(completed AS INT)) / count(*), 4) AS rate FROM (SELECT event_type AS task, user_id, max(value) > 50 AS completed FROM events GROUP BY ALL) GROUP BY 1")
def a18_usability(spark, d):
    """A participant completes a task (kind of event) if one try goes beyond 50."""
    tries = views.table(spark, d, "events").groupBy(F.col("event_type").alias("task"), "user_id").agg((F.max("value") > 50).alias("completed"))
    return evidence.completion(tries)


@query("""SELECT count(*) AS queries, round(avg(hit), 6) AS recall_at_k, round(avg(n / 3), 6) AS precision_at_k, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM (SELECT user_id, max(CAST(good AND r <= 3 AS INT)) AS hit, sum(CAST(good AND r <= 3 AS INT)) AS n, min(CASE WHEN good THEN r END) AS first
    FROM (SELECT user_id, event_type = 'purchase' AS good, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) GROUP BY 1)""")
def a19_retrieval_quality(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return evidence.retrieval_quality(views.table(spark, d, "events").select(F.col("user_id").alias("query_id"), rank.alias("rank"), (F.col("event_type") == "purchase").alias("relevant")))


@query("""SELECT *, (SELECT count(*) FROM f_chunks) AS chunks FROM (SELECT count(*) AS documents, CAST(sum(page_count) AS BIGINT) AS pages, round(avg(CAST(status IN ('extracted', 'indexed') AS INT)), 6) AS success, count(*) FILTER (WHERE status NOT IN ('extracted', 'indexed')) AS errors FROM f_status)""")
def a20_workload(spark, d):
    return evidence.workload(packages.with_status(spark, d), chunks.page_chunks(views.documents(spark, d)))


@query("""SELECT application_id, coalesce(mc, sc) AS credits, coalesce(md, sd) AS debits FROM (SELECT application_id, CAST(sum(total_credits) AS DECIMAL(18,2)) AS sc, CAST(sum(total_debits) AS DECIMAL(18,2)) AS sd FROM f_stmt GROUP BY 1)
    FULL JOIN (SELECT application_id, CAST(sum(coalesce(credit, 0)) AS DECIMAL(18,2)) AS mc, CAST(sum(coalesce(debit, 0)) AS DECIMAL(18,2)) AS md FROM f_txn WHERE user_id % 10 < 6 GROUP BY 1) USING (application_id)""")
def a22_cash_totals(spark, d):
    """Packages with months (here: six of ten) use those, the others their statements."""
    rows = views.ledger(spark, d).where("user_id % 10 < 6")
    months = rows.groupBy("application_id", F.date_format("txn_date", "yyyy-MM").alias("month")).agg(F.sum(F.coalesce("credit", F.lit(0))).alias("credits"), F.sum(F.coalesce("debit", F.lit(0))).alias("debits"))
    return evidence.cash_totals(months, views.statements(spark, d))


SQL["a13_gates"] = oracle(
    f"""SELECT accuracy, accuracy >= 0.9 AS accurate, citations_valid, p95 < 180000 AS fast FROM (SELECT round(avg(accuracy), 6) AS accuracy FROM ({records.J14_SQL})), (SELECT count(*) = count(*) FILTER (WHERE cited IN (SELECT cited FROM f_allowed)) AS citations_valid FROM f_cited),
    (SELECT max(p95_ms) AS p95 FROM ({packages.A15_SQL}))"""
)


def a13_gates(spark, d):
    return evidence.gates(records.j14_truth_alignment(spark, d), texts.a14_faithfulness(spark, d), packages.a15_latency(spark, d))


QUERIES["a13_gates"] = a13_gates
