"""Queries over records, links, ratings and similarity, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from packaudit.functions.money import cents
from packaudit.operators import chunks, records
from packaudit.plans import texts, views  # noqa: F401  texts adds SQL views
from packaudit.plans.shared import shared
from packaudit.plans.sql_views import VIEWS, money, oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = oracle(sql)
        return f

    return add


def history(spark, d):
    e = F.col("event_id")
    return views.table(spark, d, "events").select(
        e.cast("string").alias("id"),
        "event_id",
        F.col("event_type").alias("category"),
        F.when(e % 3 == 0, "open").when(e % 3 == 1, "done").otherwise("failed").alias("status"),
        F.col("props").alias("details"),
        F.when(e % 5 == 0, (e - 3).cast("string")).when(e % 7 == 0, F.concat(F.lit("app"), F.col("user_id"), F.lit("-"), e - 10)).otherwise("").alias("related_id"),
        F.concat(F.lit("app"), F.col("user_id"), F.lit("-"), e).alias("application_id"),
        F.col("ts").alias("created_at"),
    )


VIEWS["f_history"] = """SELECT CAST(event_id AS VARCHAR) AS id, event_id, event_type AS category, CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'done' ELSE 'failed' END AS status, props AS details,
    CASE WHEN event_id % 5 = 0 THEN CAST(event_id - 3 AS VARCHAR) WHEN event_id % 7 = 0 THEN 'app' || user_id || '-' || (event_id - 10) ELSE '' END AS related_id, 'app' || user_id || '-' || event_id AS application_id, ts AS created_at FROM events"""


@query("SELECT id, status FROM f_history WHERE category = 'error' AND contains(lower(concat_ws(' ', details, status)), '\"k\": 7')")
def f10_history_filter(spark, d):
    return records.matching(history(spark, d), ["details", "status"], '"K": 7', "error").select("id", "status")


entries = shared(
    "f_entry",
    """SELECT CAST(event_id AS STRING) AS id, CASE event_type WHEN 'error' THEN 'bug' WHEN 'view' THEN 'note' WHEN 'click' THEN 'other' ELSE 'test' END AS category,
    CASE WHEN value < 15 THEN 'open' WHEN value < 30 THEN 'passed' WHEN value < 60 THEN 'recorded' WHEN value < 90 THEN 'not_run' ELSE 'resolved' END AS status, CASE WHEN length(props) % 3 = 0 THEN '  ' WHEN value > 200 THEN NULL ELSE props END AS title FROM events""",
)


@query("SELECT id, coalesce(trim(title) <> '', false) AND coalesce(CASE category WHEN 'test' THEN status IN ('not_run', 'passed', 'failed') WHEN 'bug' THEN status IN ('open', 'resolved') WHEN 'note' THEN status = 'recorded' END, false) AS compatible FROM f_entry")
def f11_compatibility(spark, d):
    return records.compatible(entries(spark, d)).select("id", "compatible")


@query("SELECT id FROM f_history WHERE contains(lower(application_id), 'app12')")
def f12_case_search(spark, d):
    return records.matching(history(spark, d), ["application_id"], "APP12").select("id")


@query("""SELECT DISTINCT a.id, b.id AS linked FROM f_history a JOIN f_history b ON b.related_id = a.id WHERE a.id <> b.id AND trim(b.related_id) <> ''
    UNION SELECT DISTINCT a.id, b.id FROM f_history a JOIN f_history b ON b.related_id = a.application_id WHERE a.id <> b.id AND trim(b.related_id) <> ''""")
def j12_linked_follow_ups(spark, d):
    return records.follow_ups(history(spark, d))


@query("""SELECT case_id, run_id, link_id FROM (SELECT user_id AS case_id, event_id // 3 AS run_id, event_id AS link_id FROM events) WHERE run_id IN (SELECT event_id FROM events WHERE event_type <> 'error' AND event_id % 4 <> 0)
    QUALIFY row_number() OVER (PARTITION BY case_id, run_id ORDER BY link_id) = 1""")
def j13_case_runs(spark, d):
    events = views.table(spark, d, "events")
    links = events.select(F.col("user_id").alias("case_id"), F.floor(F.col("event_id") / 3).alias("run_id"), F.col("event_id").alias("link_id"))
    runs = events.select(F.col("event_id").alias("run_id"), F.when(F.col("event_type") != "error", "analysis").otherwise("other").alias("category"), (F.col("event_id") % 4 != 0).alias("has_result"))
    return records.case_runs(links, runs)[0].select("case_id", "run_id", "link_id")


VIEWS["f_j14"] = "SELECT document_id, row_index, balance AS expected, CASE WHEN user_id % 9 <> 0 OR row_index > 0 THEN CAST(balance + CASE WHEN event_id % 23 = 0 THEN 0.02 ELSE 0 END AS DECIMAL(18,2)) END AS actual FROM f_txn"
J14_SQL = """SELECT document_id, coalesce(matched, 0) AS matched, coalesce(compared, 0) AS compared, CASE WHEN coalesce(compared, 0) = 0 THEN 1.0 ELSE round(matched / compared, 6) END AS accuracy, n = m AS same_length FROM (SELECT document_id, count(expected) AS n, count(actual) AS m FROM f_j14 GROUP BY 1)
    LEFT JOIN (SELECT e.document_id, count(*) AS compared, count(*) FILTER (WHERE abs(e.expected - a.actual) <= 0.01) AS matched FROM f_j14 e JOIN f_j14 a ON e.document_id = a.document_id AND e.row_index = a.row_index WHERE a.actual IS NOT NULL GROUP BY 1) USING (document_id)"""


@query(J14_SQL)
def j14_truth_alignment(spark, d):
    rows = views.ledger(spark, d)
    expected = rows.select("document_id", "row_index", F.col("balance").alias("value"))
    actual = rows.where("user_id % 9 <> 0 or row_index > 0").select("document_id", "row_index", (F.col("balance") + F.when(F.col("event_id") % 23 == 0, F.lit("0.02").cast("decimal(18,2)")).otherwise(0)).alias("value"))
    return records.aligned(expected, actual)


@query("SELECT application_id, document_id, text FROM f_chunks WHERE chunk_id = '40:page:2' AND application_id = 'src0'")
def j16_chunk_lookup(spark, d):
    """A point lookup: one chunk by id, inside its application."""
    found = chunks.page_chunks(views.documents(spark, d)).where((F.col("chunk_id") == "40:page:2") & (F.col("application_id") == "src0"))
    return found.select("application_id", "document_id", "text")


VIEWS["f_conc"] = """SELECT 'app' || user_id % 50 AS application_id, event_id || ':page:0' AS chunk_id, event_id, CASE WHEN user_id % 4 = 0 THEN 'tax_return' ELSE 'management_accounts' END AS kind,
    ['Customer concentration: ', 'Growth: ', 'SUPPLIER dependence of ', 'Supplier concentration reached '][event_id % 4 + 1] || event_id % 120 || CASE WHEN event_id % 5 = 0 THEN '.5' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ' %' ELSE '%' END AS line FROM events"""


R14_SQL = """SELECT application_id, string_agg(p, ',' ORDER BY CAST(p AS DOUBLE)) AS percentages, max(chunks) AS chunk_ids FROM (SELECT DISTINCT application_id, CAST(p AS VARCHAR) AS p FROM (SELECT application_id, CAST(unnest(regexp_extract_all(line, '(?:^|[^0-9])([0-9]{1,3}(?:\\.[0-9]+)?)\\s*%', 1)) AS DOUBLE) AS p FROM f_conc
    WHERE kind = 'management_accounts' AND regexp_matches(lower(line), 'customer concentration|supplier dependence|supplier concentration')) WHERE p >= 50)
    JOIN (SELECT application_id, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunks FROM f_conc WHERE kind = 'management_accounts' AND regexp_matches(lower(line), 'customer concentration|supplier dependence|supplier concentration') AND event_id % 120 + CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 0 END >= 50 GROUP BY 1) USING (application_id) GROUP BY 1"""
VIEWS["f_concentration"] = R14_SQL


@query("SELECT * FROM f_concentration")
def r14_concentration(spark, d):
    e = F.col("event_id")
    start = F.element_at(F.array(*[F.lit(x) for x in ("Customer concentration: ", "Growth: ", "SUPPLIER dependence of ", "Supplier concentration reached ")]), (e % 4 + 1).cast("int"))
    line = F.concat(start, e % 120, F.when(e % 5 == 0, ".5").otherwise(""), F.when(e % 3 == 0, " %").otherwise("%"))
    rows = views.table(spark, d, "events").select(
        F.concat(F.lit("app"), F.col("user_id") % 50).alias("application_id"),
        F.concat(e, F.lit(":page:0")).alias("chunk_id"),
        F.when(F.col("user_id") % 4 == 0, "tax_return").otherwise("management_accounts").alias("kind"),
        line.alias("text"),
    )
    return records.concentration(rows)


_VECTOR = "SELECT id, CAST(('0x' || substr(sha256(t), 1, 8)) AS UBIGINT) % 768 AS idx, CAST(sum(CASE WHEN CAST(('0x' || substr(sha256(t), 9, 2)) AS INT) % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS weight FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {0}) GROUP BY ALL HAVING weight <> 0"
VIEWS["f_vc"] = _VECTOR.format("(SELECT chunk_id AS id, text FROM f_chunks)")
VIEWS["f_vq"] = _VECTOR.format("(SELECT item_id AS id, text FROM benchmark)")


@query("""SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(dot / sqrt(nq * nc), 6) AS score FROM (SELECT q.id AS query_id, c.id AS chunk_id, sum(q.weight * c.weight) AS dot FROM f_vq q JOIN f_vc c ON q.idx = c.idx GROUP BY ALL HAVING dot > 0)
    JOIN (SELECT id AS query_id, sum(weight * weight) AS nq FROM f_vq GROUP BY 1) USING (query_id) JOIN (SELECT id AS chunk_id, sum(weight * weight) AS nc FROM f_vc GROUP BY 1) USING (chunk_id)) WHERE score >= 0.12
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 3""")
def v2_sparse_top_k(spark, d):
    queries = chunks.hashed_vectors(views.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    every = chunks.hashed(chunks.page_chunks(views.documents(spark, d)).select(F.col("chunk_id").alias("id"), "text"))
    return records.sparse_top(queries, every, 3, 0.12)


@query(f"SELECT o_orderkey AS id, {money('o_totalprice')} AS amount FROM orders")
def p9_money_parse(spark, d):
    """Amounts from texts such as 'RM 1,234.50'."""
    from packaudit.functions.money import parsed_money

    text = F.concat(F.lit("RM "), F.format_number(cents(F.col("o_totalprice")), 2))
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), parsed_money(F.regexp_extract(text, r"RM ([\d,.]+)", 1)).alias("amount"))
