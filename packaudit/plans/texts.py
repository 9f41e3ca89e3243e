"""Queries over chunks, citations, positions and similarity, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from packaudit.operators import chunks
from packaudit.plans import views
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


VIEWS["f_chunks"] = """SELECT source AS application_id, CAST(doc_id AS VARCHAR) AS document_id, doc_id || ':page:' || i AS chunk_id, i AS page, line AS text FROM (
    SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(line) <> ''"""


@query("SELECT * FROM f_chunks")
def p17_page_chunks(spark, d):
    return chunks.page_chunks(views.documents(spark, d))


def chunk_sql(table: str, kind: str, chunk: str, index: str = "0", page: str = "1") -> str:
    """The same chunks in SQL, from the same template."""
    parts = re.split(r"\{(\w+)\}", chunks.TEXTS[kind, chunk])
    text = " || ".join(f"coalesce(CAST({p} AS VARCHAR), '-')" if i % 2 else f"'{p}'" for i, p in enumerate(parts) if p)
    return f"SELECT document_id || ':{chunk}:' || {index} AS chunk_id, document_id, '{chunk}' AS kind, CAST({page} AS BIGINT) AS page, {text} AS text FROM {table}"


SIDED = "(SELECT *, CASE WHEN credit IS NOT NULL THEN 'credit' ELSE 'debit' END AS side, coalesce(credit, debit) AS amount FROM f_txn)"


@query(chunk_sql(SIDED, "bank_statement", "transaction", "row_index"))
def p16_transaction_chunks(spark, d):
    return chunks.transaction_chunks(views.ledger(spark, d))


@query("SELECT chunk_id, CAST(CAST(('0x' || substr(sha1(chunk_id), 1, 16)) AS UBIGINT) & 9223372036854775807 AS BIGINT) AS point_id FROM f_chunks")
def p18_stable_id(spark, d):
    return chunks.page_chunks(views.documents(spark, d)).select("chunk_id", chunks.stable_id(F.col("chunk_id")).cast("long").alias("point_id"))


@query("SELECT document_id, string_agg(page, ',' ORDER BY page) AS pages, min(page) AS first_page FROM f_chunks GROUP BY 1")
def p15_page_attachment(spark, d):
    return chunks.page_attachment(chunks.page_chunks(views.documents(spark, d)))


@query(r"SELECT chunk_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normal FROM f_chunks")
def t9_whitespace(spark, d):
    return chunks.page_chunks(views.documents(spark, d)).select("chunk_id", chunks.normal_text(F.col("text")).alias("normal"))


@query("SELECT chunk_id, substr(text, 1, 200) AS text, length(text) > 200 AS truncated FROM f_chunks")
def t10_truncation(spark, d):
    return chunks.truncated(chunks.page_chunks(views.documents(spark, d)), 200).select("chunk_id", "text", "truncated")


VIEWS["f_summary"] = r"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Note [see [conv-' || conv_id || ':page:' || turn || '] and [] too: ' ELSE '' END || regexp_replace(text, '[\[\]\n]', ' ', 'g') || ' [conv-' || conv_id || ':page:' || CASE WHEN (conv_id * 8 + turn) % 7 = 0 THEN 999 ELSE turn END || ', critical; conv-' || conv_id || ':page:0].' AS body FROM conversations"""


def summaries(spark, d):
    turn = F.when((F.col("conv_id") * 8 + F.col("turn")) % 7 == 0, 999).otherwise(F.col("turn"))
    clean = F.regexp_replace("text", r"[\[\]\n]", " ")
    nested = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Note [see [conv-"), "conv_id", F.lit(":page:"), "turn", F.lit("] and [] too: "))).otherwise("")
    body = F.concat(nested, clean, F.lit(" [conv-"), "conv_id", F.lit(":page:"), turn, F.lit(", critical; conv-"), "conv_id", F.lit(":page:0]."))
    return views.table(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))


VIEWS["f_cited"] = r"""SELECT conv_id, turn, trim(c) AS cited FROM (SELECT conv_id, turn, unnest(flatten([regexp_split_to_array(g, '[,;]') for g in regexp_extract_all(body, '\[([^\[\]]+)\]', 1)])) AS c FROM f_summary) WHERE trim(c) <> '' AND lower(trim(c)) NOT IN ('critical', 'warning', 'info')"""


@query("SELECT * FROM f_cited")
def t1_citations(spark, d):
    return summaries(spark, d).select("conv_id", "turn", F.explode(chunks.citations(F.col("body"))).alias("cited"))


@query("SELECT conv_id, turn, unnest(list_filter([trim(s) for s in regexp_extract_all(body, '[^.!?]*[.!?]|[^.!?]+$')], lambda s: s <> '')) AS sentence FROM f_summary")
def t2_sentences(spark, d):
    return summaries(spark, d).select("conv_id", "turn", F.explode(chunks.sentences(F.col("body"))).alias("sentence"))


def allowed(spark, d):
    return views.table(spark, d, "conversations").select(F.concat(F.lit("conv-"), "conv_id", F.lit(":page:"), "turn").alias("cited")).distinct()


VIEWS["f_allowed"] = "SELECT DISTINCT 'conv-' || conv_id || ':page:' || turn AS cited FROM conversations"


@query("SELECT conv_id, turn, cited FROM f_cited WHERE cited NOT IN (SELECT cited FROM f_allowed)")
def j9_invalid_citations(spark, d):
    return t1_citations(spark, d).join(allowed(spark, d), "cited", "left_anti").select("conv_id", "turn", "cited")


@query("SELECT DISTINCT cited FROM f_cited WHERE cited IN (SELECT cited FROM f_allowed)")
def j8_allow_list(spark, d):
    return t1_citations(spark, d).select("cited").distinct().join(allowed(spark, d), "cited", "left_semi")


VIEWS["f_said"] = r"SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN regexp_replace(text, '[\[\]\n]', ' ', 'g') ELSE body END AS body FROM f_summary JOIN conversations USING (conv_id, turn)"
_BRACKET = r"regexp_extract_all({0}, '\[([^\[\]]+)\]', 1)"
_HAS = "len(list_filter(flatten([regexp_split_to_array(g, '[,;]') for g in " + _BRACKET.format("s") + "]), lambda c: trim(c) <> '' AND lower(trim(c)) NOT IN ('critical', 'warning', 'info'))) > 0"


@query(f"""SELECT conv_id, coalesce(sentences, 0) AS sentences, coalesce(cited_sentences, 0) AS cited_sentences, coalesce(citations, 0) AS citations, coalesce(valid, 0) AS valid, coalesce(invalid, '') AS invalid, CASE WHEN coalesce(citations, 0) = 0 THEN 1.0 ELSE round(valid / citations, 6) END AS faithfulness,
    CASE WHEN coalesce(sentences, 0) = 0 THEN 1.0 ELSE round(cited_sentences / sentences, 6) END AS sentence_coverage FROM (SELECT DISTINCT conv_id FROM conversations)
    LEFT JOIN (SELECT conv_id, count(*) AS sentences, count(*) FILTER (WHERE {_HAS}) AS cited_sentences FROM (SELECT conv_id, unnest(list_filter([trim(s) for s in regexp_extract_all(body, '[^.!?]*[.!?]|[^.!?]+$')], lambda s: s <> '')) AS s FROM f_said) GROUP BY 1) USING (conv_id)
    LEFT JOIN (SELECT conv_id, count(*) AS citations, count(*) FILTER (WHERE ok) AS valid, string_agg(DISTINCT cited, ',' ORDER BY cited) FILTER (WHERE NOT ok) AS invalid FROM (SELECT conv_id, cited, cited IN (SELECT cited FROM f_allowed) AS ok FROM f_cited WHERE conv_id % 5 <> 0) GROUP BY 1) USING (conv_id)""")
def a14_faithfulness(spark, d):
    """Each conversation's summary; of every fifth only the words, so nothing is cited."""
    said = summaries(spark, d).join(views.table(spark, d, "conversations"), ["conv_id", "turn"])
    return chunks.faithfulness(said.select("conv_id", F.when(F.col("conv_id") % 5 == 0, F.regexp_replace("text", r"[\[\]\n]", " ")).otherwise(F.col("body")).alias("body")), allowed(spark, d))


VIEWS["f_span"] = """SELECT document_id, i, line, x, y FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(range(len(w))) AS i, unnest(w) AS line FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS w FROM documents))
    JOIN (SELECT 1) ON true, LATERAL (SELECT 40 + 60 * (i % 8) AS x, 30 * (i // 8) + 1.4 * (i % 3) AS y)"""


@query("SELECT document_id, bucket, count(*) AS spans, string_agg(line, ' ' ORDER BY x, i) AS text FROM (SELECT *, CAST(round_even(CAST(y AS DOUBLE) / 3.0, 0) * 3 AS INT) AS bucket FROM f_span) GROUP BY ALL")
def p5_row_buckets(spark, d):
    return chunks.row_buckets(chunks.word_spans(views.documents(spark, d)))


_TOKENS = "SELECT id, CAST(('0x' || substr(sha256(t), 1, 8)) AS UBIGINT) % 768 AS idx, CASE WHEN CAST(('0x' || substr(sha256(t), 9, 2)) AS INT) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {0})"
VIEWS["f_vec"] = f"SELECT id, CAST(idx AS INT) AS idx, CAST(sum(sign) AS BIGINT) AS weight FROM ({_TOKENS.format('(SELECT item_id AS id, text FROM benchmark)')}) GROUP BY ALL"


@query("SELECT id, idx, weight, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)), 6) AS value FROM f_vec WHERE weight <> 0")
def v1_feature_hashing(spark, d):
    return chunks.hashed_vectors(views.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
