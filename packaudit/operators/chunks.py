"""Citable chunks, citations, row clustering of positioned words, and lexical vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_chunks(documents: DataFrame) -> DataFrame:
    """One chunk per page (paragraph) with text."""
    lines = documents.select("application_id", "document_id", F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return lines.where(F.trim("text") != "").select("application_id", "document_id", F.concat("document_id", F.lit(":page:"), "page").alias("chunk_id"), F.col("page").cast("long").alias("page"), "text")


# What a chunk says of a record, by kind of document and chunk
TEXTS = {
    ("bank_statement", "summary"): "Bank statement summary. Bank: {bank_name}. Account holder: {account_holder}. Account number: {account_number}. Period: {period_start} to {period_end}. Opening balance: {opening}. Closing balance: {closing}. Total credits: {total_credits}. Total debits: {total_debits}. Transactions: {transaction_count}.",
    ("bank_statement", "transaction"): "{txn_date} | {side} | RM {amount} | balance RM {balance} | {description}",
    ("ssm_registration", "summary"): "SSM registration. Company: {company_name} ({registration_number}). Type: {company_type}. Incorporated: {incorporation_date}. Paid-up capital: RM {paid_up_capital}. Address: {business_address}. Directors: {director_count}.",
    ("ssm_registration", "director"): "Director #{number}: {name}. NRIC/Passport: {nric}. Role: {role}.",
    ("audited_financials", "summary"): "Audited financials summary. Company: {company_name}. Auditor: {auditor}. FY end: {year_end}. Source display unit: {display_unit}; values normalized to RM using multiplier {multiplier}. Revenue (current): RM {revenue}. Net profit (current): RM {net_profit}. Total equity: RM {total_equity}. Periods reported: {period_count}.",
    ("audited_financials", "period"): "Period {period_end}: revenue RM {revenue}, gross profit RM {gross_profit}, EBIT RM {ebit}, net profit RM {net_profit}, current assets RM {current_assets}, current liabilities RM {current_liabilities}, total equity RM {total_equity}, cash from ops RM {cash_from_operations}.",
    ("tax_return", "summary"): "Tax return summary. Company: {company_name}. Tax reference: {tax_reference_number}. Year of assessment: {year_of_assessment}. Gross business income: RM {gross_business_income}. Chargeable income: RM {chargeable_income}. Tax payable: RM {tax_payable}.",
}


def said(kind: str, chunk: str) -> Column:
    """The text of a record: the template with its columns; a column without a value reads -."""
    parts = re.split(r"\{(\w+)\}", TEXTS[kind, chunk])
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("-")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def record_chunks(records: DataFrame, kind: str, chunk: str, index: Column | None = None, page: Column | None = None) -> DataFrame:
    """(chunk_id, document_id, kind, page, text) of records of one kind; index is their place in the document, 0 for summaries."""
    number = F.lit(0) if index is None else index
    return records.select(F.concat("document_id", F.lit(f":{chunk}:"), number.cast("string")).alias("chunk_id"), "document_id", F.lit(chunk).alias("kind"), (F.lit(1) if page is None else page).cast("long").alias("page"), said(kind, chunk).alias("text"))


def transaction_chunks(rows: DataFrame) -> DataFrame:
    credit = F.col("credit").isNotNull()
    sided = rows.withColumns({"side": F.when(credit, "credit").otherwise("debit"), "amount": F.coalesce("credit", "debit")})
    return record_chunks(sided, "bank_statement", "transaction", F.col("row_index"), F.col("page") if "page" in rows.columns else None)


def stable_id(text: Column) -> Column:
    """63 bits of the SHA-1: its first 8 bytes without the top bit."""
    digits = F.sha1(text)
    top = F.conv(F.conv(F.substring(digits, 1, 1), 16, 10).cast("int").bitwiseAND(7).cast("string"), 10, 16)
    return F.conv(F.concat(top, F.substring(digits, 2, 15)), 16, 10)


def page_attachment(chunks: DataFrame) -> DataFrame:
    pages = chunks.groupBy("document_id").agg(F.array_sort(F.collect_set("page")).alias("_p"))
    return pages.select("document_id", F.array_join(F.transform("_p", lambda p: p.cast("string")), ",").alias("pages"), F.array_min("_p").alias("first_page"))


def normal_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def truncated(chunks: DataFrame, n: int) -> DataFrame:
    return chunks.withColumn("truncated", F.length("text") > n).withColumn("text", F.substring("text", 1, n))


def citations(text: Column) -> Column:
    """Ids in square brackets, several to a bracket; blanks and severity words are none."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), 1)
    ids = F.flatten(F.transform(groups, lambda g: F.split(g, "[,;]")))
    return F.filter(F.transform(ids, lambda c: F.trim(c)), lambda c: (c != "") & ~F.lower(c).isin("critical", "warning", "info"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])"), lambda s: F.trim(s)), lambda s: s != "")


def faithfulness(bodies: DataFrame, allowed: DataFrame) -> DataFrame:
    """Per summary (conv_id, body; several rows of one are parts of it): citations, how many exist, the others, and shares.

    Without citations faithfulness is 1.0, without sentences coverage is.
    """
    said = F.transform(sentences(F.col("body")), lambda s: F.size(citations(s)) > 0)
    parts = bodies.groupBy("conv_id").agg(F.sum(F.size(said)).alias("sentences"), F.sum(F.size(F.filter(said, lambda x: x))).alias("cited_sentences"))
    cited = bodies.select("conv_id", F.explode(citations(F.col("body"))).alias("cited")).join(allowed.withColumn("_ok", F.lit(1)), "cited", "left")
    wrong = F.array_join(F.array_sort(F.collect_set(F.when(F.col("_ok").isNull(), F.col("cited")))), ",")
    sums = cited.groupBy("conv_id").agg(F.count("*").alias("citations"), F.count("_ok").alias("valid"), wrong.alias("invalid"))
    out = parts.join(sums, "conv_id", "left").fillna(0, ["citations", "valid"]).fillna("", ["invalid"])
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.round(F.col(a) / F.col(b), 6))
    return out.withColumns({"faithfulness": share("valid", "citations"), "sentence_coverage": share("cited_sentences", "sentences")})


def by_document(documents: DataFrame, at_once: int = 2_048) -> DataFrame:
    """documents dealt by document_id before their texts are taken apart, about `at_once` to a task.

    So the texts are shuffled once and their words not at all, and a task's memory doesn't grow with the table.
    """
    return documents.repartition(documents.count() // at_once + 1, "document_id")


def word_spans(documents: DataFrame) -> DataFrame:
    """Words with positions by arithmetic: eight to a line, midpoints off by up to 2.8 points."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    spans = by_document(documents.select("document_id", "text")).select("document_id", F.posexplode(words).alias("i", "line"))
    return spans.withColumns({"x": 40 + 60 * (F.col("i") % 8), "y": 30 * F.floor(F.col("i") / 8) + F.lit("1.4").cast("decimal(3,1)") * (F.col("i") % 3)})


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: s["line"]), " ")


def row_buckets(spans: DataFrame, height: float = 3.0) -> DataFrame:
    """Rows by fixed buckets of the midpoint."""
    bucket = (F.bround(F.col("y").cast("double") / height, 0) * 3).cast("int")
    rows = spans.groupBy("document_id", bucket.alias("bucket")).agg(F.count("*").alias("spans"), F.collect_list(F.struct("x", "i", "line")).alias("_s"))
    return rows.select("document_id", "bucket", "spans", _joined(F.col("_s")).alias("text"))


_WORD = re.compile("[a-z0-9]+")


class _Places(dict):
    """2 * place + 1 where the sign is plus, of each token that this task has met."""

    def __missing__(self, token: str) -> int:
        h = hashlib.sha256(token.encode()).digest()
        if len(self) >= 1 << 18:
            self.clear()
        self[token] = 2 * (int.from_bytes(h[:4]) % self.size) + h[4] % 2
        return self[token]


def hashed(texts: DataFrame, size: int = 768) -> DataFrame:
    """(id, places array of (idx, weight)) of each id with a token: tokens hashed to places, +1 where the fifth byte of the hash is odd, else -1.

    Texts are shuffled once, by id; those of one id are parts of it.
    """
    whole = texts.groupBy("id").agg(F.lower(F.array_join(F.collect_list("text"), "\n")).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Places()
        known.size = size
        for part in parts:
            for at in range(0, part.num_rows, _BLOCK):
                some = part.slice(at, _BLOCK)
                found = [[known[w] for w in _WORD.findall(t)] for t in some.column(1).to_pylist()]
                codes = np.fromiter((c for f in found for c in f), np.int64)
                owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
                sums = np.bincount(owner * size + codes // 2, codes % 2 * 2.0 - 1, len(found) * size).reshape(len(found), size)
                i, j = np.nonzero(sums)
                places = pa.StructArray.from_arrays([pa.array(j.astype(np.int32)), pa.array(sums[i, j].astype(np.int64))], ["idx", "weight"])
                starts = np.searchsorted(i, np.arange(len(found) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(starts), places)], names=["id", "places"])

    return whole.mapInArrow(run, f"id {dict(whole.dtypes)['id']}, places array<struct<idx int, weight long>>").where("size(places) > 0")


def hashed_vectors(texts: DataFrame, size: int = 768) -> DataFrame:
    """(id, idx, weight, value): hashed() as a row for each place that isn't 0, value at unit length."""
    square = F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["weight"] * p["weight"])
    rows = hashed(texts, size).withColumn("_n", F.sqrt(square)).select("id", "_n", F.inline("places"))
    return rows.select("id", "idx", "weight", F.round(F.col("weight") / F.col("_n"), 6).alias("value"))


#: Places of query vectors up to which they are sent to every task; beyond, they are joined by a shuffle.
SENT = 1_000_000
_BLOCK = 1024  # rows that are multiplied at once


def cosines(queries: DataFrame, vectors: DataFrame, key: list[str], least: float, k: int) -> DataFrame:
    """(query_id, chunk_id, score) of the pairs with a score of at least `least` that may be among a query's k best.

    queries: (query_id, *key, idx, weight); vectors: (chunk_id, *key, places array of (idx, weight)),
    a row for each chunk; whole-number weights; only rows with an equal key meet. Few queries are
    sent to every task and multiplied as matrices; only pairs that k others of their block don't
    surpass go on to be ranked.
    """
    if queries.limit(SENT + 1).count() <= SENT:
        return _scored(_products(queries, vectors, key, least, k), least)
    square = F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["weight"] * p["weight"])
    c = vectors.select("chunk_id", *key, square.alias("_nc"), F.inline("places")).withColumnRenamed("weight", "_b")
    norms = queries.select("query_id", "idx", "weight").distinct().groupBy("query_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("_nq"))
    q = queries.select("query_id", *key, "idx", F.col("weight").alias("_a")).join(norms, "query_id")
    dots = c.join(q, [*key, "idx"]).groupBy("chunk_id", "_nc", "query_id", "_nq").agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot"))
    return _scored(dots, least)


def _scored(dots: DataFrame, least: float) -> DataFrame:
    score = F.round(F.col("_dot") / F.sqrt(F.col("_nq") * F.col("_nc")), 6)
    return dots.where("_dot > 0").select("query_id", "chunk_id", score.alias("score")).where(F.col("score") >= least)


def _matrices(asked: list, names: list, at: dict) -> dict[tuple, tuple[list[int], np.ndarray, np.ndarray]]:
    """For each key its queries' numbers, their matrix (places x queries) and squared lengths."""
    groups: dict[tuple, dict[int, list]] = {}
    for query, *key, idx, weight in asked:
        groups.setdefault(tuple(key), {}).setdefault(at[query], []).append((idx, weight))
    out = {}
    for key, of in groups.items():
        rows, m = list(of), np.zeros((1 + max(i for v in of.values() for i, _ in v), len(of)))
        for n, q in enumerate(rows):
            for i, w in of[q]:
                m[i, n] = w
        out[key] = (rows, m, (m * m).sum(axis=0))
    return out


def _products(queries: DataFrame, vectors: DataFrame, key: list[str], least: float, k: int) -> DataFrame:
    """(chunk_id, _nc, query_id, _nq, _dot): whole numbers in doubles, exact below 2^53; the scores here only leave out what is surely worse."""
    asked = [tuple(r) for r in queries.select("query_id", *key, F.col("idx").cast("int"), F.col("weight").cast("long")).collect()]
    names = sorted({r[0] for r in asked})
    groups = _matrices(asked, names, {n: i for i, n in enumerate(names)})
    kinds = dict(vectors.dtypes) | dict(queries.dtypes)
    named = pa.array(names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = list(zip(*[part.column(1 + n).to_pylist() for n in range(len(key))])) if key else [()] * part.num_rows
            mine: dict[tuple, list[int]] = {}
            for n, at_key in enumerate(keys):
                if at_key in groups:
                    mine.setdefault(at_key, []).append(n)
            for at_key, rows in mine.items():
                numbers, right, nq = groups[at_key]
                for at in range(0, len(rows), _BLOCK):
                    some = part.take(pa.array(rows[at : at + _BLOCK]))
                    places = some.column(1 + len(key))
                    flat, lengths = places.flatten(), pc.list_value_length(places).to_numpy(zero_copy_only=False)
                    idx, weight = flat.field("idx").to_numpy(), flat.field("weight").to_numpy().astype(float)
                    owner = np.repeat(np.arange(some.num_rows), lengths)
                    nc = np.bincount(owner, weight * weight, some.num_rows)
                    left = np.zeros((some.num_rows, len(right)))
                    left[owner[idx < len(right)], idx[idx < len(right)]] = weight[idx < len(right)]
                    dots = left @ right
                    scores = dots / np.sqrt(np.outer(nc, nq))
                    best = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else np.full(len(numbers), least)
                    i, j = np.nonzero((dots > 0) & (scores >= np.maximum(best, least) - 1e-5))
                    found = [some.column(0).take(pa.array(i)), pa.array(nc[i].astype(np.int64)), named.take(pa.array(np.array(numbers)[j])), pa.array(nq[j].astype(np.int64)), pa.array(dots[i, j].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(found, names=["chunk_id", "_nc", "query_id", "_nq", "_dot"])

    rows = vectors.select("chunk_id", *key, "places")
    return rows.mapInArrow(run, f"chunk_id {kinds['chunk_id']}, _nc long, query_id {kinds['query_id']}, _nq long, _dot long")
