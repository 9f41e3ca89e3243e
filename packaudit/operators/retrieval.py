"""Evidence for packages: filtered similarity search, selection under nested quotas and a context budget, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packaudit.operators.chunks import cosines, normal_text
from packaudit.operators.evidence import evidence_type

# Topics, what is asked about each, and the kinds of documents that may answer
TOPICS = (
    ("tax", "Tax return year of assessment gross business income chargeable income tax payable", ("tax_return",)),
    ("character", "Business registration directors ownership payment conduct arrears repayment history", ("ssm_registration", "bank_statement")),
    ("capacity", "Bank statement credits debits balance cash flow cash from operations EBIT interest expense debt repayments", ("bank_statement", "audited_financials")),
    ("capital", "Total equity retained earnings current assets liabilities capital working capital", ("audited_financials",)),
    ("collateral", "Facility statement pledged collateral security guarantee outstanding balance repayment terms covenants", ("facility_statement",)),
    ("conditions", "Management accounts customer concentration supplier dependence operating performance risks revenue expenses", ("management_accounts",)),
    ("forecast", "Cash flow forecast assumptions projected receipts payments cash deficit financing shortfall", ("cash_flow_forecast",)),
)
# Score, chunks of a topic and of a document, characters of a chunk and of all
LEAST, PER_TOPIC, PER_DOCUMENT, CHUNK_CHARS, CONTEXT_CHARS = 0.12, 3, 2, 1800, 20_000


def specifications(spark: SparkSession, packages: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(application_id, topic_ord, topic, query, kinds): the topics of each package, then the first two findings that cite something.

    packages: (application_id, kinds array), the kinds that a package has. findings:
    (application_id, finding_ord, code, message, cited boolean); those are asked of all kinds.
    """
    topics = F.array(*[F.struct(F.lit(n).alias("topic_ord"), F.lit(t).alias("topic"), F.lit(q).alias("query"), F.array(*map(F.lit, k)).alias("kinds")) for n, (t, q, k) in enumerate(TOPICS)])
    out = packages.select("application_id", F.explode(topics).alias("_t")).select("application_id", "_t.*")
    if findings is None:
        return out
    rank = F.row_number().over(Window.partitionBy("application_id").orderBy("finding_ord"))
    first = findings.withColumn("_n", rank).where("_n <= 2 and cited").join(packages, "application_id")
    more = first.select("application_id", (len(TOPICS) - 1 + F.col("_n")).alias("topic_ord"), F.concat(F.lit("validation:"), "code").alias("topic"), F.substring("message", 1, 350).alias("query"), F.array_sort("kinds").alias("kinds"))
    return out.unionByName(more)


def filtered_top(queries: DataFrame, chunks: DataFrame, k: int, least: float = LEAST) -> DataFrame:
    """(query_id, chunk_id, score, rank): of the chunks in a query's package and kinds, the k most similar with a score of at least `least`.

    queries: (query_id, application_id, kinds array, idx, weight), chunks: (chunk_id, application_id,
    kind, idx, weight) or a row for each chunk with places array of (idx, weight), whole-number
    weights. No pair outside the filter meets. A query without kinds finds nothing; an empty
    package is an error.
    """
    if queries.where("trim(application_id) = ''").limit(1).count():
        raise ValueError("a search needs an application_id")
    asked = queries.select("query_id", "application_id", F.explode("kinds").alias("kind"), "idx", "weight")
    key = ["application_id", "kind"]
    if "places" not in chunks.columns:
        chunks = chunks.groupBy("chunk_id", *key).agg(F.collect_list(F.struct("idx", "weight")).alias("places"))
    scored = cosines(asked, chunks, key, least, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def charged(hits: DataFrame, per_topic: int = PER_TOPIC, per_document: int = PER_DOCUMENT, chunk_chars: int = CHUNK_CHARS, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """hits within the quotas, with place, topic_place, new, remaining, cost and kept.

    hits: (application_id, topic_ord, chunk_id, document_id, kind, score, text, accepted). In the
    order of scores (ties by chunk_id) a text counts once for each document, a document
    per_document times and a topic per_topic times; place is among all hits of the topic,
    topic_place among these. Over the topics in their order a chunk is charged when it first
    comes (new), up to chunk_chars; the context holds context_chars, of which `remaining` was left.
    When nothing remains, a topic ends at its first new chunk, and later topics get nothing.
    """
    topic = ["application_id", "topic_ord"]
    over = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.col("chunk_id")))
    placed = hits.withColumn("place", over(*topic))
    fine = placed.where("accepted").withColumn("_key", normal_text(F.col("text")))
    fine = fine.withColumn("_n", over(*topic, "document_id", "_key")).where("_n = 1").drop("_key")
    fine = fine.withColumn("_n", over(*topic, "document_id")).where(F.col("_n") <= per_document).withColumn("topic_place", over(*topic)).where(F.col("topic_place") <= per_topic).drop("_n")
    new = F.row_number().over(Window.partitionBy("application_id", "chunk_id").orderBy("topic_ord", "topic_place")) == 1
    priced = fine.withColumn("new", new).withColumn("_cost", F.when(F.col("new"), F.least(F.length("text"), F.lit(chunk_chars))).otherwise(0))
    run = Window.partitionBy("application_id").orderBy("topic_ord", "topic_place").rowsBetween(Window.unboundedPreceding, -1)
    spent = priced.withColumn("remaining", F.greatest(F.lit(0), context_chars - F.coalesce(F.sum("_cost").over(run), F.lit(0))))
    within = Window.partitionBy(*topic).orderBy("topic_place").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.max(F.col("new") & (F.col("remaining") <= 0)).over(within)
    kept = spent.withColumn("kept", ~ended & (F.first("remaining").over(within) > 0))
    return kept.withColumn("cost", F.when(F.col("kept") & F.col("new"), F.least("_cost", "remaining")).otherwise(0)).drop("_cost")


def evidence(chosen: DataFrame) -> DataFrame:
    """A row for each chunk that charged() keeps: its text as far as the context holds it."""
    text = F.expr("substring(text, 1, cost)")
    return chosen.where("kept and new").select(
        "application_id", "chunk_id", "document_id", "kind", "score", text.alias("text"), (F.col("cost") < F.length("text")).alias("truncated"), evidence_type(F.col("kind")).alias("evidence_type"), "topic_ord", "topic_place"
    )


def topic_status(asked: DataFrame, packages: DataFrame, hits: DataFrame, chosen: DataFrame, metrics: DataFrame, per_topic: int = PER_TOPIC, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """(application_id, topic_ord, topic, status, rejected_hits, chunk_ids) of each topic; chosen is charged().

    not_available without a document of its kinds; budget_exhausted once nothing remains;
    retrieved, or no_relevant_evidence. Hits out of scope are counted up to where the topic ended:
    at its last row by quota, or at the first chunk that couldn't be paid for. The topic capacity
    also gets the package's metric chunks ((application_id, ord, chunk_id)), and then is
    structured_metrics_available rather than without evidence.
    """
    topic = ["application_id", "topic_ord"]
    has = asked.join(packages.withColumnRenamed("kinds", "_has"), "application_id").withColumn("available", F.arrays_overlap("kinds", "_has")).drop("_has")
    ends = (F.col("new") & (F.col("remaining") <= 0)) | (F.col("topic_place") == per_topic)
    own = F.filter(F.array_sort(F.collect_list(F.struct("topic_place", F.when(F.col("kept"), F.col("chunk_id")).alias("chunk_id")))), lambda c: c["chunk_id"].isNotNull())
    sums = chosen.groupBy(*topic).agg(F.sum("cost").alias("_cost"), F.min(F.when(ends, F.col("place"))).alias("_end"), own.alias("_c"))
    order = Window.partitionBy(*topic).orderBy(F.desc("score"), "chunk_id")
    wrong = hits.withColumn("place", F.row_number().over(order)).where("not accepted").join(sums.select(*topic, "_end"), topic, "left")
    counts = wrong.where("_end is null or place < _end").groupBy(*topic).agg(F.count("*").alias("rejected_hits"))
    lists = metrics.groupBy("application_id").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))).alias("_m"))
    rows = has.join(sums, topic, "left").join(counts, topic, "left").join(lists, "application_id", "left").fillna(0, ["_cost", "rejected_hits"])
    before = F.coalesce(F.sum("_cost").over(Window.partitionBy("application_id").orderBy("topic_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    none = F.array().cast("array<string>")
    chunks, extra = (F.coalesce(F.transform(c, lambda x: x["chunk_id"]), none) for c in ("_c", "_m"))
    rows = rows.withColumns({"_open": F.col("available") & (before < context_chars), "_own": chunks, "_extra": F.when(F.col("topic") == "capacity", extra).otherwise(none)})
    status = F.when(~F.col("available"), "not_available").when(~F.col("_open"), "budget_exhausted").when(F.size("_own") > 0, "retrieved").when(F.size("_extra") > 0, "structured_metrics_available").otherwise("no_relevant_evidence")
    ids = F.array_distinct(F.concat("_own", "_extra"))
    return rows.select(*topic, "topic", status.alias("status"), F.when(F.col("_open"), F.col("rejected_hits")).otherwise(0).alias("rejected_hits"), ids.alias("chunk_ids"))


def bundle_status(topics: DataFrame, has_evidence: DataFrame) -> DataFrame:
    """(application_id, status, warnings array): warnings in the order of topics; partial with evidence and warnings, complete without warnings, else no_evidence."""
    said = F.array_compact(
        F.array(
            F.when(F.col("status") == "budget_exhausted", F.concat(F.lit("Retrieval context budget exhausted before "), "topic", F.lit("; coverage is incomplete."))),
            F.when(F.col("status") == "no_relevant_evidence", F.concat(F.lit("No relevant excerpts retrieved for "), "topic", F.lit("; inspect the available source documents manually."))),
            F.when(F.col("rejected_hits") > 0, F.concat(F.lit("Rejected out-of-scope, unknown or unsuitable evidence for "), "topic", F.lit("."))),
        )
    )
    each = topics.select("application_id", F.struct("topic_ord", said.alias("said")).alias("_w")).groupBy("application_id").agg(F.array_sort(F.collect_list("_w")).alias("_w"))
    each = each.withColumn("warnings", F.flatten(F.transform("_w", lambda w: w["said"]))).join(has_evidence.select("application_id").distinct().withColumn("_e", F.lit(True)), "application_id", "left")
    status = F.when(F.col("_e") & (F.size("warnings") > 0), "partial").when(F.col("_e"), "complete").otherwise("no_evidence")
    return each.select("application_id", status.alias("status"), "warnings")


def prompt_citations(citable: DataFrame, *parts: DataFrame) -> DataFrame:
    """(application_id, cited array): the ids of all parts that can be cited, sorted."""
    ids = parts[0].select("application_id", "chunk_id")
    for p in parts[1:]:
        ids = ids.unionByName(p.select("application_id", "chunk_id"))
    known = ids.join(citable.select("application_id", "chunk_id").distinct(), ["application_id", "chunk_id"], "left_semi")
    return known.groupBy("application_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("cited"))
