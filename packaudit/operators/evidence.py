"""Citations in summaries, sources and scope of evidence, readiness, and scores of a whole workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.operators.chunks import citations
from packaudit.operators.inventory import CORE_KINDS

# What asks for a critical finding in a summary
CRITICAL_WORDING = (
    r"(?i)\bcritical\s+(?:(?:validation|system|risk)\s+)?(?:warning|finding|alert|flag|severity)\b"
    r"|\b(?:severity|warning|finding|alert|flag)\s*(?:is|was|:|=|of)?\s*[\"']?critical\b"
)
# Label and dimensions of each core kind
GUIDANCE = {
    "bank_statement": ("bank statements", "Character,Capacity"),
    "audited_financials": ("audited financial statements", "Capacity,Capital"),
    "ssm_registration": ("SSM registration", "Character"),
    "tax_return": ("tax return", "Character,Conditions"),
}
SEGMENT = r"\[[^\[\]]+\]|[^\[\]]+|[\[\]]"


def valid_inline(summaries: DataFrame, allowed: DataFrame, key: list[str]) -> DataFrame:
    """key and body, where brackets hold only citations that exist, each in its own; a bracket without any goes."""
    parts = summaries.select(*key, F.posexplode(F.regexp_extract_all("body", F.lit(SEGMENT), 0)).alias("at", "part"))
    quoted = F.col("part").rlike(r"^\[[^\[\]]+\]$")
    ids = parts.where(quoted).select(*key, "at", F.posexplode(citations(F.col("part"))).alias("n", "cited")).join(allowed.select("cited").distinct(), "cited", "left_semi")
    ids = ids.select(*key, "at", "n", F.concat(F.lit("["), "cited", F.lit("]")).alias("part"))
    plain = parts.where(~quoted).select(*key, "at", F.lit(0).alias("n"), "part")
    whole = plain.unionByName(ids).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "n", "part"))).alias("_p"))
    rebuilt = whole.select(*key, F.array_join(F.transform("_p", lambda p: p["part"]), "").alias("body"))
    return summaries.select(*key).join(rebuilt, key, "left").withColumn("body", F.coalesce("body", F.lit("")))


def unsupported_critical(text: Column, has_critical: Column) -> Column:
    """Whether a text speaks of a critical finding where there is none."""
    return ~has_critical & text.rlike(CRITICAL_WORDING)


def citation_titles(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """(cited, title): file name and pages of each source, or what the id says of its document."""
    pages = F.when(F.size("pages") > 1, F.concat(F.lit("pp. "), F.array_join("pages", ", "))).when(F.size("pages") == 1, F.concat(F.lit("p. "), F.array_join("pages", ", ")))
    parts = F.split("cited", ":")
    document = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), ":")
    known = cited.join(sources, "cited", "left")
    title = F.when(F.col("filename").isNotNull(), F.concat("filename", F.lit(" · "), F.coalesce(pages, F.lit("page reference unavailable"))))
    return known.select("cited", F.coalesce(title, F.element_at(F.split(document, "/"), -1)).alias("title"))


def first_seen(cited: DataFrame, group: str, order: list[str]) -> DataFrame:
    """(group, cited, number): citations numbered by where they first appear."""
    at = cited.groupBy(group, "cited").agg(F.min(F.struct(*order)).alias("_at"))
    return at.select(group, "cited", F.row_number().over(Window.partitionBy(group).orderBy("_at")).alias("number"))


def ordered_distinct(cited: DataFrame, group: str, order: list[str]) -> DataFrame:
    """(group, cited): the different citations of a group in the order of first appearance, joined by a blank."""
    rows = first_seen(cited, group, order).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("number", "cited"))).alias("_c"))
    return rows.select(group, F.array_join(F.transform("_c", lambda c: c["cited"]), " ").alias("cited"))


def merged_files(files: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key, with the place where the key first came."""
    w = Window.partitionBy(*key)
    rows = files.withColumns({"place": F.min(order).over(w), "_last": F.row_number().over(w.orderBy(F.desc(order)))})
    return rows.where("_last = 1").drop("_last")


def enriched(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's file name and kind, and the pages that they come from."""
    of = documents.select("document_id", "filename", "kind")
    return chunks.join(of, "document_id").withColumn("pages", F.when(F.col("page").isNotNull(), F.col("page").cast("string")).otherwise(""))


def in_scope(hits: DataFrame, documents: DataFrame, sources: DataFrame, kinds: list[str], least: float) -> DataFrame:
    """hits with `accepted`: of the application, a known document of a wanted kind, a citable chunk of that document, a score and a text."""
    known = documents.select(F.col("application_id").alias("_a"), "document_id", "kind")
    citable = sources.select("chunk_id", F.col("document_id").alias("_d"))
    rows = hits.join(known, "document_id", "left").join(citable, "chunk_id", "left")
    good = (F.col("application_id") == F.col("_a")) & F.col("kind").isin(kinds) & (F.col("_d") == F.col("document_id")) & (F.col("score") >= least) & ~F.isnan("score") & (F.trim("text") != "")
    return rows.select(*hits.columns, F.coalesce(good, F.lit(False)).alias("accepted"))


def evidence_type(kind: Column) -> Column:
    return F.when(kind == "cash_flow_forecast", "forecast_not_actual").otherwise("document_reported_not_independently_verified")


def compact(evidence: DataFrame) -> DataFrame:
    """Evidence without the structured kinds, which the package's figures already hold."""
    return evidence.where(~F.col("kind").isin(*CORE_KINDS))


def cited_sources(sources: DataFrame, *cited: DataFrame) -> DataFrame:
    """Sources that one of the lists of ids names."""
    ids = cited[0].select("cited")
    for c in cited[1:]:
        ids = ids.unionByName(c.select("cited"))
    return sources.join(ids.distinct(), "cited", "left_semi")


def incomplete(documents: DataFrame, required: list[str]) -> DataFrame:
    """(document_id, missing, accepted): required fields without a value reject a document, and it alone."""
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in sorted(required)]))
    return documents.select("document_id", F.array_join(absent, ",").alias("missing"), (F.size(absent) == 0).alias("accepted"))


def boxes(spans: DataFrame, group: list[str]) -> DataFrame:
    """The box around the spans of each row."""
    return spans.groupBy(*group).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def readiness(inventory: DataFrame, ratios: DataFrame) -> DataFrame:
    """(application_id, place, action, title, detail, dimensions): what to do about missing kinds and bank months, failures, duplicates and unknown debt service, in that order.

    ratios: (application_id, debt_service), a row for each period.
    """
    labels, dims = (F.create_map(*[F.lit(x) for k, v in GUIDANCE.items() for x in (k, v[i])]) for i in (0, 1))
    absent = F.posexplode(F.filter(F.split("missing", ","), lambda k: k != ""))
    kinds = inventory.select("application_id", absent.alias("place", "_k")).select(
        "application_id",
        "place",
        F.concat(F.lit("missing-"), "_k").alias("action"),
        F.concat(F.lit("Request "), labels[F.col("_k")]).alias("title"),
        F.lit("The package inventory does not contain this core document type. Confirm whether it is required and obtain it before relying on the assessment.").alias("detail"),
        dims[F.col("_k")].alias("dimensions"),
    )

    def counted(n: Column, place: int, action: str, verb: str, what: str, detail: Column, dimensions: str = "") -> DataFrame:
        title = F.concat(F.lit(f"{verb} "), n, F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"))
        return inventory.where(n > 0).select("application_id", F.lit(place).alias("place"), F.lit(action).alias("action"), title.alias("title"), detail.alias("detail"), F.lit(dimensions).alias("dimensions"))

    months = F.size(F.filter(F.split("missing_months", ","), lambda m: m != ""))
    coverage = F.concat(F.lit("No statement coverage was identified for "), F.replace("missing_months", F.lit(","), F.lit(", ")), F.lit(". Request missing statements or confirm the review period."))
    schedule = F.lit("Debt-service coverage is unavailable for at least one period. Obtain the actual repayment schedule rather than estimating principal payments from liabilities.")
    unknown = ratios.where("debt_service is null").select("application_id").distinct()
    parts = [
        counted(months, 10, "bank-coverage", "Review", "missing bank month", coverage, "Character,Capacity"),
        counted(F.col("failed_count"), 11, "failed-documents", "Resolve", "unprocessed document", F.lit("Inspect extraction errors and re-upload readable source PDFs where necessary.")),
        counted(F.col("duplicate_count"), 12, "duplicates", "Review", "duplicate upload", F.lit("Confirm whether the repeated PDFs are intentional before counting them as separate evidence.")),
        unknown.select("application_id", F.lit(13).alias("place"), F.lit("repayment-schedule").alias("action"), F.lit("Verify debt-service obligations").alias("title"), schedule.alias("detail"), F.lit("Capacity").alias("dimensions")),
    ]
    for p in parts:
        kinds = kinds.unionByName(p)
    return kinds


def completion(answers: DataFrame) -> DataFrame:
    """(task, participants, rate): share of participants who completed each task."""
    rate = F.round(F.sum(F.col("completed").cast("int")) / F.count("*"), 4)
    return answers.groupBy("task").agg(F.count("*").alias("participants"), rate.alias("rate"))


def retrieval_quality(hits: DataFrame, k: int = 3) -> DataFrame:
    """One row: recall and precision among the first k of each query, and the mean reciprocal rank of the first relevant hit.

    hits: (query_id, rank, relevant), rank from 1. Queries without a relevant hit count as 0.
    """
    each = hits.groupBy("query_id").agg(
        F.max(F.when(F.col("relevant") & (F.col("rank") <= k), 1).otherwise(0)).alias("_hit"),
        F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1).otherwise(0)).alias("_n"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("_first"),
    )
    return each.agg(
        F.count("*").alias("queries"),
        F.round(F.avg("_hit"), 6).alias("recall_at_k"),
        F.round(F.avg(F.col("_n") / k), 6).alias("precision_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("_first"), F.lit(0.0))), 6).alias("mrr"),
    )


def workload(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, pages, share of documents that were read, failures and chunks."""
    read = F.col("status").isin("extracted", "indexed")
    sums = documents.agg(F.count("*").alias("documents"), F.sum("page_count").alias("pages"), F.round(F.avg(read.cast("int")), 6).alias("success"), F.count(F.when(~read, 1)).alias("errors"))
    both = sums.unionByName(chunks.agg(F.count("*").alias("chunks")), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def cash_totals(months: DataFrame, metrics: DataFrame) -> DataFrame:
    """(application_id, credits, debits): the package's months where it has any, else the sum of its statements."""
    own = months.groupBy("application_id").agg(F.sum("credits").alias("_mc"), F.sum("debits").alias("_md"))
    rest = metrics.groupBy("application_id").agg(F.sum("total_credits").alias("_sc"), F.sum("total_debits").alias("_sd"))
    both = own.join(rest, "application_id", "full")
    return both.select("application_id", F.coalesce("_mc", "_sc").cast("decimal(18,2)").alias("credits"), F.coalesce("_md", "_sd").cast("decimal(18,2)").alias("debits"))


def gates(accuracy: DataFrame, faithfulness: DataFrame, p95: DataFrame, limit_ms: float = 180_000) -> DataFrame:
    """One row: mean accuracy and whether it reaches 0.9, no citation is invalid, and the slowest step's p95 is below the limit."""
    a = accuracy.agg(F.round(F.avg("accuracy"), 6).alias("accuracy"))
    f = faithfulness.agg((F.sum("citations") == F.sum("valid")).alias("citations_valid"))
    p = p95.agg(F.max("p95_ms").alias("p95_ms"))
    both = a.unionByName(f, allowMissingColumns=True).unionByName(p, allowMissingColumns=True)
    both = both.agg(F.max("accuracy").alias("accuracy"), F.bool_or("citations_valid").alias("citations_valid"), F.max("p95_ms").alias("p95_ms"))
    return both.select("accuracy", (F.col("accuracy") >= 0.9).alias("accurate"), "citations_valid", (F.col("p95_ms") < limit_ms).alias("fast"))
