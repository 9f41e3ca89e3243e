"""Searches, links and ratings over records of packages, and similarity of sparse vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.operators.chunks import cosines


def matching(records: DataFrame, columns: list[str], text: str, category: str | None = None) -> DataFrame:
    """Records of a category with a text in one of the columns, upper or lower case."""
    rows = records if category is None else records.where(F.col("category") == category)
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


# Statuses that an entry of each category may have
STATUSES = {"test": ["not_run", "passed", "failed"], "bug": ["open", "resolved"], "note": ["recorded"]}


def compatible(records: DataFrame) -> DataFrame:
    """Whether each entry (category, status, title) can be taken: it has a title, and its status is one of its category's."""
    table = F.create_map(*[x for k, v in STATUSES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    titled = F.coalesce(F.trim(F.regexp_replace("title", r"\s+", " ")) != "", F.lit(False))
    return records.withColumn("compatible", titled & F.coalesce(F.array_contains(F.try_element_at(table, F.col("category")), F.col("status")), F.lit(False)))


def follow_ups(records: DataFrame) -> DataFrame:
    """(id, linked): other records whose related_id is the record's id or application; blanks never match."""
    other = records.where("trim(related_id) <> ''").select(F.col("id").alias("linked"), F.col("related_id").alias("_k"))
    by_id = records.select("id", F.col("id").alias("_k")).join(other, "_k")
    by_application = records.where("trim(application_id) <> ''").select("id", F.col("application_id").alias("_k")).join(other, "_k")
    return by_id.unionByName(by_application).where("id <> linked").select("id", "linked").distinct()


def case_runs(links: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of cases to analysis runs with a result, each once; and the conflicting second links."""
    fine = links.join(runs.where("category = 'analysis' and has_result").select("run_id"), "run_id", "left_semi")
    ranked = fine.withColumn("_n", F.row_number().over(Window.partitionBy("case_id", "run_id").orderBy("link_id")))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def aligned(expected: DataFrame, actual: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """(document_id, matched, compared, accuracy, same_length) of values aligned by index; the shorter list limits the comparison."""
    sizes = expected.groupBy("document_id").agg(F.count("*").alias("_e")).join(actual.groupBy("document_id").agg(F.count("*").alias("_a")), "document_id", "left")
    both = expected.join(actual.withColumnRenamed("value", "_v"), ["document_id", "row_index"])
    hits = both.groupBy("document_id").agg(F.count("*").alias("compared"), F.count(F.when(F.abs(F.col("value") - F.col("_v")) <= F.lit(tolerance).cast("decimal(18,2)"), 1)).alias("matched"))
    out = sizes.join(hits, "document_id", "left").fillna(0, ["compared", "matched", "_a"])
    accuracy = F.when(F.col("compared") == 0, 1.0).otherwise(F.round(F.col("matched") / F.col("compared"), 6))
    return out.select("document_id", "matched", "compared", accuracy.alias("accuracy"), (F.col("_e") == F.col("_a")).alias("same_length"))


# Phrases that a line on concentration has
CONCENTRATION = r"(?i)customer concentration|supplier dependence|supplier concentration"


def concentration(chunks: DataFrame, least: float = 50.0) -> DataFrame:
    """(application_id, percentages, chunk_ids): percentages of `least` and more on lines of management accounts
    that speak of concentration, distinct and ascending, and the chunks that have them."""
    lines = chunks.where("kind = 'management_accounts'").select("application_id", "chunk_id", F.explode(F.split("text", r"\R")).alias("line")).where(F.col("line").rlike(CONCENTRATION))
    found = F.regexp_extract_all("line", F.lit(r"(?<!\d)(\d{1,3}(?:\.\d+)?)\s*%"), 1)
    each = lines.select("application_id", "chunk_id", F.explode(found).alias("p")).withColumn("p", F.col("p").cast("double")).where(F.col("p") >= least)
    sets = each.groupBy("application_id").agg(F.sort_array(F.collect_set("p")).alias("_p"), F.sort_array(F.collect_set("chunk_id")).alias("_c"))
    return sets.select("application_id", F.array_join(F.transform("_p", lambda x: x.cast("string")), ",").alias("percentages"), F.array_join("_c", ",").alias("chunk_ids"))


def sparse_top(queries: DataFrame, chunks: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k most similar chunks of each query by cosine.

    queries: (id, idx, weight) rows, chunks: (id, places array of (idx, weight)), whole-number
    weights. Ties go to the smaller chunk id.
    """
    scored = cosines(queries.withColumnRenamed("id", "query_id"), chunks.withColumnRenamed("id", "chunk_id"), [], least, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
