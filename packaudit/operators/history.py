"""Records over time: job states, case timelines, paging, traces, surveys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(events: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key."""
    newest = events.groupBy(key).agg(F.max_by(F.struct(*events.columns), at).alias("_r"))
    return newest.select("_r.*")


def monotone_progress(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Progress that never falls; a failed state keeps the last value."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("shown_progress", F.max(F.when(F.col("status") != "failed", F.col("progress"))).over(w))


def timeline(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each change with the status before it."""
    return events.withColumn("previous_status", F.lag("status").over(Window.partitionBy(key).orderBy(*order)))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def exclusive_p95(values: Column) -> Column:
    """The 95th percentile of an array by the exclusive rule, which may lie beyond the largest value."""
    x = F.array_sort(values)
    n = F.size(x)
    m = n + 1
    j = F.greatest(F.lit(1), F.least(F.floor(19 * m / 20), n - 1)).cast("int")
    low = F.element_at(x, j)
    return F.when(n == 1, F.element_at(x, 1)).otherwise(low + (F.get(x, j) - low) * (19 * m - 20 * j) / 20)


def latency(trace: DataFrame) -> DataFrame:
    """Per run and node: steps, median and exclusive p95 of the milliseconds."""
    return trace.groupBy("run_id", "node").agg(F.count("*").alias("steps"), F.collect_list("ms").alias("_x"), F.median("ms").alias("_m")).select(
        "run_id", "node", "steps", F.round("_m", 4).alias("p50_ms"), F.round(exclusive_p95(F.col("_x")), 4).alias("p95_ms")
    )


def survey_score(answers: DataFrame) -> DataFrame:
    """Ten answers of 1 to 5 as a score of 0 to 100 with a band; other lists are rejected (null)."""
    valid = (F.size("answers") == 10) & F.forall("answers", lambda a: a.between(1, 5))
    points = F.transform("answers", lambda a, i: F.when(i % 2 == 0, a - 1).otherwise(5 - a))
    score = F.aggregate(points, F.lit(0), lambda s, p: s + p) * 2.5
    out = answers.withColumn("score", F.when(valid, score))
    return out.withColumn("band", F.when(F.col("score") >= 85, "Excellent").when(F.col("score") >= 70, "Good").when(F.col("score") >= 50, "OK").when(F.col("score").isNotNull(), "Poor"))


def precision_recall(rows: DataFrame) -> DataFrame:
    """Of two sets of codes; if one is empty, both figures are 1 when the other is empty too, else the undefined one is 0."""
    hits = F.size(F.array_intersect("expected", "actual"))
    e, a = F.size("expected"), F.size("actual")
    precision = F.when(a == 0, F.when(e == 0, 1.0).otherwise(0.0)).otherwise(hits / a)
    recall = F.when(e == 0, F.when(a == 0, 1.0).otherwise(0.0)).otherwise(hits / e)
    return rows.withColumns({"precision": F.round(precision, 6), "recall": F.round(recall, 6)})
