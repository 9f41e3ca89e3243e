"""Exact token counts for every context limit, from a histogram of encoded lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packaudit.llm.bpe import lengths
from packaudit.llm.common import saved

def length_histogram(docs: DataFrame, path: str) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length. Null and empty texts have length 0."""
    return lengths(docs, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """What every context limit means, one row per length that occurs (as the limit).

    Columns: context_limit, n_docs (of this very length), docs_longer, tokens_total (of all
    documents), truncated_total (tokens left when all texts are cut at the limit), docs_within
    and share_within (the limit is this quantile of the lengths; any quantile is the first row
    whose share reaches it). Totals between two lengths follow linearly: docs_longer tokens
    for each step of the limit.

    Suffix sums run inside blocks of 1,024 lengths, then over the blocks' totals inside groups of
    1,024 blocks, then over the groups (the longest text / 1,048,576): no task holds more rows
    than that of one level.
    """
    rows = histogram.select("n_tokens", "n_docs", (F.col("n_docs") * F.col("n_tokens")).alias("_t"), F.shiftright("n_tokens", 10).alias("_block"))
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_t").alias("_t")).withColumn("_group", F.shiftright("_block", 10))
    groups = blocks.groupBy("_group").agg(F.sum("_d").alias("_d"), F.sum("_t").alias("_t"))

    def beyond(table: DataFrame, within: list, order: str, docs: str, tokens: str, name: str) -> DataFrame:
        """table with the sums of docs and tokens over the rows of its part that come later."""
        later = Window.partitionBy(*within).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
        return table.withColumns({f"_d_{name}": F.coalesce(F.sum(docs).over(later), F.lit(0)), f"_t_{name}": F.coalesce(F.sum(tokens).over(later), F.lit(0))})

    whole = Window.partitionBy("_all")
    groups = groups.withColumn("_all", F.lit(0)).withColumns({"_docs": F.sum("_d").over(whole), "tokens_total": F.sum("_t").over(whole)})
    of_group = beyond(groups, ["_all"], "_group", "_d", "_t", "groups").select("_group", "_d_groups", "_t_groups", "_docs", "tokens_total")
    of_block = beyond(blocks, ["_group"], "_block", "_d", "_t", "blocks").join(of_group, "_group").drop("_d", "_t", "_group")
    return (
        beyond(rows, ["_block"], "n_tokens", "n_docs", "_t", "in")
        .join(of_block, "_block")
        .withColumn("docs_longer", F.col("_d_in") + F.col("_d_blocks") + F.col("_d_groups"))
        .withColumn("_longer", F.col("_t_in") + F.col("_t_blocks") + F.col("_t_groups"))
        .select(
            F.col("n_tokens").alias("context_limit"),
            "n_docs",
            "docs_longer",
            (F.col("_docs") - F.col("docs_longer")).alias("docs_within"),
            "tokens_total",
            (F.col("tokens_total") - F.col("_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
            F.round((F.col("_docs") - F.col("docs_longer")) / F.col("_docs"), 9).alias("share_within"),
        )
    )


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """(context_limit, docs_longer, truncated_total) for any limit, also between two lengths; one row, zeros for an empty table."""
    n = F.col("n_tokens")
    return histogram.agg(
        F.lit(limit).cast("long").alias("context_limit"),
        F.coalesce(F.sum(F.when(n > limit, F.col("n_docs"))), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(F.least(n, F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_total"),
    )


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """limits() of the documents; an empty table gives no rows."""
    return limits(saved(length_histogram(docs, path), "histogram"))
