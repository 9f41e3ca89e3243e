"""What surrounds a written assessment: paragraphs and headings, review flags, findings that it leaves out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The dimensions of an assessment, and what begins a paragraph of its own
DIMENSIONS = "Character|Capacity|Capital|Collateral|Conditions"
VERDICT = rf"(?:(?:Finally|Similarly|However),\s+)?(?:The\s+)?['\"‘“]?(?:{DIMENSIONS})['\"’”]?\s+(?:assessment\s+)?(?:is|are)\b"
OPENINGS = r"(?:For the financial year|Key financial ratios|The Interest Coverage Ratio|Total equity for|The capital aspect)\b"
CHECKS = "System validation checks:"


def paragraphs(body: Column) -> Column:
    """The paragraphs of a text: blocks between empty lines, and what begins with a verdict or an opening after a sentence."""
    plain = F.regexp_replace(body, rf"\*\*({DIMENSIONS})(:?)\*\*", "$1$2")
    for begin in (VERDICT, OPENINGS):
        plain = F.regexp_replace(plain, rf"([.!?])\s+({begin})", "$1\n\n$2")
    return F.filter(F.transform(F.split(plain, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def heading(paragraph: Column) -> Column:
    """System checks, the dimension that a paragraph is about, or Assessment detail."""
    labelled = F.regexp_extract(paragraph, rf"^({DIMENSIONS})\s*:", 1)
    judged = F.regexp_extract(F.regexp_extract(paragraph, f"^{VERDICT}", 0), DIMENSIONS, 0)
    return F.when(paragraph.startswith(CHECKS), "System checks").when(labelled != "", labelled).when(judged != "", judged).otherwise("Assessment detail")


# A bracket of ids with a kind and a number, several between commas
_ID = r"[^\[\]]*?:(?:summary|transaction|director|period|page):\d+"
CITATION = rf"\[{_ID}(?:\s*[,;]\s*{_ID})*\]"


def segments(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key, place, kind, value): a body as text and citations in turn.

    Brackets that aren't citations are text. An id that comes again, with only white space
    between, is left out; behind other text it counts anew.
    """
    parts = F.regexp_extract_all("body", F.lit(rf"(?s){CITATION}|.+?(?={CITATION}|\z)"), 0)
    pieces = texts.select(*key, F.posexplode(parts).alias("_at", "_part"))
    quoted = F.col("_part").rlike(f"^{CITATION}$")
    ids = F.filter(F.transform(F.split(F.expr("substring(_part, 2, length(_part) - 2)"), r"\s*[,;]\s*"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    each = F.when(quoted, F.transform(ids, lambda x: F.struct(F.lit("citation").alias("kind"), x.alias("value")))).otherwise(F.array(F.struct(F.lit("text").alias("kind"), F.col("_part").alias("value"))))
    rows = pieces.select(*key, "_at", F.posexplode(each).alias("_n", "_s")).select(*key, "_at", "_n", "_s.*")
    own = Window.partitionBy(*key).orderBy("_at", "_n")
    said = (F.col("kind") == "text") & F.col("value").rlike(r"\S")
    claims = rows.withColumn("_claim", F.sum(said.cast("int")).over(own))
    again = F.row_number().over(Window.partitionBy(*key, "_claim", "kind", "value").orderBy("_at", "_n")) > 1
    kept = claims.withColumn("_again", (F.col("kind") == "citation") & again).where("not _again")
    return kept.select(*key, (F.row_number().over(own) - 1).alias("place"), "kind", "value")


def grouped(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, place, kind, values array): segments() with neighbouring citations as one group of sources; white space between two of them is left out."""
    own = Window.partitionBy(*key).orderBy("place")
    cited = F.col("kind") == "citation"
    blank = ~cited & ~F.col("value").rlike(r"\S") & F.coalesce(F.lag(cited).over(own), F.lit(False)) & F.coalesce(F.lead(cited).over(own), F.lit(False))
    left = parts.withColumn("_blank", blank).where("not _blank")
    starts = ~cited | ~F.coalesce(F.lag(cited).over(own), F.lit(False))
    groups = left.withColumn("_g", F.sum(starts.cast("int")).over(own)).groupBy(*key, "_g").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "value"))).alias("_v"))
    kind = F.when(F.col("_v")[0]["kind"] == "citation", "sources").otherwise("text")
    return groups.select(*key, (F.col("_g") - 1).cast("int").alias("place"), kind.alias("kind"), F.array_distinct(F.transform("_v", lambda v: v["value"])).alias("values"))


def review_flags(*parts: DataFrame) -> DataFrame:
    """(application_id, place, flag): the different flags of (application_id, ord, flag) in the order of first appearance, earlier parts first."""
    rows = reduce(DataFrame.unionByName, [p.select("application_id", "flag", F.struct(F.lit(i).alias("part"), F.col("ord").cast("long").alias("ord"), F.col("flag").alias("flag")).alias("_at")) for i, p in enumerate(parts)])
    first = rows.groupBy("application_id", "flag").agg(F.min("_at").alias("_at"))
    return first.select("application_id", F.row_number().over(Window.partitionBy("application_id").orderBy("_at")).alias("place"), "flag")


def with_checks(bodies: DataFrame, findings: DataFrame, citable: DataFrame) -> DataFrame:
    """(application_id, body): bodies with a line for each finding beyond info whose code they don't name, under "System validation checks:".

    findings: (application_id, finding_ord, code, severity, message, citations array), appended in their
    order with those of their citations that exist, each once; one without such a citation rests on the
    package inventory. A body that names all codes stays as it is.
    """
    left = findings.where("severity <> 'info'").join(bodies, "application_id").where(~F.col("body").contains(F.col("code")))
    said = ["_id", "application_id", "finding_ord", "code", "severity", "message"]
    each = left.withColumn("_id", F.monotonically_increasing_id()).select(*said, F.posexplode_outer(F.array_distinct("citations")).alias("_at", "chunk_id"))
    known = each.join(citable.select("application_id", "chunk_id", F.lit(True).alias("_ok")).distinct(), ["application_id", "chunk_id"], "left")
    known = known.groupBy(*said).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("_ok"), F.struct("_at", "chunk_id")))), lambda t: t["chunk_id"]).alias("_tags"))
    basis = F.when(F.size("_tags") > 0, F.array_join(F.transform("_tags", lambda c: F.concat(F.lit("["), c, F.lit("]"))), " ")).otherwise("(package inventory check)")
    line = F.concat("code", F.lit(" ("), F.upper("severity"), F.lit("): "), "message", F.lit(" "), basis)
    lines = known.groupBy("application_id").agg(F.array_sort(F.collect_list(F.struct("finding_ord", line.alias("line")))).alias("_l"))
    added = F.concat("body", F.lit(f"\n\n{CHECKS}\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"))
    return bodies.join(lines, "application_id", "left").select("application_id", F.when(F.col("_l").isNotNull(), added).otherwise(F.col("body")).alias("body"))
