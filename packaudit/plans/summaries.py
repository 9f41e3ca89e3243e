"""Queries over paragraphs, review flags and findings that a summary leaves out, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from packaudit.operators import summaries
from packaudit.plans import packages, retrieval, texts, views
from packaudit.plans.shared import FRAMES, shared
from packaudit.plans.sql_views import VIEWS, oracle

FRAMES["f_summary"] = texts.summaries
FRAMES["f_package_finding"] = packages.r8_package_findings
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = oracle(sql)
        return f

    return add


_SAID = [" However, the Capacity is sound.", " Total equity for the year rose.\n\nNothing else.", "\n \nThe Collateral assessment is weak! Capital are low.", " Key figures follow.", "? Conditions is stable."]
_LEAD = ["**Character:** ", "Capital: ", "System validation checks: ", "", "The 'Capacity' is good. "]
VIEWS["f_assessed"] = "SELECT conv_id, turn, [{}][conv_id % 5 + 1] || text || [{}][turn % 5 + 1] AS body FROM conversations".format(
    *(", ".join("'" + x.replace("'", "''") + "'" for x in part) for part in (_LEAD, _SAID))
)
_D = "Character|Capacity|Capital|Collateral|Conditions"
_V = rf"""(?:(?:Finally|Similarly|However),\s+)?(?:The\s+)?[''"‘“]?(?:{_D})[''"’”]?\s+(?:assessment\s+)?(?:is|are)\b"""
_O = r"(?:For the financial year|Key financial ratios|The Interest Coverage Ratio|Total equity for|The capital aspect)\b"


@query(rf"""SELECT conv_id, turn, place, paragraph, CASE WHEN starts_with(paragraph, 'System validation checks:') THEN 'System checks' WHEN regexp_matches(paragraph, '^({_D})\s*:') THEN regexp_extract(paragraph, '^({_D})\s*:', 1)
    WHEN regexp_matches(paragraph, '^{_V}') THEN regexp_extract(paragraph, '({_D})', 1) ELSE 'Assessment detail' END AS heading
    FROM (SELECT conv_id, turn, CAST(unnest(range(len(p))) AS INT) AS place, unnest(p) AS paragraph FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(
        regexp_replace(regexp_replace(regexp_replace(body, '\*\*({_D})(:?)\*\*', '\1\2', 'g'), '([.!?])\s+({_V})', '\1' || chr(10) || chr(10) || '\2', 'g'), '([.!?])\s+({_O})', '\1' || chr(10) || chr(10) || '\2', 'g'),
        '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM f_assessed))""")
def t8_paragraphs(spark, d):
    """Turns with a lead and an ending of their own, as paragraphs with headings."""
    lead, said = (F.element_at(F.array(*[F.lit(x) for x in part]), (F.col(c) % 5 + 1).cast("int")) for part, c in ((_LEAD, "conv_id"), (_SAID, "turn")))
    rows = views.table(spark, d, "conversations").select("conv_id", "turn", F.concat(lead, "text", said).alias("body"))
    parts = rows.select("conv_id", "turn", F.posexplode(summaries.paragraphs(F.col("body"))).alias("place", "paragraph"))
    return parts.withColumn("heading", summaries.heading(F.col("paragraph")))


_ID = r"[^\[\]]*?:(?:summary|transaction|director|period|page):\d+"
_CITED = rf"(\[{_ID}(?:\s*[,;]\s*{_ID})*\])"
cited_texts = shared(
    "f_cited_text",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN body || ' [conv-' || conv_id || ':page:0]' WHEN 1 THEN '[conv-1:page:1]  [conv-2:page:2] [conv-1:page:1] ' || body || ' [estimated] ' WHEN 2 THEN body || '[x/y:period:' || turn || '][x/y:period:' || turn || ';z:director:1] tail' ELSE body END AS body FROM f_summary""",
)
VIEWS["f_seg"] = rf"""SELECT conv_id, turn, place, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos, n) - 1 AS place FROM (SELECT *, kind = 'citation' AND row_number() OVER (PARTITION BY conv_id, turn, claim, kind, value ORDER BY pos, n) > 1 AS again FROM (
    SELECT *, sum(CASE WHEN kind = 'text' AND regexp_matches(value, '\S') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos, n) AS claim FROM (
    SELECT conv_id, turn, pos, unnest(range(len(ids))) AS n, unnest(ids) AS value, kind FROM (SELECT conv_id, turn, pos, CASE WHEN regexp_full_match(part, '{_CITED}') THEN list_filter([trim(x) for x in regexp_split_to_array(substr(part, 2, length(part) - 2), '\s*[,;]\s*')], lambda x: x <> '') ELSE [part] END AS ids,
        CASE WHEN regexp_full_match(part, '{_CITED}') THEN 'citation' ELSE 'text' END AS kind
    FROM (SELECT conv_id, turn, unnest(range(len(p))) AS pos, unnest(p) AS part FROM (SELECT conv_id, turn, list_filter(string_split(regexp_replace(body, '{_CITED}', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM f_cited_text)))))) WHERE NOT again)"""


@query("SELECT conv_id, turn, CAST(place AS INT) AS place, kind, value FROM f_seg")
def t4_citation_segments(spark, d):
    return summaries.segments(cited_texts(spark, d), ["conv_id", "turn"])


@query(r"""SELECT conv_id, turn, CAST(g - 1 AS INT) AS place, CASE WHEN bool_or(kind = 'citation') THEN 'sources' ELSE 'text' END AS kind, string_agg(value, ' | ' ORDER BY place) AS value FROM (SELECT *, sum(CASE WHEN kind = 'citation' AND coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY place) AS g FROM (
    SELECT *, lag(kind = 'citation') OVER (PARTITION BY conv_id, turn ORDER BY place) AS before FROM (SELECT *, lag(kind) OVER w AS a, lead(kind) OVER w AS b FROM f_seg WINDOW w AS (PARTITION BY conv_id, turn ORDER BY place)) WHERE kind = 'citation' OR regexp_matches(value, '\S') OR coalesce(a, '') <> 'citation' OR coalesce(b, '') <> 'citation')) GROUP BY conv_id, turn, g""")
def t4_grouped_sources(spark, d):
    found = summaries.grouped(summaries.segments(cited_texts(spark, d), ["conv_id", "turn"]), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "place", "kind", F.array_join("values", " | ").alias("value"))


_FLAG = "Verify adverse credit and director history externally"
_HISTORY = "Review the missing banking history; verify tax filing acceptance and payment records."


@query(f"""SELECT application_id, CAST(row_number() OVER (PARTITION BY application_id ORDER BY part, ord, flag) AS INT) AS place, flag FROM (SELECT application_id, flag, min((part, ord)).part AS part, min((part, ord)).ord AS ord FROM (
    SELECT application_id, 0 AS part, 0 AS ord, '{_FLAG}' AS flag FROM f_inventory UNION ALL SELECT application_id, 0, 1, '{_HISTORY}' FROM f_inventory WHERE missing_months <> ''
    UNION ALL SELECT application_id, 1, i, w FROM (SELECT application_id, unnest(string_split(warnings, ' | ')) AS w, unnest(range(len(string_split(warnings, ' | ')))) AS i FROM f_ev_bundle) WHERE w <> ''
    UNION ALL SELECT application_id, 2, finding_ord, code || ': ' || message FROM f_package_finding WHERE severity <> 'info') GROUP BY application_id, flag)""".replace("min((part, ord)).part", "min({'part': part, 'ord': ord}).part").replace("min((part, ord)).ord", "min({'part': part, 'ord': ord}).ord"))
def r13_review_flags(spark, d):
    """Flags of the dimensions, warnings of the retrieval, then findings, each where it first appears."""
    inv = packages.inventory_of(spark, d)
    own = inv.select("application_id", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("ord"), F.lit(_FLAG).alias("flag")), F.when(F.col("missing_months") != "", F.struct(F.lit(1).alias("ord"), F.lit(_HISTORY).alias("flag")))))).alias("_f")).select("application_id", "_f.*")
    warnings = retrieval.v6_bundle_status(spark, d).select("application_id", F.posexplode(F.filter(F.split("warnings", r" \| "), lambda w: w != "")).alias("ord", "flag"))
    found = packages.r8_package_findings(spark, d).where("severity <> 'info'").select("application_id", F.col("finding_ord").alias("ord"), F.concat("code", F.lit(": "), "message").alias("flag"))
    return summaries.review_flags(own, warnings, found)


findings = shared(
    "f_said_finding",
    """SELECT application_id, finding_ord, code, severity, message, detail || ':page:1' AS a, detail || ':page:2' AS b FROM f_package_finding UNION ALL SELECT application_id, 2199023255552 + finding_ord, code, CASE WHEN finding_ord % 2 = 1 THEN 'critical' ELSE 'info' END, substr(message, 1, 60), chunk_id, chunk_id FROM f_ev_finding""",
)
bodies = shared("f_said_body", "SELECT application_id, CASE WHEN length(application_id) % 2 = 0 THEN 'The package shows MISSING_CORE_DOCUMENTS.' ELSE 'Nothing is said of CHECK_1 or DUPLICATE_DOCUMENT.' END AS body FROM f_ev_package_id")


@query("""SELECT application_id, body || coalesce(chr(10) || chr(10) || 'System validation checks:' || chr(10) || string_agg(line, chr(10) ORDER BY finding_ord), '') AS body FROM f_said_body LEFT JOIN (
    SELECT application_id, finding_ord, code || ' (' || upper(severity) || '): ' || message || ' ' || CASE WHEN len(t) = 0 THEN '(package inventory check)' ELSE array_to_string([('[' || x || ']') for x in t], ' ') END AS line FROM (
    SELECT f.*, list_filter(CASE WHEN a = b THEN [a] ELSE [a, b] END, lambda x: list_contains(ids, x)) AS t FROM f_said_finding f JOIN f_said_body USING (application_id) JOIN (SELECT application_id, list(chunk_id) AS ids FROM f_ev_chunk GROUP BY 1) USING (application_id)
    WHERE severity <> 'info' AND NOT contains(body, code))) USING (application_id) GROUP BY application_id, body""")
def r18_unmentioned_findings(spark, d):
    """Bodies with what they leave out of the package's findings."""
    rows = findings(spark, d).withColumn("citations", F.array("a", "b")).drop("a", "b")
    return summaries.with_checks(bodies(spark, d), rows, retrieval.evidence_chunks(spark, d))
