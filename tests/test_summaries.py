"""Paragraphs, headings, flags and unmentioned findings against written-out rows."""

from packaudit.operators import summaries
from pyspark.sql import functions as F


def headings(spark, body):
    rows = spark.createDataFrame([(body,)], "body string").select(F.explode(summaries.paragraphs(F.col("body"))).alias("p"))
    return [tuple(r) for r in rows.select("p", summaries.heading(F.col("p"))).collect()]


def test_paragraphs_and_headings(spark):
    body = "**Character:** fine. Finally, the Capital is low.  The Capital is low.\n\n\nCharacter of note.\n\nSystem validation checks:\nX"
    assert headings(spark, body) == [
        ("Character: fine. Finally, the Capital is low.", "Character"),  # "the" in small letters begins nothing
        ("The Capital is low.", "Capital"),
        ("Character of note.", "Assessment detail"),
        ("System validation checks:\nX", "System checks"),
    ]
    assert headings(spark, "") == [] and headings(spark, " \n\n ") == []
    assert headings(spark, None) == []


def test_flags_in_order_of_first_appearance(spark):
    a = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (2, 0, "x")], "application_id int, ord int, flag string")
    b = spark.createDataFrame([(1, 0, "z"), (1, 1, "a"), (1, 2, "0"), (1, 3, "z")], "application_id int, ord int, flag string")
    rows = summaries.review_flags(a, b).orderBy("application_id", "place").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "b"), (1, 2, "a"), (1, 3, "z"), (1, 4, "0"), (2, 1, "x")]


def test_findings_that_a_body_leaves_out(spark):
    fields = "application_id int, finding_ord int, code string, severity string, message string, citations array<string>"
    found = [
        (1, 3, "LEFT", "warning", "two months", ["c2", "no", "c1", "c2"]),
        (1, 1, "SAID", "critical", "said", ["c1"]),
        (1, 2, "FIRST", "critical", "no documents", ["no"]),
        (1, 4, "NOTE", "info", "note", ["c1"]),
        (2, 1, "SAID", "critical", "said", []),
    ]
    bodies = spark.createDataFrame([(1, "SAID and done"), (2, "SAID too"), (3, "nothing")], "application_id int, body string")
    citable = spark.createDataFrame([(1, "c1"), (1, "c2"), (2, "no")], "application_id int, chunk_id string")
    rows = summaries.with_checks(bodies, spark.createDataFrame(found, fields), citable).orderBy("application_id").collect()
    assert [r.body for r in rows] == [
        "SAID and done\n\nSystem validation checks:\nFIRST (CRITICAL): no documents (package inventory check)\nLEFT (WARNING): two months [c2] [c1]",
        "SAID too",
        "nothing",
    ]


def parts(spark, text):
    return summaries.segments(spark.createDataFrame([(1, text)], "id int, body string"), ["id"])


def test_citation_segments(spark):
    def cited(text):
        return [r.value for r in parts(spark, text).where("kind = 'citation'").orderBy("place").collect()]

    assert cited("A [one:summary:0, one:summary:0][two:summary:0] [one:summary:0]. B [one:summary:0]") == ["one:summary:0", "two:summary:0", "one:summary:0"]
    rows = parts(spark, "Evidence [package/facility:page:4] [estimated]").orderBy("place").collect()
    assert [(r.kind, r.value) for r in rows] == [("text", "Evidence "), ("citation", "package/facility:page:4"), ("text", " [estimated]")]
    assert parts(spark, "").collect() == []


def test_grouped_citations(spark):
    def groups(text):
        rows = summaries.grouped(parts(spark, text), ["id"]).orderBy("place").collect()
        return [(r.kind, r["values"]) for r in rows]

    assert groups("A [one:page:1] [two:page:2]. B [one:page:1]") == [("text", ["A "]), ("sources", ["one:page:1", "two:page:2"]), ("text", [". B "]), ("sources", ["one:page:1"])]
    assert groups("[estimated] [one:period:0]  ") == [("text", ["[estimated] "]), ("sources", ["one:period:0"]), ("text", ["  "])]


def test_citations_are_looked_up_one_by_one(spark):
    """Equal findings stay apart, citations keep their order, and no row carries the ids of its package."""
    from packaudit.operators import summaries

    bodies = spark.createDataFrame([("a", "Nothing."), ("b", "Names X.")], "application_id string, body string")
    found = [("a", 2, "X", "warning", "m", ["c2", "gone", "c1", "c2"]), ("a", 2, "X", "warning", "m", ["c2", "gone", "c1", "c2"]), ("a", 1, "Y", "critical", "n", []), ("b", 1, "X", "warning", "m", ["c1"])]
    rows = spark.createDataFrame(found, "application_id string, finding_ord long, code string, severity string, message string, citations array<string>")
    citable = spark.createDataFrame([("a", "c1"), ("a", "c1"), ("a", "c2"), ("b", "gone")], "application_id string, chunk_id string")
    made = summaries.with_checks(bodies, rows, citable)
    assert {r["application_id"]: r["body"] for r in made.collect()} == {"a": "Nothing.\n\nSystem validation checks:\nY (CRITICAL): n (package inventory check)\nX (WARNING): m [c2] [c1]\nX (WARNING): m [c2] [c1]", "b": "Names X."}
    assert "array_intersect" not in made._jdf.queryExecution().executedPlan().toString()


def test_registrations_are_cited_once(spark):
    from packaudit.operators import crossdoc

    heads = spark.createDataFrame([("a", "s1", "NOBODY"), ("a", "s2", "NO ONE"), ("b", "s3", "ACME"), ("c", "s4", "NOBODY")], "application_id string, document_id string, account_holder string")
    registered = spark.createDataFrame([("a", "r1", "ACME"), ("a", "r2", "OTHER"), ("b", "r3", "ACME SDN BHD")], "application_id string, document_id string, company_name string")
    cited = sorted((r["application_id"], r["c"]) for r in crossdoc.cited_without_registration(heads, registered, "account_holder").collect())
    assert cited == [("a", f"{d}:summary:0") for d in ("r1", "r2", "s1", "s2")]
    whole = {r["document_id"]: r["citations"] for r in crossdoc.without_registration(heads, registered, "account_holder", "X", joined=True).collect()}
    assert whole == {d: f"{d}:summary:0,r1:summary:0,r2:summary:0" for d in ("s1", "s2")}
