"""Completeness, package findings, readiness and entries with known results."""

from datetime import date

from packaudit.operators import evidence, inventory, records

DOCS = "application_id string, document_id string, upload_ord long, kind string, sha256 string, page_count long, status string"


def documents(spark, *more):
    rows = [("a", str(i), i, kind, f"h{i}", 2, "extracted") for i, kind in enumerate(inventory.CORE_KINDS)]
    return spark.createDataFrame([*rows, *more], DOCS)


def statements(spark, months):
    return spark.createDataFrame([("a", date(2024, m, 1)) for m in months] + [("a", date(2023, 5, 1))], "application_id string, period_start date")


def made(spark, docs, months=range(1, 13)):
    years = spark.createDataFrame([("a", 2023), ("a", 2022), ("a", 2023)], "application_id string, year int")
    return inventory.package_inventory(docs, statements(spark, months), years)


def test_a_package_without_gaps_is_complete(spark):
    r = made(spark, documents(spark)).first()
    assert (r["complete"], r["missing_months"], r["financial_years"], r["page_count"]) == (True, "", "2022,2023", 8)


def test_a_missing_month_makes_it_incomplete(spark):
    r = made(spark, documents(spark), [m for m in range(1, 13) if m not in (3, 11)]).first()
    assert (r["complete"], r["missing_months"]) == (False, "2024-03,2024-11")


def test_findings_and_actions_in_their_order(spark):
    docs = documents(spark, ("a", "9", 9, "bank_statement", "h1", 1, "parse_failed")).where("kind <> 'tax_return'")
    inv = made(spark, docs, [1, 2]).cache()
    found = inventory.package_findings(inv, inventory.duplicate_documents(docs)).orderBy("finding_ord").collect()
    assert [(r["code"], r["message"]) for r in found] == [
        ("DUPLICATE_DOCUMENT", "Document 9 duplicates another uploaded PDF."),
        ("MISSING_BANK_MONTHS", "Missing bank coverage for: 2024-03, 2024-04, 2024-05, 2024-06, 2024-07, 2024-08, 2024-09, 2024-10, 2024-11, 2024-12"),
        ("MISSING_CORE_DOCUMENTS", "Missing core document types: tax_return"),
        ("DOCUMENT_EXTRACTION_FAILURES", "1 document(s) could not be extracted or indexed."),
    ]
    ratios = spark.createDataFrame([("a", None), ("b", 1.5)], "application_id string, debt_service double")
    actions = evidence.readiness(inv, ratios).orderBy("place").collect()
    assert [(r["action"], r["title"], r["dimensions"]) for r in actions] == [
        ("missing-tax_return", "Request tax return", "Character,Conditions"),
        ("bank-coverage", "Review 10 missing bank months", "Character,Capacity"),
        ("failed-documents", "Resolve 1 unprocessed document", ""),
        ("duplicates", "Review 1 duplicate upload", ""),
        ("repayment-schedule", "Verify debt-service obligations", "Capacity"),
    ]


def test_entries_need_a_title_and_a_fitting_status(spark):
    rows = [("test", "passed", "x"), ("test", "open", "x"), ("bug", "resolved", "x"), ("note", "recorded", " \t"), ("note", "recorded", None), ("note", "recorded", "x"), ("other", "open", "x"), (None, "open", "x")]
    found = records.compatible(spark.createDataFrame(rows, "category string, status string, title string")).collect()
    assert [r["compatible"] for r in found] == [True, False, True, False, False, True, False, False]


def test_human_checks(spark):
    from packaudit.operators import rating

    said = ["DUP : see it", "Get the repayment schedule", "debt service too", " ", "Other!", "other", "dup", "Audited financials of 2024"]
    checks = spark.createDataFrame([("a", i, t) for i, t in enumerate(said)], "application_id string, ord int, check string")
    codes = spark.createDataFrame([("a", "DUP")], "application_id string, code string")
    found = rating.human_checks(checks, codes).orderBy("place").collect()
    assert [(r["place"], r["check"]) for r in found] == [(1, "Get the repayment schedule"), (2, "Other!"), (3, "dup"), (4, "Audited financials of 2024")]


def test_rating_and_guards(spark):
    from decimal import Decimal as D

    from packaudit.operators import rating

    none = "application_id string, "
    packages = spark.createDataFrame([("a",), ("b",)], "application_id string")
    metrics = spark.createDataFrame([("a", i, f"d{i}", D("600.25")) for i in (1, 2, 3, 4)], none + "ord int, document_id string, net_change decimal(18,2)")
    findings = spark.createDataFrame([("a", "warning"), ("b", "critical")], none + "severity string")
    ratios = spark.createDataFrame([("a", 1, "f1", D("1.5"), "acceptable", None, None, "2024-12-31", D(5), D(7), None)], none + "ord int, document_id string, debt_to_equity decimal(18,4), debt_band string, current_ratio decimal(18,4), debt_service decimal(18,4), period_end string, cash_from_operations decimal(18,2), ebit decimal(18,2), interest_coverage decimal(18,4)")
    citable = spark.createDataFrame([("a", "d1:summary:0"), ("a", "d4:summary:0"), ("a", "f1:period:0"), ("a", "m:page:2")], none + "chunk_id string")
    of = rating.facts(packages, metrics, findings, ratios, citable)
    rated = rating.ratings(of)
    got = {(r["application_id"], r["dimension"]): (r["rating"], r["evidence"]) for r in rated.collect()}
    assert got["a", "Character"] == ("adequate", ["d1:summary:0"]) and got["a", "Capacity"][0] == "strong" and got["a", "Capital"] == ("strong", ["f1:period:0"])
    assert got["b", "Character"] == ("weak", []) and got["b", "Capital"] == ("insufficient_data", []) == got["b", "Capacity"]
    reasons = {r["dimension"]: r["reasoning"] for r in rated.where("application_id = 'a'").collect()}
    assert reasons["Capacity"] == "Across 4 bank statements, aggregate net movement is RM 2,401.00."
    assert reasons["Capital"] == "The latest audited debt-to-equity ratio is 1.5000 and current ratio is None."
    supplied = spark.createDataFrame([("b", True, True)], none + "has_registration boolean, has_tax_return boolean")
    dense = spark.createDataFrame([("a", ["50.0", "62.5"], ["m:page:2", "n:page:1"])], none + "percentages array<string>, chunk_ids array<string>")
    after = {(r["application_id"], r["dimension"]): r for r in rating.guarded(rated, of, spark.createDataFrame([("x",)], "application_id string"), supplied, dense, citable).collect()}
    assert after["a", "Character"]["rating"] == "adequate" and after["b", "Character"]["rating"] == "insufficient_data"
    assert "SSM registration and a tax return alone do not verify" in after["b", "Character"]["reasoning"]
    assert after["a", "Capacity"]["evidence"] == ["d1:summary:0", "f1:period:0"] and after["b", "Capacity"]["flags"][-1] == rating.OBTAIN
    assert after["a", "Capacity"]["reasoning"].endswith("For FY 2024-12-31, reported cash from operations is RM5.00, EBIT is RM7.00 and interest coverage is None.")
    assert (after["a", "Conditions"]["rating"], after["a", "Conditions"]["evidence"]) == ("weak", ["d1:summary:0", "m:page:2"]) and "of 50% and 62.5%." in after["a", "Conditions"]["reasoning"]
