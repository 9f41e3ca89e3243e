"""Positioned text with known results: rows, columns, cells, statements, accounts, accuracy."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from packaudit.operators import layout

SPAN = "document_id string, page long, i long, x0 double, y0 double, x1 double, y1 double, text string"
HEADER = [("Date", 40), ("Description", 110), ("Debit (RM)", 320), ("Credit (RM)", 400), ("Balance (RM)", 480)]


def spans(spark, *rows, doc="d"):
    """rows: (page, y, [(text, x), ...])."""
    made, i = [], 0
    for page, y, cells in rows:
        for text, x in cells:
            made.append((doc, page, i, float(x), y - 4.0, x + 5.0 * len(text), y + 4.0, text))
            i += 1
    return spark.createDataFrame(made, SPAN)


def texts(rows):
    return [r["text"] for r in rows.orderBy("page", "row_ord").collect()]


def test_a_row_follows_its_mean(spark):
    near = spans(spark, (1, 10.0, [("a", 1)]), (1, 12.9, [("b", 2)]), (1, 14.0, [("c", 3)]), (1, 15.4, [("d", 4)]))
    # means: 10, 11.45, 12.3; 15.4 is 3.1 off
    assert texts(layout.row_clusters(near)) == ["a b c", "d"]
    assert texts(layout.row_buckets(near)) == ["a", "b", "c d"]


def test_cells_go_from_left_to_right_on_each_page(spark):
    two = spans(spark, (2, 10.0, [("right", 90), ("left", 1)]), (1, 10.0, [("first", 5)]))
    assert texts(layout.row_clusters(two)) == ["first", "left right"]


def plain(money):
    return [(1, 20.0, [("BANK A", 40)]), (1, 30.0, [("Account Holder", 40), (": ACME", 120)]), (1, 40.0, [("Account Number : 77", 40)]), (1, 50.0, [("Statement Period : 01 Jan 2025 - 31 Jan 2025", 40)]), (1, 70.0, HEADER), *money] + [
        (1, 300.0 + 10 * n, [(f"{label} : RM 1,000.00", 40)]) for n, label in enumerate(layout.BANK_TOTALS.values())
    ]


def test_a_statement(spark):
    rows = [(1, 90.0, [("05/01/2025", 40), ("Card", 110), ("fee", 150), ("1,050.00", 325), ("950.00", 490)]), (1, 100.0, [("06/01/2025", 40), ("10.00", 405), ("-960.00", 490)])]
    head, found = layout.bank_statements(layout.row_clusters(spans(spark, *plain(rows))))
    h = head.first()
    assert (h["bank_name"], h["account_holder"], h["account_number"], h["period_start"], h["period_end"], h["opening"], h["reason"]) == ("BANK A", "ACME", "77", date(2025, 1, 1), date(2025, 1, 31), D(1000), None)
    assert [(r["row_index"], r["txn_date"], r["description"], r["reference_no"], r["debit"], r["credit"], r["balance"]) for r in found.orderBy("row_index").collect()] == [
        (0, date(2025, 1, 5), "Card fee", None, D(1050), None, D(950)),
        (1, date(2025, 1, 6), "", None, None, D(10), D(-960)),
    ]
    assert (found.where("row_index = 0").first()["x0"], found.where("row_index = 0").first()["y1"]) == (40.0, 94.0)


@pytest.mark.parametrize(
    "cells, reason",
    [
        ([("05/01/2025", 40), ("x", 110), ("1.00", 330), ("2.00", 335), ("9.00", 490)], "two values for debit"),
        ([("05/01/2025", 40), ("x", 110), ("1.00", 330)], "no balance"),
        ([("05/01/2025", 40), ("x", 110)], "no amount"),
        ([("31/02/2025", 40), ("1.00", 330), ("9.00", 490)], "no such date"),
    ],
)
def test_a_bad_row_rejects_its_document_alone(spark, cells, reason):
    bad = spans(spark, *plain([(1, 90.0, cells)]))
    good = spans(spark, *plain([(1, 90.0, [("05/01/2025", 40), ("1.00", 330), ("9.00", 490)])]), doc="good")
    head, found = layout.bank_statements(layout.row_clusters(bad.unionByName(good)))
    assert {r["document_id"]: r["reason"] for r in head.collect()} == {"d": reason, "good": None}
    assert [r["document_id"] for r in found.collect()] == ["good"]


def test_a_missing_column_is_named(spark):
    rows = [(1, 70.0, [c for c in HEADER if "Credit" not in c[0]]), (1, 90.0, [("05/01/2025", 40), ("1.00", 330), ("9.00", 490)])]
    assert [r["missing"] for r in layout.header_columns(layout.row_clusters(spans(spark, *rows))).collect()] == ["credit"]


def test_the_longest_alias_sets_the_centre(spark):
    rows = [(1, 70.0, [("Transaction Date", 40), ("Details", 130), ("Money Out", 300), ("Money In", 400), ("Running  Balance", 480)]), (1, 90.0, [("05/01/2025", 40)])]
    (r,) = layout.header_columns(layout.row_clusters(spans(spark, *rows))).collect()
    assert (r["date"], r["debit"], r["credit"], r["reference"], r["missing"]) == (80.0, 322.5, 420.0, None, "")
    assert r["balance"] == 520.0  # the whole of the squeezed text


def test_ties_go_to_the_column_listed_first(spark):
    rows = [(1, 70.0, [("Date", 10), ("Details", 60), ("Debit", 100), ("Credit", 197.5), ("Balance", 400)]), (1, 90.0, [("05/01/2025", 10), ("9.00", 400), ("1.00", 152.5)])]
    # centres 112.5 and 212.5, the cell at 162.5
    (r,) = layout.with_transactions(layout.row_clusters(spans(spark, *rows))).where("txn is not null").collect()
    assert (r["txn"]["debit"], r["txn"]["credit"], r["txn"]["balance"], r["error"]) == (D(1), None, D(9), None)


def accounts(spark, skip=(), year="31 December 2024", extra=()):
    lines = [(1, 100.0 + 12 * n, [(label, 40), ("(10.00)" if name in layout.EXPENSES else "10.00", 300), ("-", 350), ("(4.50)" if name in ("ebit", *layout.EXPENSES) else "1,004.50", 400)]) for n, (label, name) in enumerate(layout.LINES.items()) if name not in skip]
    return spans(spark, (1, 10.0, [("ACME Sdn Bhd", 40)]), (1, 22.0, [(f"For the financial year ended {year}", 40)]), (1, 34.0, [("Audited by: Firm X", 40)]), *extra, *lines)


def test_two_periods(spark):
    header = (1, 46.0, [("INCOME STATEMENT Revenue", 40), ("7.00", 200), ("7.00", 260)])
    early = (1, 58.0, [("Revenue policy", 40), ("3.00", 200)])
    head, found = layout.two_periods(layout.row_buckets(accounts(spark, extra=(header, early))))
    assert (head.first()["company_name"], head.first()["auditor"], head.first()["year_end"], head.first()["reason"]) == ("ACME Sdn Bhd", "Firm X", date(2024, 12, 31), None)
    now, before = found.orderBy("period_index").collect()
    assert (now["period_end"], now["revenue"], now["cost_of_sales"]) == (date(2024, 12, 31), D(10), D(10))
    assert (before["period_end"], before["revenue"], before["ebit"], before["interest_expense"]) == (date(2023, 12, 31), D("1004.50"), D("-4.50"), D("4.50"))


def test_thousands_and_rejects(spark):
    _, found = layout.two_periods(layout.row_buckets(accounts(spark, extra=((1, 46.0, [("in RM'000", 40)]),))))
    assert found.where("period_index = 0").first()["revenue"] == D(10000)
    reasons = [layout.two_periods(layout.row_buckets(accounts(spark, **k)))[0].first()["reason"] for k in ({"skip": ("ebit", "revenue")}, {"year": "29 February 2024"}, {"year": "30 February 2024"})]
    assert reasons == ["lines not found: ebit, revenue", "no such date a year before", "no such date"]


def test_registration_and_tax_return(spark):
    lines = ["Company Name: ACME", "Registration Number: 1", "Date of Incorporation: 15 January 2024", "Company Type: X", "Business Address: Y", "Paid-Up Capital: RM 1,000.50", "Directors:", "1. A B - NRIC: 12 - Role: Chair"]
    form = lambda x: layout.row_buckets(spans(spark, *[(1, 10.0 + 12 * n, [(t, 40)]) for n, t in enumerate(x)]))
    head, people = layout.registrations(form(lines))
    assert (head.first()["paid_up_capital"], head.first()["incorporation_date"], head.first()["director_count"], head.first()["reason"]) == (D("1000.50"), date(2024, 1, 15), 1, None)
    assert people.first()["name"] == "A B"
    assert layout.registrations(form(lines[:-1]))[0].first()["reason"] == "no directors"
    assert layout.registrations(form(lines[:3] + lines[4:]))[0].first()["reason"] == "not found: Company Type"
    tax = ["Company Name: ACME", "Tax Reference Number: C 1", "Year of Assessment: 2025", "Gross Business Income: RM 10.00", "Chargeable Income: RM 3.00", "Tax Payable: RM 0.72"]
    assert layout.tax_returns(form(tax)).first()["tax_payable"] == D("0.72")
    assert layout.tax_returns(form(tax[:5])).first()["reason"] == "fields not found"


def test_accuracy(spark):
    schema = "document_id string, kind string, field string, number decimal(18,2), text string"
    expected = spark.createDataFrame([("d", "k", "a", D("1.00"), None), ("d", "k", "b", D("1.00"), None), ("d", "k", "c", None, None), ("d", "k", "e", None, "x"), ("d", "k", "only here", None, "x")], schema)
    actual = spark.createDataFrame([("d", "k", "a", D("1.01"), None), ("d", "k", "b", D("1.02"), None), ("d", "k", "c", None, None), ("d", "k", "e", D("1.00"), None)], schema)
    found = layout.compared(expected, actual)
    assert {r["field"]: r["matched"] for r in found.collect()} == {"a": True, "b": False, "c": True, "e": False}
    groups = spark.createDataFrame([("k",), ("none",)], "kind string")
    assert {r["kind"]: r["accuracy"] for r in layout.accuracy(found, ["kind"], groups).collect()} == {"k": 0.5, "none": 1.0}


def test_rules_part_where_spans_are_shifted(spark):
    moved = layout.shifted(spans(spark, *plain([(1, 90.0, [("05/01/2025", 40), ("1.00", 330), ("9.00", 490)])])), {"none": (0, 0), "jitter": (18, 1.4)})
    by = {n: {r["document_id"]: r["reason"] for r in layout.bank_statements(g(moved))[0].collect()} for n, g in (("mean", layout.row_clusters), ("bucket", layout.row_buckets))}
    assert by["mean"] == {"none|d": None, "jitter|d": None}
    assert by["bucket"]["none|d"] is None and by["bucket"]["jitter|d"] is not None


def test_rows_around_the_reach_are_those_of_a_plain_loop(spark):
    """Low strips are one row without a fold; strips as high as the reach and higher are folded."""
    import random

    rng, spans, want = random.Random(3), [], {}
    for n in range(60):
        ys = sorted(rng.choice([0.0, 1.4, 2.9, 3.0, 3.1, 4.5, 6.0, 9.0, 12.1]) for _ in range(rng.randrange(1, 9)))
        spans += [(f"d{n}", 1, i, 40.0 + i, y - 4, 50.0 + i, y + 4, f"t{i}") for i, y in enumerate(ys)]
        rows, total, count = [], 0.0, 0
        for i, y in enumerate(ys):
            if not rows or abs(y - total / count) > 3.0:
                rows, total, count = rows + [[]], 0.0, 0
            rows[-1].append(f"t{i}")
            total, count = total + y, count + 1
        want[f"d{n}"] = [" ".join(r) for r in rows]
    frame = spark.createDataFrame(spans, "document_id string, page long, i long, x0 double, y0 double, x1 double, y1 double, text string")
    found = {}
    for r in layout.row_clusters(frame).orderBy("document_id", "row_ord").collect():
        found.setdefault(r["document_id"], []).append(r["text"])
    assert found == want


def test_amounts_in_thousands_are_those_of_the_sql(spark):
    """Halves of a cent after a division by 1,000 fall as in DuckDB, which divides doubles."""
    import duckdb

    from packaudit.plans.shared import _said

    values = ["1048215.00", "2474865.00", "58105.00", "95884373105.00", "10339352025.00", "-2531805.00", "0.00", "12345678.91"]
    sql = [_said("SELECT INUNITS(current) AS a FROM (VALUES {}) AS t(current, unit)".format(", ".join(f"(CAST('{v}' AS DECIMAL(18,2)), {u})" for v in values for u in (1, 1000))), engine) for engine in (0, 1)]
    assert [r["a"] for r in spark.sql(sql[0]).collect()] == [r[0] for r in duckdb.execute(sql[1]).fetchall()]


def test_statements_are_compared_in_one_pass(spark):
    """The rows are clustered once, a document that can't be read stays without fields, and verdicts are those of the long form."""
    bad = spans(spark, *plain([(1, 90.0, [("05/01/2025", 40), ("1.00", 330)])]), doc="bad")
    good = spans(spark, *plain([(1, 90.0, [("05/01/2025", 40), ("1.00", 330), ("9.00", 490)]), (1, 100.0, [("06/01/2025", 40), ("2.00", 330), ("7.00", 490)])]), doc="good")
    read = layout.whole_statements(layout.row_clusters(bad.unionByName(good)))
    heads = spark.createDataFrame([("good", "BANK A", 2), ("bad", "BANK A", 1)], "document_id string, bank_name string, transaction_count long")
    rows = spark.createDataFrame([("good", 0, D("1.01"), date(2025, 1, 5)), ("good", 1, D("2.02"), None), ("good", 2, D("3.00"), None), ("bad", 0, D("1.00"), None)], "document_id string, row_index int, debit decimal(18,2), txn_date date")
    found = layout.compared_statements(read, heads, rows, ["bank_name", "transaction_count"], ["debit", "txn_date"], every=True)
    assert sorted((r["document_id"], r["field"] or "", r["matched"], r["expected"], r["actual"]) for r in found.collect()) == [
        ("bad", "", None, None, None),
        ("good", "bank_name", True, "BANK A", "BANK A"),
        ("good", "transaction_count", True, "2", "2"),
        ("good", "transactions[0].debit", True, "1.01", "1.00"),
        ("good", "transactions[0].txn_date", True, "2025-01-05", "2025-01-05"),
        ("good", "transactions[1].debit", False, "2.02", "2.00"),
        ("good", "transactions[1].txn_date", False, None, "2025-01-06"),
    ]
    assert found._jdf.queryExecution().executedPlan().toString().count("sort_array(collect_list(struct(_y") <= 2
    long = lambda f, names, p=None: layout.long_form(f, "bank_statement", names, p)
    statements, txns = layout.bank_statements(layout.row_clusters(bad.unionByName(good)))
    place = F.concat(F.lit("transactions["), "row_index", F.lit("]."))
    want = layout.compared(long(heads, ["bank_name", "transaction_count"]).unionByName(long(rows, ["debit", "txn_date"], place)), long(statements.where("reason is null"), ["bank_name", "transaction_count"]).unionByName(long(txns, ["debit", "txn_date"], place)))
    got = layout.compared_statements(read, heads, rows, ["bank_name", "transaction_count"], ["debit", "txn_date"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
