"""Small cases with known results."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from packaudit.functions.money import parsed_money
from packaudit.functions.names import core_name, name_key, normal_name
from packaudit.operators import cashflow, checks, chunks, evidence, extraction, history, inventory, ratios, records
from packaudit.streaming import jobs

HEAD = "application_id string, document_id string, account_number string, account_holder string, period_start date, period_end date, opening decimal(18,2), closing decimal(18,2), total_credits decimal(18,2), total_debits decimal(18,2)"
ROWS = "application_id string, document_id string, row_index int, txn_date date, description string, credit decimal(18,2), debit decimal(18,2), balance decimal(18,2)"


def head(spark, closing=1050, start=date(2026, 1, 1), end=date(2026, 1, 31)):
    return spark.createDataFrame([("a", "doc-1", "1", "ACME", start, end, D(1000), D(closing), D(100), D(50))], HEAD)


def rows(spark, *more):
    base = [("a", "doc-1", 0, date(2026, 1, 5), "DEPOSIT", D(100), None, D(1100)), ("a", "doc-1", 1, date(2026, 1, 10), "WITHDRAWAL", None, D(50), D(1050))]
    return spark.createDataFrame([*base, *more], ROWS)


def test_a_sound_statement(spark):
    h, r = head(spark), rows(spark)
    m = checks.statement_metrics(r, h).first()
    assert (m["days"], m["transaction_count"], m["net_change"], m["deposit_count"], m["withdrawal_count"], m["largest_credit"], m["largest_debit"]) == (31, 2, 50, 1, 1, 100, 50)
    for found in (checks.balance_arithmetic(h), checks.running_balance(r, h), checks.date_outside_period(r, h), checks.date_out_of_order(r), checks.possible_duplicate(r)):
        assert found.count() == 0


def test_wrong_closing(spark):
    assert [(r["code"], r["citations"]) for r in checks.balance_arithmetic(head(spark, "999.99")).collect()] == [("BALANCE_ARITHMETIC", ["doc-1:summary:0"])]


def test_running_balance_compares_with_the_declared_one(spark):
    bad = spark.createDataFrame([("a", "doc-1", 0, date(2026, 1, 5), "x", D(100), None, D(9999)), ("a", "doc-1", 1, date(2026, 1, 6), "y", None, D(50), D(1050))], ROWS)
    assert [r["row_index"] for r in checks.running_balance(bad, head(spark)).orderBy("row_index").collect()] == [0, 1]


def test_duplicates_and_dates(spark):
    pair = [("a", "doc-1", i, date(2026, 1, 12), "VENDOR PAYMENT", None, D(25), D(1000)) for i in (2, 3)]
    found = checks.possible_duplicate(rows(spark, *pair)).collect()
    assert [f["citations"] for f in found] == [["doc-1:transaction:2", "doc-1:transaction:3"]]
    late = rows(spark, ("a", "doc-1", 2, date(2025, 12, 30), "x", D(1), None, D(1051)))
    assert checks.date_outside_period(late, head(spark)).count() == checks.date_out_of_order(late).count() == 1


@pytest.mark.parametrize(
    "start, end, days", [(date(2025, 1, 1), date(2025, 1, 1), 1), (date(2025, 2, 1), date(2025, 2, 28), 28), (date(2024, 2, 1), date(2024, 2, 29), 29), (date(2025, 4, 1), date(2025, 4, 30), 30)]
)
def test_days(spark, start, end, days):
    assert checks.statement_metrics(rows(spark), head(spark, start=start, end=end)).first()["days"] == days


def test_reversed_period(spark):
    h = head(spark, start=date(2025, 2, 1), end=date(2025, 1, 1))
    assert checks.period_guard(h).count() == 1 and checks.statement_metrics(rows(spark), h).count() == 0


def test_names(spark):
    names = spark.createDataFrame([("ACME TRADING S/B", "ACME TRADING SDN BHD"), ("BETA CORP SDN BHD", "ACME TRADING SDN BHD")], "a string, b string")
    got = names.select((name_key(F.col("a")) == name_key(F.col("b"))).alias("same"), normal_name(F.col("a")).alias("n"), core_name(F.col("a")).alias("c")).collect()
    assert [(r["same"], r["n"], r["c"]) for r in got] == [(True, "ACME TRADING SDN BHD", "ACME"), (False, "BETA CORP SDN BHD", "BETA CORP")]


PERIOD = "application_id string, document_id string, year int, revenue decimal(18,2), ebit decimal(18,2), interest_expense decimal(18,2), net_profit decimal(18,2), current_assets decimal(18,2), current_liabilities decimal(18,2), non_current_liabilities decimal(18,2), total_equity decimal(18,2)"


@pytest.mark.parametrize(
    "values, bands, figures",
    [
        ((1000000, 200000, 20000, 136800, 300000, 150000, 200000, 450000), ["healthy"] * 4, ["2.0000", "0.7778", "0.1368", "10.0000"]),
        ((1000000, 10000, 20000, -50000, 100000, 200000, 600000, 100000), ["distressed"] * 4, None),
        ((1000000, 200000, 0, 136800, 300000, 150000, 200000, 450000), ["healthy"] * 4, ["2.0000", "0.7778", "0.1368", "None"]),
    ],
)
def test_ratios(spark, values, bands, figures):
    df = spark.createDataFrame([("a", "d", 2025, *map(D, values))], PERIOD)
    got = {r["name"]: r for r in ratios.ratio_set(df).collect()}
    names = ["current_ratio", "debt_to_equity", "net_profit_margin", "interest_coverage"]
    assert [got[n]["band"] for n in names] == bands
    if figures:
        assert [str(got[n]["value"]) for n in names] == figures
    assert got["debt_service"]["value"] is None and got["debt_service"]["band"] == "insufficient_data"


def test_allocation_keeps_the_amount(spark):
    s = spark.createDataFrame([("a", "d", "1", "x", date(2025, 1, 20), date(2025, 3, 10), D(0), D(100), D(100), D(0))], HEAD)
    got = {r["month"]: r["allocated"] for r in cashflow.calendar_allocation(s, "total_credits").collect()}
    assert got == {"2025-01": D("24.00"), "2025-02": D("56.00"), "2025-03": D("20.00")}


def test_exclusive_quantile(spark):
    got = spark.createDataFrame([([10.0, 20.0, 30.0, 50.0, 90.0],), ([7.0],)], "x array<double>").select(history.exclusive_p95(F.col("x")).alias("p")).collect()
    assert [r["p"] for r in got] == [pytest.approx(118.0), 7.0]


def test_survey(spark):
    answers = [("a", [5, 1] * 5), ("b", [3] * 10), ("c", [6] + [3] * 9), ("d", [3] * 9), ("e", [1, 5] * 5)]
    got = history.survey_score(spark.createDataFrame(answers, "id string, answers array<int>")).collect()
    assert [(r["score"], r["band"]) for r in got] == [(100, "Excellent"), (50, "OK"), (None, None), (None, None), (0, "Poor")]


def test_document_ids(spark):
    files = spark.createDataFrame([("a", "x/y", 1), ("a", "x/y", 2), ("a", "x/z", 3), ("a", "x/y", 4)], "application_id string, base_id string, upload_ord int")
    assert [r["document_id"] for r in inventory.document_ids(files).orderBy("upload_ord").collect()] == ["x/y", "x/y__2", "x/z", "x/y__3"]


def test_money(spark):
    texts = spark.createDataFrame([("1,234.50",), ("(1,234.50)",), ("n/a",), (" 7 ",)], "t string")
    assert [r["m"] for r in texts.select(parsed_money(F.col("t")).alias("m")).collect()] == [D("1234.50"), D("-1234.50"), None, D("7.00")]


def test_hashing_signs_are_literal(spark):
    """'a' hashes to ca978112 ca...: place 0xca978112 % 768; the fifth byte, 0xca, is even, so -1. 'cash' has an odd one."""
    import hashlib

    got = {r["id"]: (r["idx"], r["weight"]) for r in chunks.hashed_vectors(spark.createDataFrame([(t, t) for t in ("a", "b", "cash", "loan")], "id string, text string")).collect()}
    assert got["a"] == (0xCA978112 % 768, -1)
    for t, (idx, weight) in got.items():
        digest = hashlib.sha256(t.encode()).digest()
        assert (idx, weight) == (int.from_bytes(digest[:4], "big") % 768, 1 if digest[4] & 1 else -1)


def test_citations_in_nested_brackets(spark):
    texts = [("see [a [b:page:1] and [c; WARNING, d] []",)]
    assert spark.createDataFrame(texts, "t string").select(chunks.citations(F.col("t")).alias("c")).first()["c"] == ["b:page:1", "c", "d"]


def test_concentration_lines(spark):
    rows = [("a", "c3", "management_accounts", "Customer concentration: top 52.5 % and 1234%\nSupplier dependence: 70%"), ("a", "c4", "tax_return", "Customer concentration: 90%"), ("a", "c5", "management_accounts", "Growth 80%\nsupplier concentration 49.9%")]
    got = records.concentration(spark.createDataFrame(rows, "application_id string, chunk_id string, kind string, text string")).collect()
    assert [(r["application_id"], r["percentages"], r["chunk_ids"]) for r in got] == [("a", "52.5,70.0", "c3")]


def test_stage_percents(spark):
    got = jobs.progress(spark.createDataFrame([("j", "parse"), ("j", "assess_5c")], "job_id string, stage string")).collect()
    assert [(r["percent"], r["phase"]) for r in got] == [(20, "extracting"), (80, "summarising")]


def test_valid_inline_citations(spark):
    summaries = spark.createDataFrame([(1, "A [x:page:1, y:page:2]. B [y:page:2] [open C.")], "id int, body string")
    got = evidence.valid_inline(summaries, spark.createDataFrame([("x:page:1",)], "cited string"), ["id"]).first()
    assert got["body"] == "A [x:page:1]. B  [open C."


def test_unsupported_critical_wording(spark):
    rows = spark.createDataFrame([("A critical warning was raised.", False), ("A critical warning was raised.", True), ("critically low", False)], "t string, c boolean")
    assert [r[0] for r in rows.select(evidence.unsupported_critical(F.col("t"), F.col("c"))).collect()] == [True, False, False]


def test_document_kinds_in_their_order(spark):
    pages = [
        ("s", 1, "Balance sheet"), ("s", 2, "SURUHANJAYA Syarikat Malaysia"), ("t", 1, "Form C, chargeable income; income statement"), ("a", 1, "cover"), ("a", 2, "income statement"),
        ("b", 1, "Account number 1\nStatement period"), ("u", 1, "cover"), ("u", 2, "Statement of account"), ("m", 1, "MANAGEMENT ACCOUNTS"),
    ]
    got = extraction.document_kinds(spark.createDataFrame(pages, "document_id string, page int, text string")).collect()
    assert {r["document_id"]: r["kind"] for r in got} == {"s": "ssm_registration", "t": "tax_return", "a": "audited_financials", "b": "bank_statement", "u": "unknown", "m": "management_accounts"}


def test_directors_and_units(spark):
    lines = ["1. Too Early - NRIC: 1 - Role: Director", "Directors:", "1. Ann Lee  - NRIC: 80-1 - Role: Managing Director", "not one", "2. Bo - NRIC: 2 - Role: Director"]
    rows = spark.createDataFrame([("d", 1, i, x) for i, x in enumerate(lines)], "document_id string, page int, row_ord int, text string")
    assert [tuple(r) for r in extraction.directors(rows).orderBy("row_index").collect()] == [("d", 0, "Ann Lee", "80-1", "Managing Director"), ("d", 1, "Bo", "2", "Director")]
    units = spark.createDataFrame([("a", "in RM'000"), ("b", "RM thousands"), ("c", "RM 000"), ("d", "rm\u2019 000")], "document_id string, text string")
    assert {r["document_id"]: r["multiplier"] for r in extraction.unit_multiplier(units).collect()} == {"a": 1000, "b": 1000, "c": 1, "d": 1000}
