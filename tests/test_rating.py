"""The rating's tables are made once, and names become keys once for each statement or registration."""

import re
from datetime import date
from decimal import Decimal as D

from packaudit.operators import checks, crossdoc
from packaudit.plans import finance, rating, views

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_guards_read_what_was_made_once(spark):
    plan = optimized(rating.r11_guards(spark, SF))
    assert "l_shipdate" not in plan and "trunc(week" not in plan.replace("date_trunc", "trunc")
    made = rating.tables(spark, SF)
    plan = optimized(rating.facts(spark, SF, made))
    assert "l_shipdate" not in plan
    # the ledger's rows are read for the checks on rows alone
    assert len(re.findall(r"Window \[.*row_number", plan)) <= 3 and plan.count("lag(balance") == 1


def test_no_name_is_keyed_below_an_aggregate(spark):
    heads, reg = views.statements(spark, SF), finance.registrations(spark, SF)
    for found in (crossdoc._unmatched(heads, reg, "account_holder"), crossdoc.before_incorporation(heads, reg)):
        depth = None
        for line in optimized(found).splitlines():
            level = len(line) - len(line.lstrip(" :+-"))
            if depth is not None and level <= depth:
                depth = None
            if depth is None and re.match(r"[ :+-]*Aggregate", line):
                depth = level
            elif depth is not None:
                assert "regexp_replace" not in line


def test_rows_are_checked_in_one_pass_as_in_three(spark):
    day = lambda n: date(2024, 1, n)
    rows = [
        ("a", "d", 0, D(10), None, D(110), day(2)),
        ("a", "d", 1, None, D(5), D(104), day(1)),  # a wrong balance, out of order
        ("a", "d", 2, None, None, None, None),
        ("a", "d", 3, D(1), None, D(101), day(9)),  # after a row without a balance the opening counts; outside
        ("a", "d", 4, D(1), None, D(200), day(20)),
        ("a", "d", 5, None, D(1), D(1), day(9)),  # all three
        ("a", "none", 0, D(1), None, D(9), day(20)),  # no statement: only the order is looked at
        ("a", "none", 1, D(1), None, D(9), day(19)),
        ("b", "open", 0, D(1), None, D(9), day(20)),  # neither opening nor end known
    ]
    rows = spark.createDataFrame(rows, "application_id string, document_id string, row_index int, credit decimal(18,2), debit decimal(18,2), balance decimal(18,2), txn_date date")
    heads = spark.createDataFrame([("d", D(100), day(1), day(8)), ("open", None, day(1), None)], "document_id string, opening decimal(18,2), period_start date, period_end date")
    three = checks.running_balance(rows, heads).unionByName(checks.date_outside_period(rows, heads)).unionByName(checks.date_out_of_order(rows)).drop("row_index")
    got, expected = (sorted(map(str, x.select(*three.columns).collect())) for x in (checks.of_rows(rows, heads), three))
    assert got == expected and len(got) == 9
