"""Queries over ledgers, statements, accounts and registrations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from packaudit.functions.money import AMOUNT, half_up
from packaudit.functions.names import SUFFIXES, core_name, name_key, normal_name
from packaudit.operators import cashflow, checks, crossdoc, ratios
from packaudit.plans import views
from packaudit.plans.sql_views import VIEWS, oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}
RAW: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__], RAW[f.__name__] = oracle(sql), sql
        return f

    return add


def flat(df):
    """Citations as one text, so that rows compare in any engine."""
    return df.withColumn("citations", F.array_join("citations", ","))


def tax_by_supplier(spark, d):
    """Gross income by supplier and year, more or less off the audited revenue."""
    gross = half_up(F.col("revenue") * (80 + 5 * (F.col("l_suppkey") % 8)) / 100)
    return views.periods(spark, d).select("application_id", F.concat(F.lit("tax/"), "l_suppkey", F.lit("/"), "year").alias("document_id"), "year", gross.alias("gross_business_income"))


VIEWS["f_tax"] = """SELECT application_id, 'tax/' || l_suppkey || '/' || year AS document_id, year,
    CAST(round(revenue * (80 + 5 * (l_suppkey % 8)) * 0.01, 2) AS DECIMAL(18,2)) AS gross_business_income FROM f_period"""
VIEWS["f_reg"] = """SELECT DISTINCT 'app' || (user_id % 10) AS application_id, 'reg/' || user_id AS document_id, user_id AS registration_ord,
    'CUSTOMER ' || user_id || ' SDN BHD' AS company_name, DATE '2023-12-01' + CAST(user_id % 60 AS INT) AS incorporation_date FROM events WHERE user_id % 11 <> 0"""
VIEWS["f_reg_s"] = """SELECT 'supplier/' || s_suppkey AS application_id, 'reg/' || s_suppkey AS document_id,
    s_name || ([' SDN BHD', ' S/B', ' Sdn. Bhd.', ' HOLDINGS'])[CAST(s_suppkey % 4 + 1 AS INT)] AS company_name FROM supplier WHERE s_suppkey % 10 <> 0"""
# the core of a name in SQL: the suffixes are taken off one after the other
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper({0}), '\bS/B\b', 'SDN BHD', 'g'), '\bSDN\.\s*BHD\.?', 'SDN BHD', 'g'), '[^A-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _core(x: str) -> str:
    out = _NORMAL.format(x)
    for s in SUFFIXES:
        out = rf"trim(regexp_replace({out}, '{s.replace('.', chr(92) + '.')}$', ''))"
    return out


def _key(x: str) -> str:
    return f"CASE WHEN {_core(x)} <> '' THEN '1' || {_core(x)} ELSE '0' || {_NORMAL.format(x)} END"


def registrations(spark, d):
    user = F.col("user_id")
    return views.table(spark, d, "events").where("user_id % 11 <> 0").select("user_id").distinct().select(
        F.concat(F.lit("app"), user % 10).alias("application_id"),
        F.concat(F.lit("reg/"), user).alias("document_id"),
        user.alias("registration_ord"),
        F.concat(F.lit("CUSTOMER "), user, F.lit(" SDN BHD")).alias("company_name"),
        F.date_add(F.lit("2023-12-01").cast("date"), (user % 60).cast("int")).alias("incorporation_date"),
    )


def suffix(number):
    """A company suffix by number."""
    return F.element_at(F.array(F.lit(" SDN BHD"), F.lit(" S/B"), F.lit(" Sdn. Bhd."), F.lit(" HOLDINGS")), (number % 4 + 1).cast("int"))


def supplier_registrations(spark, d):
    return views.table(spark, d, "supplier").where("s_suppkey % 10 <> 0").select(
        F.concat(F.lit("supplier/"), "s_suppkey").alias("application_id"),
        F.concat(F.lit("reg/"), "s_suppkey").alias("document_id"),
        F.concat("s_name", suffix(F.col("s_suppkey"))).alias("company_name"),
    )


@query("SELECT application_id, document_id, 'BALANCE_ARITHMETIC' AS code, 'critical' AS severity, document_id || ':summary:0' AS citations FROM f_stmt WHERE abs(opening + total_credits - total_debits - closing) > 0.01")
def f1_balance_arithmetic(spark, d):
    return flat(checks.balance_arithmetic(views.statements(spark, d)))


@query("""SELECT application_id, document_id, 'RUNNING_BALANCE' AS code, 'critical' AS severity, document_id || ':transaction:' || row_index AS citations, row_index
    FROM (SELECT *, abs(coalesce(lag(balance) OVER (PARTITION BY document_id ORDER BY row_index), 1000) + coalesce(credit, 0) - coalesce(debit, 0) - balance) AS gap FROM f_txn) WHERE gap > 0.01""")
def w1_running_balance(spark, d):
    return flat(checks.running_balance(views.ledger(spark, d), views.statements(spark, d).where("document_id not like '%\\_\\_2'")))


@query("SELECT application_id, document_id, 'DATE_OUTSIDE_PERIOD' AS code, 'warning' AS severity, document_id || ':transaction:' || row_index AS citations, row_index FROM f_txn WHERE txn_date NOT BETWEEN period_start AND period_end")
def f2_date_outside_period(spark, d):
    return flat(checks.date_outside_period(views.ledger(spark, d), views.statements(spark, d)))


@query("""SELECT application_id, document_id, 'DATE_OUT_OF_ORDER' AS code, 'warning' AS severity, document_id || ':transaction:' || row_index AS citations, row_index
    FROM (SELECT *, lag(txn_date) OVER (PARTITION BY document_id ORDER BY row_index) AS b FROM f_txn) WHERE txn_date < b""")
def w2_date_out_of_order(spark, d):
    return flat(checks.date_out_of_order(views.ledger(spark, d)))


@query("""SELECT application_id, document_id, 'POSSIBLE_DUPLICATE' AS code, 'info' AS severity, document_id || ':transaction:' || r || ',' || document_id || ':transaction:' || row_index AS citations, row_index
    FROM (SELECT *, lag(txn_date) OVER w AS b, lag(row_index) OVER w AS r FROM f_txn_whole WINDOW w AS (PARTITION BY document_id, description, debit, credit ORDER BY txn_date, row_index)) WHERE txn_date - b <= 1""")
def w3_possible_duplicate(spark, d):
    return flat(checks.possible_duplicate(views.ledger(spark, d, whole=True)))


def with_totals(spark, d):
    p = views.periods(spark, d)
    liabilities = (F.col("current_liabilities") + F.col("non_current_liabilities")).cast(AMOUNT)
    assets = (liabilities + F.col("total_equity") + F.when(F.col("l_suppkey") % 7 == 0, F.lit("0.02").cast(AMOUNT)).otherwise(0)).cast(AMOUNT)
    return p.withColumns({"total_liabilities": liabilities, "total_assets": assets, "period_index": F.lit(0)})


VIEWS["f_totals"] = """SELECT *, CAST(current_liabilities + non_current_liabilities AS DECIMAL(18,2)) AS total_liabilities, CAST(current_liabilities + non_current_liabilities + total_equity + CASE WHEN l_suppkey % 7 = 0 THEN 0.02 ELSE 0 END AS DECIMAL(18,2)) AS total_assets FROM f_period"""


@query("SELECT application_id, document_id, 'AUDITED_ACCOUNTING_EQUATION' AS code, 'critical' AS severity, document_id || ':period:0' AS citations, 0 AS period_index FROM f_totals WHERE abs(total_assets - total_liabilities - total_equity) > 0.01")
def f3_accounting_equation(spark, d):
    return flat(checks.accounting_equation(with_totals(spark, d)))


@query("""SELECT document_id, CAST(total_credits - total_debits AS DECIMAL(18,2)) AS movement, CASE WHEN user_id % 17 <> 0 THEN CAST(closing - opening - (total_credits - total_debits) AS DECIMAL(18,2)) END AS difference,
    user_id % 17 = 0 OR closing - opening <> total_credits - total_debits AS mismatch FROM f_stmt""")
def f4_display_reconciliation(spark, d):
    s = views.statements(spark, d)
    change = F.when(F.col("user_id") % 17 == 0, "n/a").otherwise((F.col("closing") - F.col("opening")).cast("string"))
    texts = s.select("document_id", F.col("total_credits").cast("string").alias("total_credits"), F.col("total_debits").cast("string").alias("total_debits"), change.alias("net_change"))
    return checks.display_reconciliation(texts).select("document_id", "movement", "difference", "mismatch")


@query("""SELECT application_id, count(*) AS n_files, sum(size) AS n_bytes, CASE WHEN count(*) > 50 THEN 'too_many' WHEN bool_or(upload_ord % 41 = 0) THEN 'not_pdf' WHEN min(size) = 0 THEN 'empty_file' WHEN sum(size) > 60000 THEN 'too_large' END AS problem
    FROM (SELECT application_id, upload_ord, length(text) AS size FROM f_docs) GROUP BY 1""")
def f5_upload_limits(spark, d):
    files = views.documents(spark, d).select(
        "application_id", F.concat("document_id", F.when(F.col("upload_ord") % 41 == 0, ".txt").otherwise(".PDF")).alias("filename"), F.length("text").cast("long").alias("size")
    )
    return checks.upload_verdict(files, bytes_=60000)


@query("SELECT application_id, document_id, 'period ends before it starts' AS reason FROM (SELECT * REPLACE (CASE WHEN user_id % 19 = 0 THEN period_start - 1 ELSE period_end END AS period_end) FROM f_stmt) WHERE period_end < period_start")
def f6_period_guard(spark, d):
    s = views.statements(spark, d)
    return checks.period_guard(s.withColumn("period_end", F.when(F.col("user_id") % 19 == 0, F.date_sub("period_start", 1)).otherwise(F.col("period_end"))))


@query("""SELECT s.application_id, s.document_id, CAST(7 AS BIGINT) AS days, coalesce(n, 0) AS transaction_count, coalesce(c, 0) AS deposit_count, coalesce(w, 0) AS withdrawal_count,
    CAST(total_credits - total_debits AS DECIMAL(18,2)) AS net_change, CAST(round_even(CAST(total_credits AS DECIMAL(18,2)) / 7, 2) AS DECIMAL(18,2)) AS daily_inflow, CAST(round_even(total_debits / 7, 2) AS DECIMAL(18,2)) AS daily_outflow,
    CAST(coalesce(mc, 0) AS DECIMAL(18,2)) AS largest_credit, CAST(coalesce(md, 0) AS DECIMAL(18,2)) AS largest_debit, closing AS closing_balance, round(coalesce(sd, 0), 4) AS balance_spread
    FROM f_stmt s LEFT JOIN (SELECT document_id, count(*) AS n, count(credit) AS c, count(debit) AS w, max(credit) AS mc, max(debit) AS md, stddev_pop(CAST(balance AS DOUBLE)) AS sd FROM f_txn GROUP BY 1) t USING (document_id)""")
def a1_statement_metrics(spark, d):
    return checks.statement_metrics(views.ledger(spark, d), views.statements(spark, d))


_UNIQUE = "(SELECT * FROM f_stmt QUALIFY row_number() OVER (PARTITION BY application_id, account_number, period_start, period_end, opening, closing, total_credits, total_debits ORDER BY document_id) = 1)"


@query(f"SELECT application_id, document_id FROM {_UNIQUE}")
def w5_unique_statements(spark, d):
    return cashflow.unique_statements(views.statements(spark, d)).select("application_id", "document_id")


def _allocated(side: str) -> str:
    return f"""SELECT application_id, document_id, strftime(m, '%Y-%m') AS month, CAST(CASE WHEN m = max(m) OVER w THEN total_{side} - coalesce(sum(s) FILTER (WHERE not last) OVER w, 0) ELSE s END AS DECIMAL(18,2)) AS allocated FROM (
      SELECT *, m = max(m) OVER (PARTITION BY document_id) AS last FROM (
      SELECT *, CAST(round(CAST(total_{side} * (date_diff('day', greatest(period_start, m), least(period_end, last_day(m))) + 1) AS DECIMAL(28,2)) / (date_diff('day', period_start, period_end) + 1), 2) AS DECIMAL(18,2)) AS s
      FROM (SELECT *, CAST(unnest(generate_series(date_trunc('month', period_start), CAST(period_end AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM {_UNIQUE})))
      WINDOW w AS (PARTITION BY document_id)"""


@query(_allocated("credits"))
def w9_calendar_allocation(spark, d):
    rows = cashflow.calendar_allocation(cashflow.unique_statements(views.statements(spark, d)), "total_credits")
    return rows.select("application_id", "document_id", "month", "allocated")


VIEWS["f_monthly"] = f"""SELECT application_id, month, CAST(sum(c) AS DECIMAL(18,2)) AS credits, CAST(sum(b) AS DECIMAL(18,2)) AS debits FROM (
    SELECT application_id, month, allocated AS c, 0 AS b FROM ({_allocated("credits")}) UNION ALL SELECT application_id, month, 0, allocated FROM ({_allocated("debits")})) GROUP BY ALL"""


@query("SELECT * FROM f_monthly")
def a2_monthly_amounts(spark, d):
    return cashflow.monthly_amounts(views.statements(spark, d))


@query(f"""SELECT application_id, statement_count, account_count, total_credits, total_debits, net_change, covered_months FROM (
    SELECT application_id, count(*) AS statement_count, count(DISTINCT account_number) AS account_count, CAST(sum(total_credits) AS DECIMAL(18,2)) AS total_credits,
    CAST(sum(total_debits) AS DECIMAL(18,2)) AS total_debits, CAST(sum(total_credits - total_debits) AS DECIMAL(18,2)) AS net_change FROM {_UNIQUE} GROUP BY 1)
    LEFT JOIN (SELECT application_id, string_agg(month, ',' ORDER BY month) AS covered_months FROM f_monthly GROUP BY 1) USING (application_id)""")
def a3_package_cash_flow(spark, d):
    return cashflow.package_cash_flow(views.statements(spark, d))


VIEWS["f_year"] = """SELECT application_id, CAST(year(period_start) AS INT) AS year, count(DISTINCT date_trunc('month', period_start)) AS months,
    CAST(round(CAST(sum(total_credits) AS DECIMAL(18,2)) * 12 / count(DISTINCT date_trunc('month', period_start)), 2) AS DECIMAL(18,2)) AS annualised_credits FROM f_stmt_m GROUP BY ALL"""


@query("SELECT * FROM f_year")
def a4_annualised_credits(spark, d):
    return cashflow.annualised_credits(cashflow.monthly_amounts(views.monthly_statements(spark, d)))


@query("""SELECT application_id, document_id, account_number, CAST(CASE WHEN r = n THEN pot - coalesce(sum(s) FILTER (WHERE r < n) OVER w, 0) ELSE s END AS DECIMAL(18,2)) AS allocated FROM (
    SELECT *, CAST(round(CAST(pot * weight AS DECIMAL(28,2)) / sum(weight) OVER w, 2) AS DECIMAL(18,2)) AS s, row_number() OVER (PARTITION BY application_id, period_start ORDER BY document_id) AS r, count(*) OVER w AS n
    FROM (SELECT *, CAST(100000.01 AS DECIMAL(18,2)) AS pot, CAST(account_number AS INT) % 5 + 1 AS weight FROM f_stmt_m) WINDOW w AS (PARTITION BY application_id, period_start)) WINDOW w AS (PARTITION BY application_id, period_start)""")
def w10_weighted_allocation(spark, d):
    rows = views.monthly_statements(spark, d).withColumns({"pot": F.lit("100000.01").cast(AMOUNT), "weight": F.col("account_number").cast("int") % 5 + 1})
    return cashflow.weighted_allocation(rows, "pot", "weight", ["application_id", "period_start"], "document_id").select("application_id", "document_id", "account_number", "allocated")


@query("""SELECT application_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY period_start, document_id) - 1 AS i, count(*) OVER (PARTITION BY application_id) AS n FROM f_stmt_m)
    WHERE n <= 12 OR list_contains([CAST(round_even(p * (n - 1) / 11.0, 0) AS BIGINT) for p in range(12)], i)""")
def w11_even_sampling(spark, d):
    return cashflow.even_sample(views.monthly_statements(spark, d), ["application_id"], ["period_start", "document_id"], 12).select("application_id", "document_id")


VIEWS["f_lines"] = """SELECT application_id, document_id, year, revenue, year AS fy, 0 AS period_index FROM f_period
    UNION ALL SELECT application_id, document_id, year - 1, CAST(round(revenue * 0.9, 2) AS DECIMAL(18,2)), year, 1 FROM f_period"""
VIEWS["f_latest"] = "SELECT * FROM f_lines QUALIFY row_number() OVER (PARTITION BY application_id, year ORDER BY fy DESC, document_id DESC, period_index DESC) = 1"


def period_lines(spark, d):
    p = views.periods(spark, d).select("application_id", "document_id", "year", "revenue")
    now = p.withColumns({"financial_year_end": F.make_date("year", F.lit(12), F.lit(31)), "period_index": F.lit(0)})
    prior = now.withColumns({"year": F.col("year") - 1, "revenue": half_up(F.col("revenue") * F.lit("0.9").cast("decimal(2,1)")), "period_index": F.lit(1)})
    return now.unionByName(prior)


@query("SELECT application_id, document_id, year, period_index, revenue FROM f_latest")
def w6_last_period(spark, d):
    return cashflow.latest_period(period_lines(spark, d)).select("application_id", "document_id", "year", "period_index", "revenue")


@query("""SELECT application_id, year, CAST(round(CAST((revenue - b) * 100 AS DECIMAL(28,2)) / b, 2) AS DECIMAL(18,2)) AS growth_percent
    FROM (SELECT *, lag(revenue) OVER (PARTITION BY application_id ORDER BY year) AS b FROM f_latest) WHERE b <> 0""")
def w7_revenue_growth(spark, d):
    return cashflow.revenue_growth(cashflow.latest_period(period_lines(spark, d)))


@query("""SELECT application_id, first_year, last_year, round((pow(CAST(b AS DOUBLE) / CAST(a AS DOUBLE), 1.0 / (last_year - first_year)) - 1) * 100, 2) AS cagr_percent
    FROM (SELECT application_id, min(year) AS first_year, max(year) AS last_year, min_by(revenue, year) AS a, max_by(revenue, year) AS b FROM f_latest GROUP BY 1) WHERE last_year > first_year AND a > 0""")
def w8_revenue_cagr(spark, d):
    return cashflow.revenue_cagr(cashflow.latest_period(period_lines(spark, d)))


VIEWS["f_missing"] = """SELECT application_id, year || '-' || lpad(CAST(m AS VARCHAR), 2, '0') AS month FROM (SELECT application_id, max(year(period_start)) AS year, unnest(range(1, 13)) AS m FROM f_stmt_m GROUP BY 1)
    WHERE (application_id, year || '-' || lpad(CAST(m AS VARCHAR), 2, '0')) NOT IN (SELECT (application_id, strftime(period_start, '%Y-%m')) FROM f_stmt_m)"""


@query("SELECT * FROM f_missing")
def w12_missing_months(spark, d):
    return cashflow.missing_months(views.monthly_statements(spark, d))


_RATIO = "CAST(round_even(CAST({a} AS DECIMAL(38,2)) / nullif({b}, 0), 4) AS DECIMAL(18,4))"


def _bands(x: str, a: str, b: str, c: str, op: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'insufficient_data' WHEN {x} {op} {a} THEN 'healthy' WHEN {x} {op} {b} THEN 'acceptable' WHEN {x} {op} {c} THEN 'stretched' ELSE 'distressed' END"


VIEWS["f_ratio"] = f"""SELECT application_id, document_id, year, 'current_ratio' AS name, v AS value, {_bands("v", "1.5", "1", "0.75", ">=")} AS band FROM (SELECT *, {_RATIO.format(a="current_assets", b="current_liabilities")} AS v FROM f_period)
    UNION ALL SELECT application_id, document_id, year, 'debt_to_equity', v, {_bands("v", "1", "2", "3", "<=")} FROM (SELECT *, {_RATIO.format(a="current_liabilities + non_current_liabilities", b="total_equity")} AS v FROM f_period)
    UNION ALL SELECT application_id, document_id, year, 'net_profit_margin', v, {_bands("v", "0.1", "0.05", "0", ">=")} FROM (SELECT *, {_RATIO.format(a="net_profit", b="revenue")} AS v FROM f_period)
    UNION ALL SELECT application_id, document_id, year, 'interest_coverage', v, CASE WHEN interest_expense = 0 THEN 'healthy' ELSE {_bands("v", "4", "2", "1.5", ">=")} END FROM (SELECT *, {_RATIO.format(a="ebit", b="interest_expense")} AS v FROM f_period)
    UNION ALL SELECT application_id, document_id, year, 'debt_service', NULL, 'insufficient_data' FROM f_period"""


_INPUTS = " || ';' || ".join(f"'{c}=' || CAST({c} AS DECIMAL(18,2))" for c in ratios.INPUTS)


@query(f"SELECT r.*, inputs FROM f_ratio r JOIN (SELECT document_id, {_INPUTS} AS inputs FROM f_period QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY year DESC) = 1) USING (document_id)")
def r6_ratio_set(spark, d):
    return ratios.newest_ratios(views.periods(spark, d))


def _one_ratio(key: str, name: str) -> None:
    def run(spark, d):
        return ratios.ratio_set(views.periods(spark, d)).where(F.col("name") == name).drop("name")

    QUERIES[key] = run
    SQL[key] = oracle(f"SELECT * EXCLUDE (name) FROM f_ratio WHERE name = '{name}'")


for _k, _n in (("r1_current_ratio", "current_ratio"), ("r2_debt_to_equity", "debt_to_equity"), ("r3_net_profit_margin", "net_profit_margin"), ("r4_interest_coverage", "interest_coverage"), ("r5_debt_service", "debt_service")):
    _one_ratio(_k, _n)


@query("""SELECT *, CAST(profit_before_tax - tax AS DECIMAL(18,2)) AS net_profit FROM (SELECT *, CAST(round(greatest(profit_before_tax, 0) * 0.24, 2) AS DECIMAL(18,2)) AS tax FROM (
    SELECT application_id, document_id, year, CAST(revenue - cost_of_sales AS DECIMAL(18,2)) AS gross_profit, ebit, CAST(ebit - interest_expense AS DECIMAL(18,2)) AS profit_before_tax, CAST(current_liabilities + non_current_liabilities AS DECIMAL(18,2)) AS total_liabilities FROM f_period))""")
def r7_derived_lines(spark, d):
    return ratios.derived_lines(views.periods(spark, d))


@query(f"SELECT application_id, document_id, {_NORMAL.format('account_holder')} AS normal_name, {_core('account_holder')} AS core_name FROM f_stmt")
def j1_name_key(spark, d):
    return views.statements(spark, d).select("application_id", "document_id", normal_name(F.col("account_holder")).alias("normal_name"), core_name(F.col("account_holder")).alias("core_name"))


@query(f"SELECT s.application_id, s.document_id, r.document_id AS registration FROM (SELECT *, {_key('account_holder')} AS k FROM f_stmt) s JOIN (SELECT *, {_key('company_name')} AS k FROM f_reg) r ON s.application_id = r.application_id AND s.k = r.k")
def j2_strong_match(spark, d):
    s = views.statements(spark, d).select("application_id", "document_id", name_key(F.col("account_holder")).alias("_k"))
    r = registrations(spark, d).select("application_id", F.col("document_id").alias("registration"), name_key(F.col("company_name")).alias("_k"))
    return s.join(r, ["application_id", "_k"]).drop("_k")


def _unmatched(table: str, name: str, reg: str, code: str) -> str:
    return f"""SELECT application_id, document_id, '{code}' AS code, 'critical' AS severity, document_id || ':summary:0,' || cited AS citations FROM (SELECT *, {_key(name)} AS k FROM {table}) s
    JOIN (SELECT application_id, string_agg(DISTINCT document_id || ':summary:0', ',' ORDER BY document_id || ':summary:0') AS cited FROM {reg} GROUP BY 1) USING (application_id)
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, {_key("company_name")} AS rk FROM {reg}) r WHERE r.application_id = s.application_id AND r.rk = s.k)"""


@query(_unmatched("f_stmt", "account_holder", "f_reg", "HOLDER_SSM_MISMATCH"))
def j3_holder_mismatch(spark, d):
    return flat(crossdoc.without_registration(views.statements(spark, d), registrations(spark, d), "account_holder", "HOLDER_SSM_MISMATCH"))


@query(f"""SELECT s.application_id, s.document_id, 'ACTIVITY_BEFORE_INCORPORATION' AS code, 'warning' AS severity, s.document_id || ':summary:0,' || r.document_id || ':summary:0' AS citations
    FROM (SELECT *, {_key('account_holder')} AS k FROM f_stmt) s JOIN (SELECT * FROM (SELECT *, {_key('company_name')} AS k FROM f_reg) QUALIFY row_number() OVER (PARTITION BY application_id, k ORDER BY registration_ord) = 1) r
    ON s.application_id = r.application_id AND s.k = r.k WHERE period_start < incorporation_date""")
def j4_before_incorporation(spark, d):
    return flat(crossdoc.before_incorporation(views.statements(spark, d), registrations(spark, d)))


def region_tax(spark, d):
    """Declared income by region and year; region 4 has the last year only, one off."""
    year = cashflow.annualised_credits(cashflow.monthly_amounts(views.monthly_statements(spark, d)))
    region = F.regexp_extract("application_id", r"(\d+)", 1).cast("int")
    gross = half_up(F.col("annualised_credits") * (6 + (F.col("year") + region) % 8) / 10)
    return year.select("application_id", F.concat(F.lit("tax/"), "application_id", F.lit("/"), "year").alias("document_id"), "year", gross.alias("gross_business_income"))


VIEWS["f_tax_r"] = """SELECT application_id, 'tax/' || application_id || '/' || year AS document_id, year,
    CAST(round(annualised_credits * (6 + (year + CAST(regexp_extract(application_id, '(\\d+)', 1) AS INT)) % 8) * 0.1, 2) AS DECIMAL(18,2)) AS gross_business_income FROM f_year"""


@query("""SELECT application_id, t.document_id, t.year AS compared_year, CAST(round_even(abs(annualised_credits - gross_business_income) * 100 / gross_business_income, 0) AS BIGINT) AS gap_percent,
    'DECLARED_INCOME_VS_DEPOSITS' AS code, 'warning' AS severity, t.document_id || ':summary:0,' || cited AS citations
    FROM f_tax_r t JOIN f_year y USING (application_id, year) JOIN (SELECT application_id, year(period_start) AS year, string_agg(document_id || ':summary:0', ',' ORDER BY document_id || ':summary:0') AS cited FROM f_stmt_m GROUP BY ALL) c USING (application_id, year)
    WHERE gross_business_income <> 0 AND abs(annualised_credits - gross_business_income) * 10 > gross_business_income * 3""")
def j5_income_against_deposits(spark, d):
    s = views.monthly_statements(spark, d)
    return flat(crossdoc.income_against_deposits(region_tax(spark, d), cashflow.annualised_credits(cashflow.monthly_amounts(s)), s))


@query("""SELECT p.application_id, p.document_id, p.year, 'AUDITED_VS_TAX_REVENUE' AS code, 'warning' AS severity, p.document_id || ':summary:0,' || t.document_id || ':summary:0' AS citations, CAST(abs(revenue - gross_business_income) AS DECIMAL(18,2)) AS difference
    FROM f_period p JOIN f_tax t ON p.application_id = t.application_id AND p.year = t.year WHERE revenue <> 0 AND abs(revenue - gross_business_income) * 10 > revenue""")
def j6_audited_against_tax(spark, d):
    return flat(crossdoc.audited_against_tax(views.periods(spark, d), tax_by_supplier(spark, d)))


@query(_unmatched("(SELECT p.*, s_name || ([' SDN BHD', ' S/B', ' Sdn. Bhd.', ' HOLDINGS'])[CAST((s_suppkey + 1) % 4 + 1 AS INT)] || CASE WHEN s_suppkey % 6 = 0 THEN ' II' ELSE '' END AS company FROM f_period p JOIN supplier ON l_suppkey = s_suppkey)", "company", "f_reg_s", "FINANCIALS_SSM_MISMATCH"))
def j7_financials_mismatch(spark, d):
    name = F.concat("s_name", suffix(F.col("s_suppkey") + 1), F.when(F.col("s_suppkey") % 6 == 0, " II").otherwise(""))
    accounts = views.periods(spark, d).join(views.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("company", name)
    return flat(crossdoc.without_registration(accounts, supplier_registrations(spark, d), "company", "FINANCIALS_SSM_MISMATCH"))


def _matched_findings(spark, d, heads=None):
    """All findings but those of holders without a registration; heads are the statements, if they are there already."""
    heads = views.statements(spark, d) if heads is None else heads
    rows, reg = views.ledger(spark, d), registrations(spark, d)
    single = heads.where("document_id not like '%\\_\\_2'")
    parts = [
        checks.balance_arithmetic(heads),
        checks.of_rows(rows, single),
        crossdoc.before_incorporation(heads, reg),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def all_findings(spark, d, heads=None):
    heads = views.statements(spark, d) if heads is None else heads
    holders = crossdoc.without_registration(heads, registrations(spark, d), "account_holder", "HOLDER_SSM_MISMATCH")
    return _matched_findings(spark, d, heads).unionByName(holders)


VIEWS["f_findings"] = " UNION ALL ".join(
    "SELECT application_id, document_id, code, severity, citations FROM (" + SQL_.strip() + ")"
    for SQL_ in (
        "SELECT application_id, document_id, 'BALANCE_ARITHMETIC' AS code, 'critical' AS severity, document_id || ':summary:0' AS citations FROM f_stmt WHERE abs(opening + total_credits - total_debits - closing) > 0.01",
        "SELECT application_id, document_id, 'RUNNING_BALANCE' AS code, 'critical' AS severity, document_id || ':transaction:' || row_index AS citations FROM (SELECT *, abs(coalesce(lag(balance) OVER (PARTITION BY document_id ORDER BY row_index), 1000) + coalesce(credit, 0) - coalesce(debit, 0) - balance) AS gap FROM f_txn) WHERE gap > 0.01",
        "SELECT application_id, document_id, 'DATE_OUTSIDE_PERIOD' AS code, 'warning' AS severity, document_id || ':transaction:' || row_index AS citations FROM f_txn WHERE txn_date NOT BETWEEN period_start AND period_end",
        "SELECT application_id, document_id, 'DATE_OUT_OF_ORDER' AS code, 'warning' AS severity, document_id || ':transaction:' || row_index AS citations FROM (SELECT *, lag(txn_date) OVER (PARTITION BY document_id ORDER BY row_index) AS b FROM f_txn) WHERE txn_date < b",
        _unmatched("f_stmt", "account_holder", "f_reg", "HOLDER_SSM_MISMATCH"),
        f"SELECT s.application_id, s.document_id, 'ACTIVITY_BEFORE_INCORPORATION' AS code, 'warning' AS severity, s.document_id || ':summary:0,' || r.document_id || ':summary:0' AS citations FROM (SELECT *, {_key('account_holder')} AS k FROM f_stmt) s JOIN (SELECT * FROM (SELECT *, {_key('company_name')} AS k FROM f_reg) QUALIFY row_number() OVER (PARTITION BY application_id, k ORDER BY registration_ord) = 1) r ON s.application_id = r.application_id AND s.k = r.k WHERE period_start < incorporation_date",
    )
)


#: Checks beyond those of single documents and registrations, by their queries.
OTHERS = ("f3_accounting_equation", "w3_possible_duplicate", "j5_income_against_deposits", "j6_audited_against_tax", "j7_financials_mismatch")


def rated_findings(spark, d):
    """Findings of ledgers, statements and registrations."""
    holders = crossdoc.without_registration(views.statements(spark, d), registrations(spark, d), "account_holder", "HOLDER_SSM_MISMATCH", joined=True)
    return flat(_matched_findings(spark, d)).unionByName(holders)


def _every_sql() -> str:
    text = "SELECT application_id, document_id, code, severity, citations FROM {}"
    return " UNION ALL ".join([text.format("f_findings"), *[text.format(f"({RAW[n]})") for n in OTHERS]])


VIEWS["f_every_finding"] = _every_sql()


@query("SELECT * FROM f_every_finding")
def o3_all_findings(spark, d):
    """The union of all checks on documents, across documents and against registrations."""
    out = rated_findings(spark, d)
    for name in OTHERS:
        out = out.unionByName(QUERIES[name](spark, d).select(*out.columns))
    return out


@query("SELECT application_id, severity, count(*) AS n FROM f_findings GROUP BY ALL")
def a9_findings_by_severity(spark, d):
    return all_findings(spark, d).groupBy("application_id", "severity").agg(F.count("*").alias("n"))


@query("SELECT application_id, string_agg(DISTINCT c, ',' ORDER BY c) AS cited FROM (SELECT application_id, unnest(string_split(citations, ',')) AS c FROM f_findings) GROUP BY 1")
def a10_cited_ids(spark, d):
    holders = crossdoc.cited_without_registration(views.statements(spark, d), registrations(spark, d), "account_holder")
    each = _matched_findings(spark, d).select("application_id", F.explode("citations").alias("c")).unionByName(holders)
    return each.distinct().groupBy("application_id").agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("cited"))
