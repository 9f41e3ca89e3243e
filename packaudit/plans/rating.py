"""Queries over the rating of packages, its guards and the checks that people should make, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from packaudit.functions.scratch import saved
from packaudit.operators import rating
from packaudit.plans import finance, records, summaries, views  # noqa: F401  summaries adds SQL views
from packaudit.plans.shared import FRAMES, shared
from packaudit.plans.sql_views import VIEWS, oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = oracle(sql)
        return f

    return add


FRAMES["f_findings"] = finance.rated_findings
FRAMES["f_concentration"] = records.r14_concentration
packages = shared("f_rate_package", "SELECT DISTINCT 'app' || user_id % 13 AS application_id FROM events")
metrics = shared(
    "f_rate_metric",
    "SELECT application_id, document_id, CAST(row_number() OVER (PARTITION BY application_id ORDER BY document_id) AS BIGINT) AS ord, CAST(total_credits - total_debits AS DECIMAL(18,2)) AS net_change, user_id FROM f_stmt WHERE application_id <> 'app9'",
)
ratio_rows = shared(
    "f_rate_ratio",
    """SELECT application_id, CAST(row_number() OVER (PARTITION BY application_id ORDER BY year DESC, l_suppkey) AS BIGINT) AS ord, document_id, l_suppkey, year, CAST('' || year || '-12-31' AS DATE) AS period_end, cash_from_operations, ebit, total_equity, current_liabilities, non_current_liabilities, current_assets, interest_expense FROM (
    SELECT 'app' || l_suppkey % 8 AS application_id, document_id, l_suppkey, year, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(net_profit + operating_expenses AS DECIMAL(18,2)) END AS cash_from_operations, ebit, total_equity, current_liabilities, non_current_liabilities, current_assets, interest_expense FROM f_period WHERE year % 3 = 0) AS p""",
)
citable = shared("f_rate_citable", "SELECT application_id, document_id || ':summary:0' AS chunk_id FROM f_rate_metric WHERE user_id % 4 <> 1 UNION SELECT application_id, document_id || ':period:0' FROM f_rate_ratio WHERE ord % 4 <> 2 UNION SELECT application_id, chunk_ids FROM f_concentration WHERE length(chunk_ids) < 14")
gaps = shared("f_rate_gap", "SELECT DISTINCT application_id FROM f_rate_metric WHERE user_id % 29 = 0")
supplied = shared("f_rate_supplied", "SELECT application_id, length(application_id) = 4 AS has_registration, application_id IN ('app1', 'app4', 'app7', 'app10') AS has_tax_return FROM f_rate_package")


def tables(spark, d):
    """The tables that several parts of a rating read, by name: statements, periods and concentrations are made once."""
    heads = saved(views.statements(spark, d), "statements")
    made = {"f_stmt": heads, "f_rate_metric": metrics(spark, d, f_stmt=heads), "f_rate_ratio": saved(ratio_rows(spark, d), "ratios"), "f_concentration": saved(records.r14_concentration(spark, d), "concentration")}
    return made | {"f_rate_citable": citable(spark, d, **made)}


def facts(spark, d, made):
    from packaudit.functions.money import ratio

    c = F.col
    rows = made["f_rate_ratio"]
    equity, current = ratio(c("current_liabilities") + c("non_current_liabilities"), c("total_equity")), ratio(c("current_assets"), c("current_liabilities"))
    band = F.when(c("debt_to_equity").isNull(), "insufficient_data").when(c("debt_to_equity") <= 1, "healthy").when(c("debt_to_equity") <= 2, "acceptable").when(c("debt_to_equity") <= 3, "weak").otherwise("distressed")
    rows = rows.withColumns({"debt_to_equity": equity, "current_ratio": current, "interest_coverage": ratio(c("ebit"), c("interest_expense")), "debt_service": F.lit(None).cast("decimal(18,4)")}).withColumn("debt_band", band)
    found = finance.all_findings(spark, d, made["f_stmt"])
    return rating.facts(packages(spark, d), made["f_rate_metric"], found, rows, made["f_rate_citable"])


_R = "CAST(round_even(CASE WHEN {b} <> 0 THEN CAST(({a}) AS DOUBLE) / CAST({b} AS DOUBLE) END, 4) AS DECIMAL(18,4))"
_DE, _CR, _IC = (_R.format(a=a, b=b) for a, b in (("current_liabilities + non_current_liabilities", "total_equity"), ("current_assets", "current_liabilities"), ("ebit", "interest_expense")))
_IDS = "SELECT application_id, list(chunk_id ORDER BY ord) AS {n} FROM (SELECT application_id, ord, document_id || '{k}' AS chunk_id FROM {t} WHERE {w}) WHERE (application_id, chunk_id) IN (SELECT (application_id, chunk_id) FROM f_rate_citable) GROUP BY 1"
VIEWS["f_rate_fact"] = f"""SELECT p.application_id, coalesce(n_metrics, 0) AS n_metrics, net_change, coalesce(critical, false) AS critical, coalesce(warning, false) AS warning, coalesce(n_ratios, 0) AS n_ratios, de, cr, coalesce(bank_ids, []) AS bank_ids, coalesce(period_ids, []) AS period_ids, coalesce(first_ids, []) AS first_ids, coalesce(texts, '') AS texts
    FROM f_rate_package p LEFT JOIN (SELECT application_id, count(*) AS n_metrics, CAST(sum(net_change) AS DECIMAL(18,2)) AS net_change FROM f_rate_metric GROUP BY 1) USING (application_id)
    LEFT JOIN (SELECT application_id, bool_or(severity = 'critical') AS critical, bool_or(severity = 'warning') AS warning FROM f_findings GROUP BY 1) USING (application_id)
    LEFT JOIN (SELECT application_id, count(*) AS n_ratios, arg_min(x, ord).de AS de, arg_min(x, ord).cr AS cr, string_agg('For FY ' || period_end || ', reported cash from operations is RM' || coalesce(CAST(cash_from_operations AS VARCHAR), 'unavailable') || ', EBIT is RM' || ebit || ' and interest coverage is ' || coalesce(CAST(ic AS VARCHAR), 'None') || '.', ' ' ORDER BY ord) AS texts
        FROM (SELECT *, {{'de': {_DE}, 'cr': {_CR}}} AS x, {_IC} AS ic FROM f_rate_ratio) GROUP BY 1) USING (application_id)
    LEFT JOIN ({_IDS.format(n="bank_ids", k=":summary:0", t="f_rate_metric", w="ord <= 3")}) USING (application_id) LEFT JOIN ({_IDS.format(n="period_ids", k=":period:0", t="f_rate_ratio", w="true")}) USING (application_id) LEFT JOIN ({_IDS.format(n="first_ids", k=":period:0", t="f_rate_ratio", w="ord <= 3")}) USING (application_id)"""
_F = rating.FLAGS
VIEWS["f_rated"] = f"""SELECT *, 0 AS place, 'Character' AS dimension, CASE WHEN critical THEN 'weak' WHEN warning THEN 'adequate' ELSE 'strong' END AS rating, CASE WHEN critical THEN '{rating.CLARIFY}' ELSE '{rating.REGULAR}' END AS reasoning, bank_ids AS evidence, ['{_F["Character"]}'] AS flags FROM f_rate_fact
    UNION ALL SELECT *, 1, 'Capacity', CASE WHEN n_metrics = 0 THEN 'insufficient_data' WHEN net_change > 0 AND NOT critical THEN 'strong' ELSE 'weak' END, CASE WHEN n_metrics = 0 THEN '{rating.NO_METRICS}' ELSE 'Across ' || n_metrics || ' bank statements, aggregate net movement is RM ' || format('{{:,.2f}}', CAST(net_change AS DOUBLE)) || '.' END, bank_ids, ['{_F["Capacity"]}'] FROM f_rate_fact
    UNION ALL SELECT *, 2, 'Capital', CASE WHEN n_ratios = 0 THEN 'insufficient_data' WHEN de <= 2 THEN 'strong' ELSE 'weak' END, CASE WHEN n_ratios = 0 THEN '{rating.NO_RATIOS}' ELSE 'The latest audited debt-to-equity ratio is ' || coalesce(CAST(de AS VARCHAR), 'None') || ' and current ratio is ' || coalesce(CAST(cr AS VARCHAR), 'None') || '.' END, first_ids, ['{_F["Capital"]}'] FROM f_rate_fact
    UNION ALL SELECT *, 3, 'Collateral', 'insufficient_data', '{rating.NO_SECURITY}', [], ['{_F["Collateral"]}'] FROM f_rate_fact
    UNION ALL SELECT *, 4, 'Conditions', 'insufficient_data', '{rating.NO_MARKET}' || CASE WHEN critical THEN '{rating.RESOLVE}' ELSE '' END, bank_ids, ['{_F["Conditions"]}'] FROM f_rate_fact"""


def flat(rows):
    return rows.withColumns({"evidence": F.array_join("evidence", " "), "flags": F.array_join("flags", " | ")})


@query("SELECT application_id, place, dimension, rating, reasoning, array_to_string(evidence, ' ') AS evidence, array_to_string(flags, ' | ') AS flags FROM f_rated")
def r10_ratings(spark, d):
    """Five dimensions of each package by rule, with reasons, evidence and flags."""
    return flat(rating.ratings(facts(spark, d, tables(spark, d))))


_PAPERS = "array_to_string(list_filter([CASE WHEN has_registration THEN 'SSM registration' END, CASE WHEN has_tax_return THEN 'a tax return' END], lambda x: x IS NOT NULL), ' and ')"
_LOOKS = "array_to_string(list_filter(['Review the missing banking history', CASE WHEN has_registration THEN 'independently verify registration status' END, CASE WHEN has_tax_return THEN 'verify tax filing acceptance and payment records' END], lambda x: x IS NOT NULL), '; ')"
_MORE = "list_concat(evidence, list_filter({0}, lambda x: NOT list_contains(evidence, x)))"


@query(f"""SELECT application_id, place, dimension, CASE WHEN dimension = 'Capacity' OR unsettled THEN 'insufficient_data' WHEN dependent THEN 'weak' ELSE rating END AS rating,
    CASE WHEN dimension = 'Capacity' THEN CASE WHEN n_metrics > 0 OR n_ratios > 0 THEN '{rating.PARTIAL}' ELSE '{rating.NEITHER}' END || '{rating.NO_CAPACITY}' || CASE WHEN n_ratios > 0 THEN ' ' || texts ELSE '' END
        WHEN unsettled THEN '{rating.NOT_SUSTAINED}' || CASE WHEN n_metrics > 0 THEN '{rating.LIMITED}' ELSE '{rating.NO_ACTIVITY}' END || CASE WHEN has_registration OR has_tax_return THEN {_PAPERS} || CASE WHEN has_registration AND has_tax_return THEN ' alone do' ELSE ' alone does' END || '{rating.NOT_COMPLIANCE}' ELSE '' END || '{rating.NOT_POOR}'
        WHEN dependent THEN '{rating.CONCENTRATED[0]}' || array_to_string([regexp_replace(p, '\\.0+$', '') || '%' for p in string_split(percentages, ',')], ' and ') || '{rating.CONCENTRATED[1]}' ELSE reasoning END AS reasoning,
    array_to_string(CASE WHEN dimension = 'Capacity' THEN {_MORE.format("period_ids")} WHEN dependent THEN {_MORE.format("list_filter(string_split(chunk_ids, ','), lambda x: list_contains(known, x))")} ELSE evidence END, ' ') AS evidence,
    array_to_string(CASE WHEN dimension = 'Capacity' THEN list_append(flags, CASE WHEN n_ratios > 0 THEN '{rating.SCHEDULE}' ELSE '{rating.OBTAIN}' END) WHEN unsettled THEN list_append(flags, {_LOOKS} || '.') WHEN dependent THEN list_append(flags, '{rating.DEPENDENCE}') ELSE flags END, ' | ') AS flags
    FROM (SELECT r.*, c.percentages, c.chunk_ids, coalesce(known, []) AS known, s.has_registration, s.has_tax_return, dimension = 'Character' AND (n_metrics = 0 OR r.application_id IN (SELECT application_id FROM f_rate_gap)) AS unsettled, dimension = 'Conditions' AND c.percentages IS NOT NULL AS dependent
        FROM f_rated r JOIN f_rate_supplied s USING (application_id) LEFT JOIN f_concentration c USING (application_id) LEFT JOIN (SELECT application_id, list(chunk_id) AS known FROM f_rate_citable GROUP BY 1) USING (application_id))""")
def r11_guards(spark, d):
    """The same after the guards: debt service is never known, some packages miss bank months or are concentrated."""
    made = tables(spark, d)
    of = saved(facts(spark, d, made), "facts")
    found = made["f_concentration"].select("application_id", F.split("percentages", ",").alias("percentages"), F.split("chunk_ids", ",").alias("chunk_ids"))
    return flat(rating.guarded(rating.ratings(of), of, gaps(spark, d, **made), supplied(spark, d), found, made["f_rate_citable"]))


checks = shared(
    "f_rate_check",
    """SELECT application_id, CAST(event_id AS BIGINT) AS ord, CASE event_id % 9 WHEN 0 THEN 'Obtain the repayment schedule' WHEN 1 THEN 'RUNNING_BALANCE: see row ' || event_id WHEN 2 THEN ' Review bank statements ' WHEN 3 THEN 'Verify the SSM entry' WHEN 4 THEN 'Ask for a security document' WHEN 5 THEN 'Note ' || event_id % 20 || '!' WHEN 6 THEN '  ' WHEN 7 THEN 'Check debt service and audited financials' ELSE 'UNKNOWN_CODE: see the management accounts' END AS "check"
    FROM (SELECT 'app' || user_id % 13 AS application_id, event_id FROM events) AS e""".replace('"check"', "said"),
)


@query(r"""SELECT application_id, CAST(row_number() OVER (PARTITION BY application_id ORDER BY ord) AS INT) AS place, said FROM (SELECT * FROM (SELECT *, CASE WHEN regexp_matches(low, 'repayment|debt service') THEN 'repayment' WHEN regexp_matches(low, 'bank statement|banking history') THEN 'bank_evidence' WHEN contains(low, 'audited financial') THEN 'audited_financials'
    WHEN regexp_matches(low, 'ssm|registration status') THEN 'registration' WHEN regexp_matches(low, 'collateral|facility statement|security document') THEN 'collateral' WHEN regexp_matches(low, 'management account|industry condition') THEN 'conditions' ELSE trim(regexp_replace(low, '[^a-z0-9]+', ' ', 'g')) END AS subject
    FROM (SELECT application_id, ord, trim(said) AS said, lower(trim(said)) AS low FROM f_rate_check WHERE trim(said) <> '') WHERE (application_id, split_part(said, ':', 1)) NOT IN (SELECT (application_id, code) FROM f_findings)) QUALIFY row_number() OVER (PARTITION BY application_id, subject ORDER BY ord) = 1)""")
def r16_human_checks(spark, d):
    """Checks without those that a finding stands for, one of each subject."""
    found = rating.human_checks(checks(spark, d).withColumnRenamed("said", "check"), finance.all_findings(spark, d).select("application_id", "code"))
    return found.withColumnRenamed("check", "said")
