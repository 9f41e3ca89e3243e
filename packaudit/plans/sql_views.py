"""The same tables in DuckDB SQL, for the oracle."""

from __future__ import annotations

import re


def money(x: str) -> str:
    return f"CAST(CAST(round(({x}) * 100) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2))"


VIEWS: dict[str, str] = {}


def _ledger(whole: bool) -> str:
    week = "CAST(date_trunc('week', ts) AS DATE)"
    doc = "'acct/' || user_id" if whole else f"'stmt/' || user_id || '-' || CAST({week} AS VARCHAR)"
    value = "CAST(floor(value) AS DECIMAL(18,2))" if whole else money("value")
    return f"""
    SELECT *, CAST(1000 + sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (PARTITION BY document_id ORDER BY ts, event_id)
        + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS balance,
        row_number() OVER (PARTITION BY document_id ORDER BY ts, event_id) - 1 AS row_index
    FROM (SELECT 'app' || (user_id % 10) AS application_id, {doc} AS document_id, user_id, event_id, ts, event_type AS description,
        CASE WHEN event_type IN ('purchase', 'signup') THEN {value} END AS credit,
        CASE WHEN event_type NOT IN ('purchase', 'signup') THEN {value} END AS debit,
        CAST(ts AS DATE) - CASE WHEN event_id % 211 = 0 THEN 10 ELSE 0 END AS txn_date,
        {week} AS period_start, {week} + 6 AS period_end FROM events)"""


VIEWS["f_txn"] = _ledger(False)
VIEWS["f_txn_whole"] = _ledger(True)
VIEWS["f_head"] = """
    SELECT application_id, document_id, user_id, CAST(user_id AS VARCHAR) AS account_number,
        'CUSTOMER ' || user_id || ([' SDN BHD', ' S/B', ' Sdn. Bhd.', ' TRADING'])[CAST(user_id % 4 + 1 AS INT)] AS account_holder,
        period_start, period_end, CAST(1000 AS DECIMAL(18,2)) AS opening,
        CAST(1000 + total_credits - total_debits + CASE WHEN user_id % 13 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) AS closing, total_credits, total_debits
    FROM (SELECT application_id, document_id, user_id, period_start, period_end, CAST(coalesce(sum(credit), 0) AS DECIMAL(18,2)) AS total_credits,
        CAST(coalesce(sum(debit), 0) AS DECIMAL(18,2)) AS total_debits FROM f_txn GROUP BY ALL)"""
VIEWS["f_stmt"] = "SELECT * FROM f_head UNION ALL SELECT * REPLACE (document_id || '__2' AS document_id) FROM f_head WHERE user_id % 29 = 0"
VIEWS["f_stmt_m"] = f"""
    SELECT 'region/' || n_regionkey AS application_id, 'bank/' || n_nationkey || '/' || strftime(period_start, '%Y-%m') AS document_id,
        CAST(n_nationkey AS VARCHAR) AS account_number, period_start, last_day(period_start) AS period_end, CAST(0 AS DECIMAL(18,2)) AS opening,
        CAST(total_credits - total_debits AS DECIMAL(18,2)) AS closing, total_credits, total_debits
    FROM (SELECT n_regionkey, n_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start,
        CAST(coalesce(sum({money("o_totalprice")}) FILTER (WHERE o_orderstatus IN ('F', 'O')), 0) AS DECIMAL(18,2)) AS total_credits,
        CAST(coalesce(sum({money("o_totalprice")}) FILTER (WHERE o_orderstatus = 'P'), 0) AS DECIMAL(18,2)) AS total_debits
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def _part(value: str, where: str = "true") -> str:
    return f"CAST(coalesce(sum({value}) FILTER (WHERE {where}), 0) AS DECIMAL(18,2))"


_PRICE = money("l_extendedprice")
VIEWS["f_period"] = f"""
    SELECT *, CAST(ebit - interest_expense AS DECIMAL(18,2)) AS net_profit FROM (
    SELECT 'supplier/' || l_suppkey AS application_id, 'fs/' || l_suppkey || '/' || year AS document_id, *,
        CAST(revenue - cost_of_sales - operating_expenses AS DECIMAL(18,2)) AS ebit
    FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year,
        {_part(money("l_extendedprice * (1 - l_discount)"))} AS revenue, {_part(money("l_quantity * p_retailprice * 1.2"))} AS cost_of_sales,
        {_part(_PRICE, "l_returnflag = 'R'")} AS operating_expenses, {_part(money("l_extendedprice * l_tax"))} AS interest_expense,
        {_part(_PRICE, "l_linestatus = 'O'")} AS current_assets, {_part(_PRICE, "l_linestatus = 'F'")} AS current_liabilities,
        {_part(_PRICE, "l_returnflag = 'A'")} AS non_current_liabilities, {_part(_PRICE, "l_returnflag = 'N'")} AS total_equity
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL))"""


def _docs(package: str) -> str:
    kind = (
        "(['bank_statement', 'ssm_registration', 'audited_financials', 'tax_return', 'management_accounts', 'debtor_ageing', 'facility_letter', 'unknown'])"
        "[CAST((doc_id // 20) % 8 + 1 AS INT)]"
    )
    return f"""
    SELECT {package} AS application_id, CAST(doc_id AS VARCHAR) AS document_id, doc_id AS upload_ord,
        CASE WHEN {kind} = 'tax_return' AND CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 3 = 0 THEN 'unknown' ELSE {kind} END AS kind,
        sha256(text) AS sha256, len(string_split(text, chr(10))) AS page_count, length(text) < 40 AS needs_ocr, text FROM documents"""


VIEWS["f_docs"] = _docs("source")
VIEWS["f_docs_lang"] = _docs("lang")


def oracle(sql: str) -> str:
    """sql with the views that it needs, and those that they need, before it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                need.append(name)

    visit(sql)
    heads = ", ".join(f"{name} AS ({VIEWS[name]})" for name in need)
    body = sql.strip()
    if not heads:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"
