"""Records from positioned page text: rows, columns, cells, statements, accounts, registrations, tax returns.

Spans are (document_id, page, i, x0, y0, x1, y1, text), i their order on the page. Rows are
(document_id, page, row_ord, cells, text): cells from left to right, text joined by blanks.
Every step is keyed by document and page; a document that can't be read is rejected with a
reason, and it alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.functions.money import AMOUNT
from packaudit.operators.extraction import THOUSANDS, directors

PAGE = ["document_id", "page"]
# Names that a transaction table's columns go by
ALIASES = {
    "date": ("date", "transaction date"),
    "description": ("description", "details", "transaction details"),
    "reference": ("reference", "reference no", "ref", "ref no"),
    "debit": ("debit", "debit rm", "withdrawal", "money out"),
    "credit": ("credit", "credit rm", "deposit", "money in"),
    "balance": ("balance", "balance rm", "running balance"),
}
REQUIRED = ("balance", "credit", "date", "debit", "description")
MONEY_COLUMNS = ("debit", "credit", "balance")
# A date cell, a money cell, a statement's period, an amount in ringgit
DATE_CELL = r"^\d{2}/\d{2}/\d{4}$"
MONEY_CELL = r"^-?\d{1,3}(?:,\d{3})*\.\d{2}$"
PERIOD = r"Statement Period\s*:?\s*(\d{2} \w{3} \d{4})\s*-\s*(\d{2} \w{3} \d{4})"
RINGGIT = r"RM\s*([\d,]+\.\d{2})"
# Labels of the first and the last page of a bank statement
BANK_LABELS = ("Bank Name", "Account Holder", "Account Number", "Statement Period")
BANK_TOTALS = {"opening": "Opening Balance", "total_debits": "Total Debits", "total_credits": "Total Credits", "closing": "Closing Balance"}
# What a line of audited accounts begins with, section headers, money in a line, the year's line
LINES = {
    "Revenue": "revenue",
    "Cost of Sales": "cost_of_sales",
    "Gross Profit": "gross_profit",
    "Operating Expenses": "operating_expenses",
    "EBIT": "ebit",
    "Interest Expense": "interest_expense",
    "Net Profit": "net_profit",
    "Cash from Operations": "cash_from_operations",
    "Current Assets": "current_assets",
    "Non-Current Assets": "non_current_assets",
    "Current Liabilities": "current_liabilities",
    "Non-Current Liabilities": "non_current_liabilities",
    "Total Equity": "total_equity",
}
EXPENSES = ("cost_of_sales", "operating_expenses", "interest_expense")
HEADERS = ("INCOME STATEMENT", "BALANCE SHEET", "CASH FLOW", "STATEMENT OF", "AUDITED", "FINANCIAL STATEMENTS")
LINE_MONEY = r"\(?\d{1,3}(?:,\d{3})*\.\d{2}\)?"
YEAR_LINE = r"For the financial year ended\s+(\d{1,2}\s+\w+\s+\d{4})"
# Labels of a registration and of a tax return, each before a colon
REGISTRATION = {
    "Company Name": "company_name",
    "Registration Number": "registration_number",
    "Date of Incorporation": "incorporation_date",
    "Company Type": "company_type",
    "Business Address": "business_address",
    "Paid-Up Capital": "paid_up_capital",
}
TAX = {
    "Company Name": "company_name",
    "Tax Reference Number": "tax_reference_number",
    "Year of Assessment": "year_of_assessment",
    "Gross Business Income": "gross_business_income",
    "Chargeable Income": "chargeable_income",
    "Tax Payable": "tax_payable",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; unlike F.transform, this copies neither."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def _middle() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def text_of(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: c["text"]), " ")


def _starts(s: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """Where the runs of an ordered array begin, from 1: at each item of which begins(the item before, item) holds or isn't known."""
    return F.array_compact(F.transform(s, lambda x, k: F.when((k == 0) | F.coalesce(begins(F.get(s, k - 1), x), F.lit(True)), k + 1)))


def _each_run(s: Column, starts: Column, of: Callable[[Column, Column], Column]) -> Column:
    """of(start, size) of each run of an ordered array."""
    return _let(starts, lambda at: F.transform(at, lambda start, k: of(start, F.coalesce(F.get(at, k + 1), F.size(s) + 1) - start)))


def _cells(spans: Column) -> Column:
    """The spans of a row, which have their midpoint as y, from left to right."""
    return F.sort_array(F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("x0", "y", "i", "y0", "x1", "y1", "text")])))


def _placed(spans: Column, *first: Callable[[Column], Column]) -> Column:
    """Spans in the order of `first`, their midpoint y, x0 and i."""
    middle = lambda s: ((s["y0"] + s["y1"]) / 2).alias("y")
    return F.sort_array(F.transform(spans, lambda s: F.struct(*[f(s) for f in first], middle(s), *[s[c].alias(c) for c in ("x0", "i", "y0", "x1", "y1", "text")])))


def clustered(spans: Column, reach: float = 3.0) -> Column:
    """The rows of one page's spans, each an array of cells: from above, a span joins the row whose mean midpoint so far is within reach, else begins a row.

    A row's mean is never below its last span, so a step of more than `reach` always begins a row:
    pages are cut there first. What lies between two cuts is one row if it is lower than `reach`
    (a mean lies between its values), and only the rest is folded.
    """
    begin = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, span: Column) -> Column:
        at = (state["at"] + 1).alias("at")
        joined = F.struct((state["total"] + span["y"]).alias("total"), (state["n"] + 1).alias("n"), at, state["starts"].alias("starts"))
        begun = F.struct((F.lit(0.0) + span["y"]).alias("total"), F.lit(1).alias("n"), at, F.array_append(state["starts"], at).alias("starts"))
        return F.when(F.abs(span["y"] - F.try_divide(state["total"], state["n"])) <= reach, joined).otherwise(begun)

    def rows(s: Column) -> Column:
        def divided(start: Column, n: Column) -> Column:
            low = F.get(s, start + n - 2)["y"] - F.get(s, start - 1)["y"] < reach - 1e-6
            folded = F.aggregate(F.slice(s, start, n), begin, step, lambda state: F.transform(state["starts"], lambda x: x + start - 1))
            return F.when(low, F.array(start)).otherwise(folded)

        strips = _starts(s, lambda before, x: x["y"] - before["y"] > reach)
        return _each_run(s, F.flatten(_each_run(s, strips, divided)), lambda start, n: _cells(F.slice(s, start, n)))

    return _let(_placed(spans), rows)


def bucketed(spans: Column, height: float = 3.0) -> Column:
    """The rows of one page's spans by fixed buckets of the midpoint, each an array of cells."""
    bucket = lambda s: (F.bround((s["y0"] + s["y1"]) / 2 / height, 0) * height).cast("long").alias("bucket")
    rows = lambda s: _each_run(s, _starts(s, lambda before, x: ~before["bucket"].eqNullSafe(x["bucket"])), lambda start, n: _cells(F.slice(s, start, n)))
    return _let(_placed(spans, bucket), rows)


def row_clusters(spans: DataFrame, reach: float = 3.0) -> DataFrame:
    """Rows by a moving centre; see clustered()."""
    pages = spans.groupBy(*PAGE).agg(F.collect_list(F.struct("i", "x0", "y0", "x1", "y1", "text")).alias("spans"))
    rows = pages.select(*PAGE, F.posexplode(clustered(F.col("spans"), reach)).alias("row_ord", "cells"))
    return rows.withColumns({"row_ord": F.col("row_ord").cast("long"), "text": text_of(F.col("cells"))})


def row_buckets(spans: DataFrame, height: float = 3.0) -> DataFrame:
    """Rows by fixed buckets of the midpoint; row_ord is the bucket."""
    bucket = (F.bround(_middle() / height, 0) * height).cast("long")
    cell = F.struct("x0", _middle().alias("y"), "i", "y0", "x1", "y1", "text")
    rows = spans.groupBy(*PAGE, bucket.alias("row_ord")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return rows.withColumn("text", text_of(F.col("cells")))


def boxed(rows: DataFrame) -> DataFrame:
    """rows with the box around their cells."""
    of = lambda c: F.transform("cells", lambda s: s[c])
    return rows.withColumns({"x0": F.array_min(of("x0")), "y0": F.array_min(of("y0")), "x1": F.array_max(of("x1")), "y1": F.array_max(of("y1"))})


def label_sources(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(document_id, label, page, text, x0, y0, x1, y1): the first row that begins with each label, and its box."""
    hit = F.filter(F.array(*map(F.lit, labels)), lambda x: F.col("text").startswith(x))
    hits = boxed(rows).withColumn("label", F.explode(hit))
    first = hits.groupBy("document_id", "label").agg(F.min_by(F.struct("page", "text", "x0", "y0", "x1", "y1"), F.struct("page", "row_ord")).alias("_f"))
    return first.select("document_id", "label", "_f.*")


# -- transaction tables


def _header(cells: Column) -> Column:
    """Centres of the columns that a row's cells name, and how many required ones there are.

    In a cell the longest alias of a column counts; the centre lies where the alias stands in the
    cell. Of several cells for one column the last counts.
    """
    normal = F.transform(cells, lambda c: F.struct(c["x0"].alias("x0"), c["x1"].alias("x1"), F.trim(F.regexp_replace(F.lower(c["text"]), "[^a-z]+", " ")).alias("t")))
    any_alias = r"\b(?:" + "|".join(n for names in ALIASES.values() for n in names) + r")\b"
    named = F.filter(normal, lambda c: c["t"].rlike(any_alias))

    def centre(c: Column, name: str) -> Column:
        at = F.instr(F.concat(F.lit(" "), c["t"], F.lit(" ")), f" {name} ")
        middle = (2 * (at - 1) + len(name)) / F.lit(2.0) / F.greatest(F.length(c["t"]), F.lit(1))
        return F.when(at > 0, c["x0"] + (c["x1"] - c["x0"]) * middle)

    def last(found: Column, names: tuple[str, ...]) -> Column:
        best = F.transform(found, lambda c: F.coalesce(*[centre(c, n) for n in sorted(names, key=len, reverse=True)]))
        return F.try_element_at(F.filter(best, lambda x: x.isNotNull()), F.lit(-1))

    def of(found: Column) -> Column:
        at = {key: last(found, names) for key, names in ALIASES.items()}
        n = sum((at[k].isNotNull().cast("int") for k in REQUIRED), F.lit(0))
        return F.struct(n.alias("n"), F.struct(*[c.alias(k) for k, c in at.items()]).alias("at"))

    return _let(named, of)


def _named(text: Column, cells: Column) -> Column:
    """_header() of a row, null where its text holds no word that an alias begins with: such a row names no column."""
    words = sorted({name.split()[0] for names in ALIASES.values() for name in names})
    return F.when(F.lower(text).rlike("|".join(words)), _header(cells))


def _best(named: Column, row_ord: Column) -> Column:
    """Rows by how many columns they name, most first, then from above."""
    return F.struct((-F.coalesce(named["n"], F.lit(0))).alias("n"), row_ord.alias("row_ord"))


def _is_transaction(cells: Column) -> Column:
    return F.coalesce(F.get(cells, F.lit(0))["text"].rlike(DATE_CELL), F.lit(False))


def _missing(at: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(at[k].isNull(), k) for k in REQUIRED])), ", ")


def header_columns(rows: DataFrame) -> DataFrame:
    """(document_id, page, date, description, reference, debit, credit, balance, missing) of each page with transaction rows.

    The first row that names most of the required columns is the header; `missing` lists the others.
    """
    pages = rows.withColumn("_h", _named(F.col("text"), F.col("cells"))).groupBy(*PAGE)
    found = pages.agg(F.min_by("_h.at", _best(F.col("_h"), F.col("row_ord"))).alias("_at"), F.bool_or(_is_transaction(F.col("cells"))).alias("_any")).where("_any")
    return found.select(*PAGE, "_at.*", _missing(F.col("_at")).alias("missing"))


def _nearest(cell: Column, columns: tuple[str, ...], at: Column) -> Column:
    """The column whose centre is nearest to the cell's; the one listed first on ties, one without a centre never."""
    gap = lambda c: F.struct(F.coalesce(F.abs((cell["x0"] + cell["x1"]) / 2 - at[c]), F.lit(float("inf"))).alias("gap"), F.lit(columns.index(c)).alias("k"), F.lit(c).alias("name"))
    return F.array_min(F.array(*map(gap, columns)))["name"]


def _transaction(cells: Column, at: Column) -> Column:
    """(txn, error) of a row's cells, null where the row is no transaction; `at` has the centres of its page's header.

    A row without an amount, with two values in one money column, without a balance or with a date
    that doesn't exist is an error, as is every transaction row of a page whose header isn't found.
    """
    rest = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    is_money = lambda c: c["text"].rlike(MONEY_CELL)
    money = F.transform(F.filter(rest, is_money), lambda c: F.struct(_nearest(c, MONEY_COLUMNS, at).alias("key"), F.replace(c["text"], F.lit(","), F.lit("")).try_cast(AMOUNT).alias("value")))
    texts = F.transform(F.filter(rest, lambda c: ~is_money(c)), lambda c: F.struct(_nearest(c, ("description", "reference"), at).alias("key"), c["text"].alias("text")))

    def read(p: Column) -> Column:
        keys = F.transform(p["money"], lambda m: m["key"])
        again = F.filter(F.transform(keys, lambda k, j: F.when(F.array_contains(F.slice(keys, 1, j), k), k)), lambda k: k.isNotNull())
        value = lambda name: F.get(F.filter(p["money"], lambda m: m["key"] == name), F.lit(0))["value"]
        words = lambda name: F.trim(F.array_join(F.transform(F.filter(p["texts"], lambda t: t["key"] == name), lambda t: t["text"]), " "))
        txn = F.struct(
            F.try_to_date(F.get(cells, F.lit(0))["text"], "dd/MM/yyyy").alias("txn_date"),
            words("description").alias("description"),
            F.nullif(words("reference"), F.lit("")).alias("reference_no"),
            *[value(c).alias(c) for c in MONEY_COLUMNS],
        )
        return F.struct(txn.alias("txn"), F.get(again, F.lit(0)).alias("again"), _missing(at).alias("missing"), (F.size(p["money"]) == 0).alias("none"))

    def judged(r: Column) -> Column:
        error = (
            F.when(r["missing"] != "", F.concat(F.lit("columns not found: "), r["missing"]))
            .when(r["none"], "no amount")
            .when(r["again"].isNotNull(), F.concat(F.lit("two values for "), r["again"]))
            .when(r["txn"]["balance"].isNull(), "no balance")
            .when(r["txn"]["txn_date"].isNull(), "no such date")
        )
        return F.struct(r["txn"].alias("txn"), error.alias("error"))

    return F.when(_is_transaction(cells), _let(_let(F.struct(money.alias("money"), texts.alias("texts")), read), judged))


def with_transactions(rows: DataFrame) -> DataFrame:
    """rows with `txn` (null where a row is none) and `error`: cells go to the nearest column of their page's header."""
    page = Window.partitionBy(*PAGE)
    named = rows.withColumn("_h", _named(F.col("text"), F.col("cells"))).withColumn("_at", F.min_by("_h.at", _best(F.col("_h"), F.col("row_ord"))).over(page))
    return named.withColumn("_t", _transaction(F.col("cells"), F.col("_at"))).select(*rows.columns, "_t.txn", "_t.error")


def bank_statements(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, transactions) of bank statements, from rows by the moving centre.

    statements has a row for each document with `reason`, null where it was read; transactions only
    those of such documents, numbered from 0.
    """
    whole = whole_statements(rows)
    each = whole.where("reason is null").select("document_id", F.posexplode("transactions").alias("row_index", "_t"))
    every = each.select("document_id", F.col("row_index").cast("long").alias("row_index"), "_t.page", "_t.txn.*", "_t.x0", "_t.y0", "_t.x1", "_t.y1")
    return whole.drop("transactions"), every


def whole_statements(rows: DataFrame) -> DataFrame:
    """Each document's statement with its transactions in an array, in one pass over the rows.

    Holder, number and period stand on the first page, totals on the last. `reason` is null where
    the document was read; the transactions are there in any case.
    """
    read = boxed(with_transactions(rows))
    at, place = F.struct("page", "row_ord"), F.struct((-F.col("page")).alias("page"), "row_ord")

    def first(found: Column, value: Column) -> Column:
        return F.min_by(F.when(found, F.struct("page", value.alias("v"))), F.when(found, at))

    def after(label: str) -> Column:
        rest = F.regexp_replace(F.expr(f"substring(text, {len(label) + 1})"), "^[ :]+", "")
        return first(F.col("text").startswith(label), F.trim(rest))

    def total(label: str) -> Column:
        pattern = rf"^{label}\s*:\s*{RINGGIT}"
        return F.min_by(F.when(F.col("text").rlike(pattern), F.struct("page", F.regexp_extract("text", pattern, 1).alias("v"))), F.when(F.col("text").rlike(pattern), place))

    docs = read.groupBy("document_id").agg(
        F.min("page").alias("_first"),
        F.max("page").alias("_last"),
        F.min_by(F.trim("text"), at).alias("_top"),
        after("Bank Name").alias("_bank"),
        after("Account Holder").alias("_holder"),
        after("Account Number").alias("_number"),
        first(F.exists("cells", lambda c: c["text"].contains("Statement Period")), F.col("text")).alias("_period"),
        *[total(label).alias(f"_{k}") for k, label in BANK_TOTALS.items()],
        F.min_by("error", F.when(F.col("error").isNotNull(), at)).alias("_error"),
        F.count("txn").alias("transaction_count"),
        F.sort_array(F.collect_list(F.when(F.col("txn").isNotNull(), F.struct("page", "row_ord", "txn", "x0", "y0", "x1", "y1")))).alias("transactions"),
    )
    return _judged(docs, "document_id")


def _judged(docs: DataFrame, *keep: str) -> DataFrame:
    """The statement of each document's findings, behind the columns `keep`; `reason` is null where it was read."""
    on_first = lambda c: F.nullif(F.when(F.col(f"{c}.page") == F.col("_first"), F.col(f"{c}.v")), F.lit(""))
    day = lambda k: F.try_to_date(F.regexp_extract("period", PERIOD, k), "dd MMM yyyy")
    sums = {k: F.when(F.col(f"_{k}.page") == F.col("_last"), F.replace(f"_{k}.v", F.lit(","), F.lit("")).try_cast(AMOUNT)) for k in BANK_TOTALS}
    named = docs.select(
        *keep,
        F.coalesce(on_first("_bank"), "_top").alias("bank_name"),
        on_first("_holder").alias("account_holder"),
        on_first("_number").alias("account_number"),
        on_first("_period").alias("period"),
        *[c.alias(k) for k, c in sums.items()],
        "_error",
        "transaction_count",
        "transactions",
    ).withColumns({"period_start": F.when(F.col("period").rlike(PERIOD), day(1)), "period_end": F.when(F.col("period").rlike(PERIOD), day(2))})
    absent = lambda *c: sum((F.col(x).isNull().cast("int") for x in c), F.lit(0)) > 0
    reason = (
        F.when(absent("account_holder", "account_number", "period"), "no holder, number or period")
        .when(absent("period_start", "period_end"), "period can't be read")
        .when(F.col("_error").isNotNull(), F.col("_error"))
        .when(absent(*BANK_TOTALS), "no totals")
    )
    return named.withColumn("reason", reason).select(*keep, "bank_name", "account_holder", "account_number", "period_start", "period_end", *BANK_TOTALS, "transaction_count", "reason", "transactions")


def paged(spans: Column) -> Column:
    """Spans with their page as an array of (page, spans), in the order of the pages."""
    runs = lambda s: _each_run(s, _starts(s, lambda before, x: ~before["page"].eqNullSafe(x["page"])), lambda start, n: F.struct(F.get(s, start - 1)["page"].alias("page"), F.slice(s, start, n).alias("spans")))
    return _let(F.sort_array(spans), runs)


def read_statements(docs: DataFrame, grouped: Callable[[Column], Column], *keep: str) -> DataFrame:
    """whole_statements() of documents that are one row each, behind the columns `keep`: nothing is shuffled or sorted but in the row.

    docs has `pages`, see paged(); grouped is clustered or bucketed. `transactions` has the txn of each.
    """

    def lines(p: Column) -> Column:
        def named(rows: Column) -> Column:
            best = F.array_min(F.transform(rows, lambda r, k: _let(_named(r["text"], r["cells"]), lambda h: F.struct(_best(h, k).alias("best"), h["at"].alias("at")))))
            return _let(best["at"], lambda at: F.transform(rows, lambda r: line(r, at)))

        def line(r: Column, at: Column) -> Column:
            period = F.exists(r["cells"], lambda c: c["text"].contains("Statement Period"))
            return F.struct(p["page"].alias("page"), r["text"].alias("text"), period.alias("period"), _transaction(r["cells"], at).alias("t"))

        return _let(F.transform(grouped(p["spans"]), lambda cells: F.struct(cells.alias("cells"), text_of(cells).alias("text"))), named)

    read = docs.select(*keep, F.flatten(F.transform("pages", lines)).alias("_lines"))
    ends = read.withColumns({"_first": F.array_min(F.transform("_lines", lambda r: r["page"])), "_last": F.array_max(F.transform("_lines", lambda r: r["page"]))})
    on = lambda page: F.filter("_lines", lambda r: r["page"] == F.col(page))
    cut = ends.select(*keep, "_first", "_last", on("_first").alias("_head"), on("_last").alias("_foot"), F.filter(F.transform("_lines", lambda r: r["t"]), lambda t: t.isNotNull()).alias("_t"))

    def first(rows: str, found: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
        hit = F.get(F.filter(rows, found), F.lit(0))
        return _let(hit, lambda r: F.when(r.isNotNull(), F.struct(r["page"].alias("page"), value(r["text"]).alias("v"))))

    def after(label: str) -> Column:
        rest = lambda t: F.trim(F.regexp_replace(F.substring(t, F.lit(len(label) + 1), F.length(t)), "^[ :]+", ""))
        return first("_head", lambda r: r["text"].startswith(label), rest)

    def total(label: str) -> Column:
        pattern = rf"^{label}\s*:\s*{RINGGIT}"
        return first("_foot", lambda r: r["text"].rlike(pattern), lambda t: F.regexp_extract(t, pattern, 1))

    found = cut.select(
        *keep,
        "_first",
        "_last",
        F.trim(F.get("_head", F.lit(0))["text"]).alias("_top"),
        after("Bank Name").alias("_bank"),
        after("Account Holder").alias("_holder"),
        after("Account Number").alias("_number"),
        first("_head", lambda r: r["period"], lambda t: t).alias("_period"),
        *[total(label).alias(f"_{k}") for k, label in BANK_TOTALS.items()],
        F.get(F.filter(F.transform("_t", lambda t: t["error"]), lambda e: e.isNotNull()), F.lit(0)).alias("_error"),
        F.size("_t").cast("long").alias("transaction_count"),
        F.transform("_t", lambda t: t["txn"]).alias("transactions"),
    )
    return _judged(found, *keep)


# -- accounts of two periods


def _signed(token: Column) -> Column:
    number = F.regexp_replace(token, "[(),]", "").try_cast(AMOUNT)
    return F.when(token.startswith("(") & token.endswith(")"), -number).otherwise(number)


def line_amounts(rows: DataFrame) -> DataFrame:
    """(document_id, page, row_ord, before_last, last): the last two amounts of each line with two or more."""
    found = rows.withColumn("_tokens", F.regexp_extract_all("text", F.lit(LINE_MONEY), 0)).where("size(_tokens) >= 2")
    return found.select(*PAGE, "row_ord", *[_signed(F.get("_tokens", F.size("_tokens") - n)).alias(name) for n, name in ((2, "before_last"), (1, "last"))])


def two_periods(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accounts, periods) of audited accounts, from rows by buckets.

    The first line for each label counts, if it holds two amounts: the last two are the current
    and the prior period's. Section headers are skipped; expenses are taken without their sign;
    amounts in thousands are multiplied out. accounts has `reason`, null where all was found;
    periods has two rows for each such document, the newer first.
    """
    at = F.struct("page", "row_ord")
    header = F.lit(False)
    for h in HEADERS:
        header = header | F.upper("text").contains(h)
    line, tokens = F.trim("text"), F.regexp_extract_all("text", F.lit(LINE_MONEY), 0)
    field = F.coalesce(*[F.when(F.col("_line").startswith(label), name) for label, name in LINES.items()])
    lined = rows.withColumns({"_line": line, "_header": header, "_tokens": tokens}).withColumn("field", F.when(~F.col("_header") & (F.size("_tokens") >= 2), field))
    pair = F.struct(_signed(F.get("_tokens", F.size("_tokens") - 2)).alias("current"), _signed(F.get("_tokens", F.size("_tokens") - 1)).alias("prior"))
    auditor = F.get(F.filter("cells", lambda c: c["text"].startswith("Audited by:")), F.lit(0))["text"]
    heads = lined.groupBy("document_id").agg(
        F.min("page").alias("_first"),
        F.min_by(F.trim(F.get("cells", F.lit(0))["text"]), at).alias("company_name"),
        F.min_by(F.when(F.col("text").rlike(YEAR_LINE), F.struct("page", F.regexp_extract("text", YEAR_LINE, 1).alias("v"))), F.when(F.col("text").rlike(YEAR_LINE), at)).alias("_year"),
        F.trim(F.regexp_replace(F.min_by(auditor, F.when(auditor.isNotNull(), at)), "^Audited by:", "")).alias("auditor"),
        F.bool_or(F.col("text").rlike(THOUSANDS)).alias("_thousands"),
        *[F.min_by(F.when(F.col("field") == name, pair), F.when(F.col("field") == name, at)).alias(name) for name in LINES.values()],
    )
    missing = F.array_compact(F.array(*[F.when(F.col(name).isNull(), name) for name in sorted(LINES.values())]))
    year = F.try_to_date(F.regexp_replace(F.when(F.col("_year.page") == F.col("_first"), F.col("_year.v")), r"\s+", " "), "d MMMM yyyy")
    named = heads.withColumns({"year_end": year, "multiplier": F.when(F.col("_thousands"), 1000).otherwise(1), "_missing": F.array_join(missing, ", ")})
    prior = F.expr("try_make_timestamp(year(year_end) - 1, month(year_end), day(year_end), 0, 0, 0)").cast("date")
    named = named.withColumn("prior_year_end", F.when(F.col("year_end").isNotNull(), prior))
    reason = (
        F.when(F.col("_year").isNull() | (F.col("_year.page") != F.col("_first")), "no financial year")
        .when(F.col("auditor").isNull(), "no auditor")
        .when(F.col("year_end").isNull(), "no such date")
        .when(F.col("_missing") != "", F.concat(F.lit("lines not found: "), "_missing"))
        .when(F.col("prior_year_end").isNull(), "no such date a year before")
    )
    named = named.withColumn("reason", reason)

    def period(index: int, of: str, end: str) -> Column:
        def amount(name: str) -> Column:
            value = (F.col(f"{name}.{of}") * F.col("multiplier")).cast(AMOUNT)
            return (F.abs(value) if name in EXPENSES else value).alias(name)

        return F.struct(F.lit(index).alias("period_index"), F.col(end).alias("period_end"), *[amount(n) for n in LINES.values()])

    both = named.where("reason is null").select("document_id", F.explode(F.array(period(0, "current", "year_end"), period(1, "prior", "prior_year_end"))).alias("_p")).select("document_id", "_p.*")
    return named.select("document_id", "company_name", "auditor", "year_end", "multiplier", "reason"), both


# -- labelled forms


def _form(rows: DataFrame, labels: dict[str, str]) -> list[Column]:
    """For each label the value behind `Label:` on the first row that begins with it."""
    at = F.struct("page", "row_ord")
    out = []
    for label, name in labels.items():
        hit = F.col("text").startswith(f"{label}:")
        out.append(F.trim(F.min_by(F.expr(f"substring(text, {len(label) + 2})"), F.when(hit, at))).alias(name))
    return out


def _ringgit(name: str) -> Column:
    return F.replace(F.nullif(F.regexp_extract(name, RINGGIT, 1), F.lit("")), F.lit(","), F.lit("")).try_cast(AMOUNT)


def registrations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registrations, directors) of company registrations; a row for each document with `reason`."""
    people = directors(rows)
    heads = rows.groupBy("document_id").agg(*_form(rows, REGISTRATION))
    counts = people.groupBy("document_id").agg(F.count("*").alias("director_count"))
    named = heads.join(counts, "document_id", "left").fillna(0, ["director_count"])
    missing = F.coalesce(*[F.when(F.col(name).isNull(), F.concat(F.lit("not found: "), F.lit(label))) for label, name in REGISTRATION.items()])
    day, capital = F.try_to_date("incorporation_date", "d MMMM yyyy"), _ringgit("paid_up_capital")
    reason = missing
    for bad, why in ((F.col("director_count") == 0, "no directors"), (day.isNull(), "no such date"), (capital.isNull(), "no amount")):
        reason = F.coalesce(reason, F.when(bad, why))
    out = named.withColumn("reason", reason).withColumns({"incorporation_date": day, "paid_up_capital": capital})
    return out, people.join(out.where("reason is null").select("document_id"), "document_id", "left_semi")


def tax_returns(rows: DataFrame) -> DataFrame:
    """Tax returns, a row for each document with `reason`; a value that is missing or empty rejects it."""
    named = rows.groupBy("document_id").agg(*_form(rows, TAX))
    empty = sum((F.coalesce(F.col(n), F.lit("")).eqNullSafe("").cast("int") for n in TAX.values()), F.lit(0)) > 0
    year = F.col("year_of_assessment").try_cast("int")
    sums = {n: _ringgit(n) for n in ("gross_business_income", "chargeable_income", "tax_payable")}
    bad = year.isNull().cast("int") + sum((c.isNull().cast("int") for c in sums.values()), F.lit(0)) > 0
    return named.withColumn("reason", F.when(empty, "fields not found").when(bad, "no number")).withColumns({"year_of_assessment": year} | sums)


# -- accuracy


def _sides(value: Column, kind: str) -> tuple[Column, Column]:
    """A value as (number, text): amounts as numbers, the rest as text, blanks squeezed."""
    if kind.startswith("decimal"):
        return value.cast(AMOUNT), F.lit(None).cast("string")
    text = value.cast("string")
    return F.lit(None).cast(AMOUNT), F.trim(F.regexp_replace(text, r"\s+", " ")) if kind == "string" else text


def long_form(rows: DataFrame, kind: str, fields: list[str], prefix: Column | None = None) -> DataFrame:
    """(document_id, kind, field, number, text): a row for each field; amounts as numbers, the rest as text, blanks squeezed."""
    types = dict(rows.dtypes)

    def one(name: str) -> Column:
        number, text = _sides(F.col(name), types[name])
        return F.struct((F.concat(prefix, F.lit(name)) if prefix is not None else F.lit(name)).alias("field"), number.alias("number"), text.alias("text"))

    return rows.select("document_id", F.lit(kind).alias("kind"), F.explode(F.array(*map(one, fields))).alias("_f")).select("document_id", "kind", "_f.*")


def _agree(e: tuple[Column, Column], a: tuple[Column, Column], tolerance: str) -> Column:
    """Two amounts match within the tolerance, all else if equal or both null."""
    near = F.abs(e[0] - a[0]) <= F.lit(tolerance).cast(AMOUNT)
    return F.when(e[0].isNotNull() & a[0].isNotNull(), near).otherwise(e[0].eqNullSafe(a[0]) & e[1].eqNullSafe(a[1]))


def compared(expected: DataFrame, actual: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """(document_id, kind, field, matched, expected, actual) of fields on both sides; two amounts match within the tolerance, all else if equal or both null."""
    a = actual.select("document_id", "kind", "field", F.col("number").alias("_n"), F.col("text").alias("_t"))
    both = expected.join(a, ["document_id", "kind", "field"])
    matched = _agree((F.col("number"), F.col("text")), (F.col("_n"), F.col("_t")), tolerance)
    text = lambda n, t: F.coalesce(F.col(n).cast("string"), F.col(t))
    return both.select("document_id", "kind", "field", matched.alias("matched"), text("number", "text").alias("expected"), text("_n", "_t").alias("actual"))


def verdicts(expected: Column, actual: Column, types: tuple[dict[str, str], dict[str, str]], fields: list[str], prefix: Column | None = None, tolerance: str = "0.01") -> Column:
    """compared() of two structs as an array of (field, matched, expected, actual)."""

    def one(name: str) -> Column:
        e, a = _sides(expected[name], types[0][name]), _sides(actual[name], types[1][name])
        text = lambda x: F.coalesce(x[0].cast("string"), x[1])
        field = F.concat(prefix, F.lit(name)) if prefix is not None else F.lit(name)
        return F.struct(field.alias("field"), _agree(e, a, tolerance).alias("matched"), text(e).alias("expected"), text(a).alias("actual"))

    return F.array(*map(one, fields))


def compared_records(expected: DataFrame, actual: DataFrame, kind: str, fields: list[str], prefix: Column | None = None, key: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """compared() of records that are joined whole, by their key, and taken apart afterwards; `prefix` is made of the key."""
    e, a = (rows.select(*key, F.struct(*fields).alias(name)) for rows, name in ((expected, "_e"), (actual, "_a")))
    found = verdicts(F.col("_e"), F.col("_a"), (dict(expected.dtypes), dict(actual.dtypes)), fields, prefix)
    return e.join(a, list(key)).select("document_id", F.lit(kind).alias("kind"), F.explode(found).alias("_f")).select("document_id", "kind", "_f.*")


def compared_statements(read: DataFrame, heads: DataFrame, rows: DataFrame, head_fields: list[str], row_fields: list[str], key: str = "document_id", every: bool = False) -> DataFrame:
    """(document_id, kind, field, matched, expected, actual) of whole_statements() that were read, in one pass.

    heads and rows are what was drawn, by document and row_index from 0 without gaps; `key` is read's column that
    holds their document_id. A statement's fields are compared if it was drawn, a row's if both sides have it.
    With `every`, documents of which nothing is compared stay as a row of nulls.
    """
    types, drawn = dict(read.dtypes), rows.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("row_index", *row_fields))).alias("_rows"))
    of_rows = dict(read.select(F.explode("transactions").alias("_t")).select("_t.txn.*").dtypes)
    truth = heads.select(F.col("document_id").alias("_k"), F.struct(*head_fields).alias("_e")).join(drawn.withColumnRenamed("document_id", "_k"), "_k", "full")
    good = F.col("reason").isNull()
    sides = read.select("document_id", F.col(key).alias("_k"), F.when(good, F.struct(*head_fields)).alias("_a"), F.when(good, F.transform("transactions", lambda t: t["txn"])).alias("_txns"), good.alias("_good"))
    both = (sides if every else sides.where("_good")).join(truth, "_k", "left" if every else "inner")
    nothing = F.array(F.lit(None).cast(read.schema["transactions"].dataType.elementType["txn"].dataType))
    items = both.select("document_id", "_e", "_a", "_rows", F.posexplode(F.concat(nothing, F.coalesce("_txns", F.slice(nothing, 1, 0)))).alias("_at", "_t"))
    first = F.col("_at") == 0
    one = items.select("document_id", F.when(first, F.col("_e")).alias("_e"), F.when(first, F.col("_a")).alias("_a"), F.get("_rows", F.col("_at") - 1).alias("_r"), "_t")
    head = verdicts(F.col("_e"), F.col("_a"), (dict(heads.dtypes), types), head_fields)
    row = verdicts(F.col("_r"), F.col("_t"), (dict(rows.dtypes), of_rows), row_fields, F.concat(F.lit("transactions["), F.col("_r.row_index"), F.lit("].")))
    found = F.when(F.col("_e").isNotNull() & F.col("_a").isNotNull(), head).when(F.col("_r").isNotNull() & F.col("_t").isNotNull(), row)
    fields = one.select("document_id", F.lit("bank_statement").alias("kind"), (F.explode_outer if every else F.explode)(found).alias("_f"))
    return fields.select("document_id", "kind", "_f.*")


def statement_verdicts(read: DataFrame, head_fields: list[str], row_fields: list[str]) -> Column:
    """compared_statements() as an array for each of read_statements(), kept with what was drawn: `_e`, a struct of
    head_fields, and `_rows`, an array of (row_index, row_fields) by row_index; null where the document wasn't read."""
    types = lambda struct: {f.name: f.dataType.simpleString() for f in struct.fields}
    of_e, of_rows, of_txns = types(read.schema["_e"].dataType), types(read.schema["_rows"].dataType.elementType), types(read.schema["transactions"].dataType.elementType)
    head = verdicts(F.col("_e"), F.struct(*head_fields), (of_e, dict(read.dtypes)), head_fields)
    each = lambda r, t: verdicts(r, t, (of_rows, of_txns), row_fields, F.concat(F.lit("transactions["), r["row_index"], F.lit("].")))
    both = F.slice("transactions", 1, F.least(F.size("transactions"), F.size("_rows")))
    rows = F.flatten(F.transform(both, lambda t, j: _let(F.get("_rows", j), lambda r: each(r, t))))
    return F.when(F.col("reason").isNull(), F.concat(head, rows))


def accuracy(comparisons: DataFrame, by: list[str], groups: DataFrame) -> DataFrame:
    """fields_total, fields_matched and accuracy of each of `groups`; 1.0 where nothing was compared."""
    sums = comparisons.groupBy(*by).agg(F.count("*").alias("fields_total"), F.count(F.when(F.col("matched"), 1)).alias("fields_matched"))
    out = groups.join(sums, by, "left").fillna(0, ["fields_total", "fields_matched"])
    return out.withColumn("accuracy", F.when(F.col("fields_total") == 0, 1.0).otherwise(F.round(F.col("fields_matched") / F.col("fields_total"), 6)))


def shifted(spans: DataFrame, scenarios: dict[str, tuple[float, float]]) -> DataFrame:
    """spans of each scenario, the document's id behind its name: all moved right, and every other one down or up."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(h)).alias("h"), F.lit(float(v)).alias("v")) for n, (h, v) in scenarios.items()]))
    down = F.when(F.col("i") % 2 == 1, F.col("_s.v")).otherwise(-F.col("_s.v"))
    moved = spans.withColumn("_s", each)
    return moved.select(F.concat("_s.scenario", F.lit("|"), "document_id").alias("document_id"), "page", "i", (F.col("x0") + F.col("_s.h")).alias("x0"), (F.col("y0") + down).alias("y0"), (F.col("x1") + F.col("_s.h")).alias("x1"), (F.col("y1") + down).alias("y1"), "text")


def shifted_pages(pages: Column, right: Column, down: Column) -> Column:
    """shifted() of paged() spans by one scenario's shifts."""

    def moved(s: Column) -> Column:
        by = F.when(s["i"] % 2 == 1, down).otherwise(-down)
        return F.struct(s["i"].alias("i"), (s["x0"] + right).alias("x0"), (s["y0"] + by).alias("y0"), (s["x1"] + right).alias("x1"), (s["y1"] + by).alias("y1"), s["text"].alias("text"))

    return F.transform(pages, lambda p: F.struct(p["page"].alias("page"), F.transform(p["spans"], moved).alias("spans")))
