"""Input tables whose one SQL text both engines read: Spark for the queries, DuckDB for the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packaudit.plans import views
from packaudit.plans.sql_views import VIEWS

#: What an input table is in Spark, by its name in SQL.
FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "f_txn": views.ledger,
    "f_stmt": views.statements,
    "f_period": views.periods,
    **{t: lambda spark, d, t=t: views.table(spark, d, t) for t in ("events", "documents", "conversations", "benchmark", "supplier")},
}
#: Functions whose names differ: (Spark, DuckDB), the argument without brackets of its own.
MACROS = {
    "MONEYTEXT": ("format_number({0}, 2)", "format('{{:,.2f}}', CAST({0} AS DOUBLE))"),
    "DAYTEXT": ("date_format({0}, 'dd MMM yyyy')", "strftime({0}, '%d %b %Y')"),
    # DuckDB divides amounts as doubles and rounds the hundredths of the quotient, so halves may fall to either side; Spark's decimals would keep them
    "INUNITS": ("CAST(CAST(round(CAST(abs({0}) AS DOUBLE) / unit * 100) AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2))", "CAST(abs({0}) / unit AS DECIMAL(18,2))"),
    "LONGDAY": ("date_format({0}, 'dd MMMM yyyy')", "strftime({0}, '%d %B %Y')"),
}


def _said(sql: str, engine: int) -> str:
    for name, forms in MACROS.items():
        sql = re.sub(rf"\b{name}\(([^()]*)\)", lambda m, f=forms[engine]: f.format(m[1]), sql)
    return sql


def exploded(rows: str, structs: list[dict[str, str]], keep: list[str]) -> Callable[[int], str]:
    """SQL for either engine: each row of `rows` as several, one for each struct of expressions, where its condition in `keep` holds."""

    def made(engine: int) -> str:
        form = "named_struct({})" if engine == 0 else "{{{}}}"
        pair = "'{}', {}" if engine == 0 else "'{}': {}"
        each = ", ".join(form.format(", ".join(pair.format(k, v) for k, v in ({"keep": where} | s).items())) for s, where in zip(structs, keep, strict=True))
        whole = f"explode(array({each}))" if engine == 0 else f"unnest([{each}])"
        return f"SELECT {', '.join(f'c.{k} AS {k}' for k in structs[0])} FROM (SELECT {whole} AS c FROM {rows}) AS e WHERE c.keep"

    return made


def listed(structs: list[dict[str, str]], keep: list[str]) -> str:
    """Spark's SQL for an array of the structs whose condition in `keep` holds."""
    each = ", ".join(f"CASE WHEN {where} THEN named_struct({', '.join(f"'{k}', {v}" for k, v in s.items())}) END" for s, where in zip(structs, keep, strict=True))
    return _said(f"array_compact(array({each}))", 0)


def shared(name: str, sql: str | Callable[[int], str]) -> Callable[[SparkSession, str], DataFrame]:
    """Adds the table to the SQL views, and gives it as a function of (spark, sf_dir) and of input tables that are there already, by name."""
    text_for = sql if callable(sql) else lambda engine: sql
    VIEWS[name] = _said(text_for(1), 1)

    def make(spark: SparkSession, d: str, **there: DataFrame) -> DataFrame:
        text, needs = _said(text_for(0), 0), {}
        for other in FRAMES:
            if other != name and re.search(rf"\b{other}\b", text):
                needs[other] = there[other] if other in there else FRAMES[other](spark, d)
                text = re.sub(rf"\b{other}\b", f"{{{other}}}", text)
        return spark.sql(text, **needs)

    FRAMES[name] = make
    return make
