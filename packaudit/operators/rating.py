"""The rule-based rating of a package in five dimensions, and the guards that follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is said where evidence is missing, and what a person should look at
CLARIFY = "Critical document inconsistencies require clarification before character can be relied upon."
REGULAR = "Transaction activity is regular and no critical document inconsistency was detected."
NO_METRICS = "No bank-statement cash-flow metrics were available."
NO_RATIOS = "Audited financial ratios were not available to assess the capital cushion."
NO_SECURITY = "The supplied financial package does not establish ownership, valuation, or legal enforceability of collateral."
NO_MARKET = "The supplied package does not provide external market, industry, customer concentration, supplier dependence or facility-purpose evidence needed to assess Conditions."
RESOLVE = " Material validation findings must also be resolved before the package can be relied upon."
FLAGS = {
    "Character": "Verify adverse credit and director history externally",
    "Capacity": "Recalculate debt service using the proposed facility terms",
    "Capital": "Confirm audited figures against signed statements",
    "Collateral": "Request the asset schedule, valuation and security documents",
    "Conditions": "Review sector outlook and facility purpose",
}
PARTIAL = "Available bank or financial metrics provide partial evidence, not verified debt-servicing capacity. "
NEITHER = "No bank or audited financial metrics are available to verify debt-servicing capacity. "
NO_CAPACITY = "Without verified repayment obligations, this prototype does not assign a capacity strength rating. Missing evidence is not evidence of weakness."
SCHEDULE = "Verify existing and proposed repayment obligations against the actual repayment schedule."
OBTAIN = "Obtain financial statements and verify existing and proposed repayment obligations."
NOT_SUSTAINED = "The supplied documents do not establish sustained payment conduct across the configured review period. "
LIMITED = "Limited bank activity is an observation, not proof of reliable repayment behaviour. "
NO_ACTIVITY = "No bank-activity evidence is available to assess payment conduct or repayment behaviour. "
NOT_COMPLIANCE = " not verify current legal compliance, tax filing acceptance or tax payment. "
NOT_POOR = "Missing evidence is not evidence of poor character."
CONCENTRATED = ("Retrieved management accounts report customer or supplier concentration of ", ". This prototype treats concentration at or above 50% as a material dependency-risk flag requiring human review, so Conditions cannot be rated adequate from the supplied package.")
DEPENDENCE = "Review customer and supplier concentration and verify mitigation or alternative counterparties."

NONE = "array<string>"


def _list(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(application_id, name): values in the order of ord."""
    made = rows.groupBy("application_id").agg(F.sort_array(F.collect_list(F.struct("ord", value.alias("v")))).alias("_v"))
    return made.select("application_id", F.transform("_v", lambda x: x["v"]).alias(name))


def facts(packages: DataFrame, metrics: DataFrame, findings: DataFrame, ratios: DataFrame, citable: DataFrame) -> DataFrame:
    """One row per package with what the rating looks at.

    metrics: (application_id, ord, document_id, net_change) of bank statements; findings:
    (application_id, severity); ratios: (application_id, ord, document_id, debt_to_equity, debt_band,
    current_ratio, debt_service, period_end, cash_from_operations, ebit, interest_coverage) of audited
    accounts; citable: (application_id, chunk_id). Only counts, sums and at most three ids of a
    package's statements are gathered.
    """
    named = lambda rows, kind: rows.withColumn("chunk_id", F.concat("document_id", F.lit(kind)))
    known = citable.select("application_id", "chunk_id").distinct().withColumn("_known", F.lit(True))
    said = F.concat(F.lit("For FY "), F.col("period_end").cast("string"), F.lit(", reported cash from operations is RM"), F.coalesce(F.col("cash_from_operations").cast("string"), F.lit("unavailable")), F.lit(", EBIT is RM"), F.coalesce(F.col("ebit").cast("string"), F.lit("unavailable")), F.lit(" and interest coverage is "), F.coalesce(F.col("interest_coverage").cast("string"), F.lit("None")), F.lit("."))
    sums = metrics.groupBy("application_id").agg(F.count("*").alias("n_metrics"), F.sum("net_change").cast("decimal(18,2)").alias("net_change"))
    worst = findings.groupBy("application_id").agg(F.bool_or(F.col("severity") == "critical").alias("critical"), F.bool_or(F.col("severity") == "warning").alias("warning"))
    # one pass over the periods, each with its id if that may be cited
    each = F.struct("ord", F.when(F.col("_known"), F.col("chunk_id")).alias("id"), said.alias("text"))
    periods = (
        named(ratios, ":period:0")
        .join(known, ["application_id", "chunk_id"], "left")
        .groupBy("application_id")
        .agg(F.count("*").alias("n_ratios"), F.count("debt_service").alias("n_service"), F.min_by(F.struct("debt_to_equity", "debt_band", "current_ratio"), "ord").alias("latest"), F.sort_array(F.collect_list(each)).alias("_all"))
        .withColumn("_cited", F.filter("_all", lambda x: x["id"].isNotNull()))
        .withColumns({"period_ids": F.col("_cited.id"), "first_period_ids": F.filter("_cited", lambda x: x["ord"] <= 3)["id"], "period_texts": F.col("_all.text")})
        .drop("_all", "_cited")
    )
    banks = named(metrics.where("ord <= 3"), ":summary:0").join(known, ["application_id", "chunk_id"], "left_semi")
    out = packages
    for part in (sums, worst, _list(banks, F.col("chunk_id"), "bank_ids"), periods):
        out = out.join(part, "application_id", "left")
    empty = F.array().cast(NONE)
    out = out.fillna(0, ["n_metrics", "n_ratios", "n_service"]).fillna(False, ["critical", "warning"])
    return out.withColumns({c: F.coalesce(c, empty) for c in ("bank_ids", "period_ids", "first_period_ids", "period_texts")})


def ratings(of: DataFrame) -> DataFrame:
    """(application_id, place, dimension, rating, reasoning, evidence array, flags array): five rows for each row of facts()."""
    critical = F.col("critical")
    none = F.lit("insufficient_data")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    sound = F.col("latest.debt_band").isin("healthy", "acceptable")
    rows = {
        "Character": (F.when(critical, "weak").when(F.col("warning"), "adequate").otherwise("strong"), F.when(critical, CLARIFY).otherwise(REGULAR), F.col("bank_ids")),
        "Capacity": (
            F.when(F.col("n_metrics") == 0, none).when((F.col("net_change") > 0) & ~critical, "strong").otherwise("weak"),
            F.when(F.col("n_metrics") == 0, NO_METRICS).otherwise(F.concat(F.lit("Across "), "n_metrics", F.lit(" bank statements, aggregate net movement is RM "), F.format_number("net_change", 2), F.lit("."))),
            F.col("bank_ids"),
        ),
        "Capital": (
            F.when(F.col("n_ratios") == 0, none).when(sound, "strong").otherwise("weak"),
            F.when(F.col("n_ratios") == 0, NO_RATIOS).otherwise(F.concat(F.lit("The latest audited debt-to-equity ratio is "), number("latest.debt_to_equity"), F.lit(" and current ratio is "), number("latest.current_ratio"), F.lit("."))),
            F.col("first_period_ids"),
        ),
        "Collateral": (none, F.lit(NO_SECURITY), F.array().cast(NONE)),
        "Conditions": (none, F.concat(F.lit(NO_MARKET), F.when(critical, RESOLVE).otherwise("")), F.col("bank_ids")),
    }
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(d).alias("dimension"), r.alias("rating"), t.alias("reasoning"), e.alias("evidence"), F.array(F.lit(FLAGS[d])).alias("flags")) for i, (d, (r, t, e)) in enumerate(rows.items())])
    return of.select("application_id", F.explode(each).alias("_d")).select("application_id", "_d.*")


def guarded(rated: DataFrame, of: DataFrame, gaps: DataFrame, supplied: DataFrame, concentration: DataFrame, citable: DataFrame) -> DataFrame:
    """ratings() after the guards, in their order: capacity without debt service, character without full bank months, conditions with concentration.

    gaps: (application_id) of packages with missing bank months; supplied: (application_id, has_registration,
    has_tax_return); concentration: (application_id, percentages array<string>, chunk_ids array<string>).
    """
    ids = concentration.join(of.select("application_id"), "application_id", "left_semi").select("application_id", F.posexplode("chunk_ids").alias("ord", "chunk_id")).join(citable.distinct(), ["application_id", "chunk_id"], "left_semi")
    known = of.select("application_id", "n_metrics", "n_ratios", "n_service", "period_ids", "period_texts").join(gaps.select("application_id").distinct().withColumn("gap", F.lit(True)), "application_id", "left")
    known = known.join(supplied, "application_id", "left").join(concentration.select("application_id", "percentages"), "application_id", "left").join(_list(ids, F.col("chunk_id"), "dependence_ids"), "application_id", "left")
    known = known.fillna(False, ["gap", "has_registration", "has_tax_return"])
    rows = rated.join(known, "application_id")
    has = lambda c: F.col(c) > 0
    # capacity
    unknown = (F.col("dimension") == "Capacity") & (F.col("n_service") == 0)
    periods = F.when(has("n_ratios"), F.concat(F.lit(" "), F.array_join("period_texts", " "))).otherwise("")
    capacity = F.concat(F.when(has("n_metrics") | has("n_ratios"), PARTIAL).otherwise(NEITHER), F.lit(NO_CAPACITY), periods)
    # character
    unsettled = (F.col("dimension") == "Character") & (F.col("gap") | ~has("n_metrics"))
    papers = F.array_compact(F.array(F.when(F.col("has_registration"), "SSM registration"), F.when(F.col("has_tax_return"), "a tax return")))
    compliance = F.when(F.size(papers) > 0, F.concat(F.array_join(papers, " and "), F.lit(" alone "), F.when(F.size(papers) == 1, "does").otherwise("do"), F.lit(NOT_COMPLIANCE))).otherwise("")
    character = F.concat(F.lit(NOT_SUSTAINED), F.when(has("n_metrics"), LIMITED).otherwise(NO_ACTIVITY), compliance, F.lit(NOT_POOR))
    looks = F.array_compact(F.array(F.lit("Review the missing banking history"), F.when(F.col("has_registration"), "independently verify registration status"), F.when(F.col("has_tax_return"), "verify tax filing acceptance and payment records")))
    # conditions
    dependent = (F.col("dimension") == "Conditions") & (F.size(F.coalesce("percentages", F.array().cast(NONE))) > 0)
    shown = F.array_join(F.transform("percentages", lambda p: F.concat(F.regexp_replace(p, r"\.0+$", ""), F.lit("%"))), " and ")
    more = lambda ids: F.array_distinct(F.concat("evidence", F.coalesce(ids, F.array().cast(NONE))))
    return rows.select(
        "application_id",
        "place",
        "dimension",
        F.when(unknown | unsettled, "insufficient_data").when(dependent, "weak").otherwise(F.col("rating")).alias("rating"),
        F.when(unknown, capacity).when(unsettled, character).when(dependent, F.concat(F.lit(CONCENTRATED[0]), shown, F.lit(CONCENTRATED[1]))).otherwise(F.col("reasoning")).alias("reasoning"),
        F.when(unknown, more(F.col("period_ids"))).when(dependent, more(F.col("dependence_ids"))).otherwise(F.col("evidence")).alias("evidence"),
        F.when(unknown, F.array_distinct(F.concat("flags", F.array(F.when(has("n_ratios"), SCHEDULE).otherwise(OBTAIN)))))
        .when(unsettled, F.concat("flags", F.array(F.concat(F.array_join(looks, "; "), F.lit(".")))))
        .when(dependent, F.array_distinct(F.concat("flags", F.array(F.lit(DEPENDENCE)))))
        .otherwise(F.col("flags"))
        .alias("flags"),
    )


def human_checks(checks: DataFrame, codes: DataFrame) -> DataFrame:
    """(application_id, place, check): checks (application_id, ord, check) without those that begin with a finding's code, one of each subject.

    The first check of a subject stays: repayment, bank evidence, accounts, registration, collateral,
    conditions, or else the check's own words.
    """
    from pyspark.sql import Window

    said = checks.withColumn("check", F.regexp_replace("check", r"^\s+|\s+$", "")).where("check <> ''")
    named = codes.groupBy("application_id").agg(F.collect_set(F.lower("code")).alias("_codes"))
    head = F.lower(F.regexp_extract("check", r"^([^:\s]+)\s*:", 1))
    open_ = said.join(named, "application_id", "left").where(~F.coalesce(F.array_contains("_codes", head), F.lit(False)))
    low = F.lower("check")
    has = lambda *w: low.rlike("|".join(w))
    subject = (
        F.when(has("repayment", "debt service"), "repayment")
        .when(has("bank statement", "banking history"), "bank_evidence")
        .when(has("audited financial"), "audited_financials")
        .when(has("ssm", "registration status"), "registration")
        .when(has("collateral", "facility statement", "security document"), "collateral")
        .when(has("management account", "industry condition"), "conditions")
        .otherwise(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")))
    )
    first = F.row_number().over(Window.partitionBy("application_id", subject).orderBy("ord")) == 1
    kept = open_.withColumn("_first", first).where("_first")
    return kept.select("application_id", F.row_number().over(Window.partitionBy("application_id").orderBy("ord")).alias("place"), "check")
