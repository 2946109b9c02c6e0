"""Recommendations: threshold rules over check rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import fixed, grouped
from .assess import passed

# fixed values: thresholds
MANY_DUPLICATES = 1000
HIGH_NULLS, SOME_NULLS, MANY_NULL_COLUMNS = 20, 5, 5
HIGH_CV, HIGH_UNIQUE_RATIO, MIN_UNIQUE = 35, 0.95, 100
WIDE_TABLE = 10
LOW_PASS_RATE, FAIR_PASS_RATE = 0.5, 0.8
NAMED_COLUMNS = 3

# fixed values: titles, texts and priorities; {} marks the computed part
RULES = {
    "duplicates": (
        "Remove Duplicate Records", None,
        "Found {} duplicate records. Consider implementing deduplication logic using business keys or primary key constraints. Use SQL DISTINCT, ROW_NUMBER() window functions, or unique constraints.",
    ),
    "high_nulls": (
        "Address High Null Value Columns", "High",
        "Columns {} have >20% null values. Consider: 1) Data source validation, 2) Default value strategies, 3) Imputation techniques, or 4) Column removal if not critical.",
    ),
    "some_nulls": (
        "Implement Null Handling Strategy", "Medium",
        "Columns {} have 5-20% null values. Consider implementing NOT NULL constraints, data validation rules, or imputation strategies based on business logic.",
    ),
    "many_null_columns": (
        "Comprehensive Data Governance", "Medium",
        "{} columns have null values. Implement data governance policies including mandatory field validation, data entry training, and upstream data quality monitoring.",
    ),
    "variability": (
        "Investigate High Variability in {}", "Low",
        "Column `{}` has high variability (CV={}). Review for outliers, data entry errors, or consider data transformation/normalization techniques.",
    ),
    "cardinality": (
        "High Cardinality in {}", "Low",
        "Column `{}` has very high cardinality ({} unique values). Consider data normalization, categorization, or indexing strategies for performance.",
    ),
    "wide_table": (
        "Data Documentation and Profiling", "Low",
        "Dataset has {} columns. Consider creating data dictionaries, establishing column-level monitoring, and implementing regular statistical profiling to track data drift over time.",
    ),
    "errors": (
        "Fix Check Execution Errors", "High",
        "Data quality checks {} failed to execute. Review database connectivity, permissions, and data availability. Ensure stable monitoring infrastructure.",
    ),
    "low_pass_rate": (
        "Establish Data Quality Framework", "High",
        "Only {} of checks passed. Consider implementing: 1) Data validation at ingestion, 2) Regular quality monitoring, 3) Data stewardship roles, 4) Quality metrics dashboards.",
    ),
    "fair_pass_rate": (
        "Enhance Data Quality Processes", "Medium",
        "{} pass rate indicates room for improvement. Implement automated quality gates, exception handling, and proactive monitoring for sustained quality.",
    ),
}
PRIORITIES = ("High", "Medium", "Low")


def fill(text: str, *parts: Column) -> Column:
    """Put columns at the {} marks of a text."""
    pieces = text.split("{}")
    out = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:]):
        out += [part, F.lit(piece)]
    return F.concat(*out)


def _advice(rule: str, *parts: Column, title: tuple[Column, ...] = (), priority: Column | None = None) -> Column:
    name, level, text = RULES[rule]
    level = F.lit(level) if priority is None else priority
    return F.struct(
        F.lit(rule).alias("rule_id"), fill(name, *title).alias("title"), fill(text, *parts).alias("description"), level.alias("priority")
    )


def _named(columns: Column) -> Column:
    first = F.slice(columns, 1, NAMED_COLUMNS)
    return F.array_join(F.transform(first, lambda c: F.concat(F.lit("`"), c["column_name"], F.lit("`"))), ", ")


def advice(checks: Column) -> Column:
    """Array of advice for one table's array of check structs."""

    def one(name):
        return F.get(F.filter(checks, lambda c: c["check_name"] == name), F.lit(0))

    dup, nulls, stats = one("duplicates"), one("null_values"), one("descriptive_stats")
    nulls_ok, stats_ok = nulls["status"] == "success", stats["status"] == "success"
    high = F.filter(nulls["columns"], lambda c: c["null_percentage"] > HIGH_NULLS)
    some = F.filter(nulls["columns"], lambda c: (c["null_percentage"] > SOME_NULLS) & (c["null_percentage"] <= HIGH_NULLS))
    width, qty = F.size(nulls["columns"]), dup["metric_value"]

    def of_column(c: Column) -> Column:
        cv = c["std"] / F.abs(c["mean"]) * 100
        ratio = c["unique"] / c["count"]
        shaky = c["std"].isNotNull() & (c["mean"] != 0)
        return F.array(
            F.when(F.when(shaky, cv > HIGH_CV), _advice("variability", c["column_name"], fixed(cv, 2), title=(c["column_name"],))),
            F.when(
                F.when(c["count"] > 0, (ratio > HIGH_UNIQUE_RATIO) & (c["unique"] > MIN_UNIQUE)),
                _advice("cardinality", c["column_name"], grouped(c["unique"]), title=(c["column_name"],)),
            ),
        )

    failed = F.filter(checks, lambda c: c["status"] == "error")
    rate = F.size(F.filter(checks, lambda c: c["passed"])) / F.size(checks)
    shown = F.concat(F.format_number(rate * 100, 0), F.lit("%"))
    before = F.array(
        F.when(qty > 0, _advice("duplicates", grouped(qty), priority=F.when(qty > MANY_DUPLICATES, "High").otherwise("Medium"))),
        F.when(nulls_ok & (F.size(high) > 0), _advice("high_nulls", _named(high))),
        F.when(nulls_ok & (F.size(some) > 0), _advice("some_nulls", _named(some))),
        F.when(nulls_ok & (width > MANY_NULL_COLUMNS), _advice("many_null_columns", width.cast("string"))),
    )
    per_column = F.when(stats_ok, F.flatten(F.transform(stats["columns"], of_column)))
    after = F.array(
        F.when(stats_ok & (F.size(stats["columns"]) > WIDE_TABLE), _advice("wide_table", F.size(stats["columns"]).cast("string"))),
        F.when(F.size(failed) > 0, _advice("errors", F.array_join(F.transform(failed, lambda c: c["check_name"]), ", "))),
        F.when(rate < LOW_PASS_RATE, _advice("low_pass_rate", shown)),
        F.when((rate >= LOW_PASS_RATE) & (rate < FAIR_PASS_RATE), _advice("fair_pass_rate", shown)),
    )
    empty = F.array().cast("array<struct<rule_id:string,title:string,description:string,priority:string>>")
    every = F.filter(F.concat(before, F.coalesce(per_column, empty), after), lambda a: a.isNotNull())
    # stable by priority: all High in order, then Medium, then Low
    def of(level: str):
        return lambda a: a["priority"] == level

    return F.concat(*[F.filter(every, of(level)) for level in PRIORITIES])


def assessment(checks: DataFrame) -> DataFrame:
    """One row per table: its check rows in order, counts and recommendations."""
    row = F.struct(
        "position", "check_name", "status", passed().alias("passed"), "error", "total_rows", "total_columns", "metric_value", "columns"
    )
    whole = checks.groupBy("dataset_id", "connector").agg(F.sort_array(F.collect_list(row)).alias("checks"))
    found = F.col("checks")

    def count(test):
        return F.size(F.filter(found, test)).cast("bigint")

    known = lambda c: c["status"].isin("success", "failure")
    return whole.select(
        "dataset_id", "connector", "checks",
        F.size(found).cast("bigint").alias("total_checks"),
        count(lambda c: c["passed"]).alias("passed_checks"),
        count(lambda c: ~c["passed"] & known(c)).alias("failed_checks"),
        count(lambda c: ~known(c)).alias("error_checks"),
        advice(found).alias("recommendations"),
    )


def recommendations(checks: DataFrame) -> DataFrame:
    """(dataset_id, position, rule_id, title, description, priority), most urgent first."""
    return assessment(checks).select("dataset_id", F.posexplode("recommendations").alias("at", "r")).select(
        "dataset_id", (F.col("at") + 1).cast("bigint").alias("position"), "r.rule_id", "r.title", "r.description", "r.priority"
    )
