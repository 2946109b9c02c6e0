"""Rule-based cleansing with attrition counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import col, has_type, percent, plain_float
from .duplicates import groupable, row_groups


@dataclass(frozen=True)
class Rule:
    """A row is kept when ``keep`` is true; null counts as false."""

    name: str
    keep: Column


def required(*names: str) -> Rule:
    keep = F.lit(True)
    for n in names:
        keep = keep & col(n).isNotNull()
    return Rule("required values", keep)


def customer_rules() -> list[Rule]:
    return [
        required("email", "customer_id"),
        Rule("valid age", F.col("age").between(18, 100)),
        Rule("income not negative", F.col("income") >= 0),
        Rule("balance in range", F.col("account_balance") <= 1_000_000),
    ]


def product_rules() -> list[Rule]:
    return [
        required("product_name", "product_id", "sku"),
        Rule("positive price", F.col("price") > 0),
        Rule("stock not negative", F.col("stock_quantity") >= 0),
        Rule("valid rating", F.col("rating").between(1.0, 5.0)),
        Rule("weight in range", F.col("weight").isNull() | (F.col("weight") <= 1000)),
    ]


def invoice_rules() -> list[Rule]:
    return [
        required("invoice_id", "customer_id", "product_id", "invoice_date"),
        Rule("positive quantity", F.col("quantity") > 0),
        Rule("positive unit price", F.col("unit_price") > 0),
        Rule("positive total", F.col("total_amount") > 0),
        Rule("valid tax rate", F.col("tax_rate").isNull() | F.col("tax_rate").between(0, 1)),
        Rule("discount not negative", F.col("discount_amount").isNull() | (F.col("discount_amount") >= 0)),
        Rule("quantity in range", F.col("quantity") <= 1000),
    ]


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null: a missing value to every rule and to the comparison of rows."""
    return df.select([plain_float(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def cleanse(df: DataFrame, rules: list[Rule], distinct: bool = True) -> DataFrame:
    """Distinct rows that pass every rule, NaN being null. Rules look at one row
    each, so they run before the shuffle of the distinct step. Rows are equal as in
    ``row_groups``: maps by their entries."""
    kept = without_nan(df)
    for rule in rules:
        kept = kept.where(rule.keep)
    if not distinct:
        return kept
    if not any(has_type(f.dataType, (T.MapType, T.VariantType)) for f in df.schema.fields):
        return kept.distinct()
    key = "__row"
    return kept.withColumn(key, F.struct(*groupable(kept, kept.columns))).dropDuplicates([key]).drop(key)


def attrition(df: DataFrame, rules: list[Rule], dataset_id: str) -> DataFrame:
    """Rows removed by each step, in order, from one pass: copies first, then
    each distinct row at the first rule it fails."""
    failed = F.lit(len(rules) + 1)
    for i in range(len(rules), 0, -1):
        failed = F.when(~F.coalesce(rules[i - 1].keep, F.lit(False)), i).otherwise(failed)
    groups = row_groups(without_nan(df))
    tally = groups.select(failed.alias("step"), "copies").groupBy("step").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("copies") - 1).alias("surplus")
    )
    totals = tally.agg(
        F.coalesce(F.sum("surplus"), F.lit(0)).alias("r0"),
        F.coalesce(F.sum(F.col("rows") + F.col("surplus")), F.lit(0)).alias("raw"),
        *[F.coalesce(F.sum(F.when(F.col("step") == i, F.col("rows"))), F.lit(0)).alias(f"r{i}") for i in range(1, len(rules) + 1)],
    )
    names = ["duplicates"] + [r.name for r in rules]
    left, steps = F.col("raw"), []
    for i, name in enumerate(names):
        before, left = left, left - F.col(f"r{i}")
        steps.append(F.struct(
            F.lit(i).alias("step"), F.lit(name).alias("rule"), before.alias("rows_before"),
            F.col(f"r{i}").alias("removed"), left.alias("rows_after"),
        ))
    return totals.select(F.lit(dataset_id).alias("dataset_id"), F.inline(F.array(*steps)))


def attrition_summary(steps: DataFrame) -> DataFrame:
    """Raw, kept, removed and removed percent per dataset."""
    raw, removed = F.max("rows_before"), F.sum("removed")
    return steps.groupBy("dataset_id").agg(
        raw.alias("raw_rows"), (raw - removed).alias("kept_rows"), removed.alias("removed_rows"),
        percent(removed, raw).alias("removed_percentage"),
    )
