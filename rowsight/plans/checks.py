"""Checks beyond the three of every assessment, by name.

A check is a function from a table to one row of findings. Registered ones are asked for by
name like the others (``assess(df, name, checks=[..., "outliers"])``); their rows go
through summaries, results and reports with the rest. ``register`` adds one:

    register(Check("positive_totals", lambda df: df.agg(
        F.count("*").alias("total_rows"), F.count_if("total <= 0").alias("metric_value"))))
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.outliers import outlier_check, type_check


@dataclass(frozen=True)
class Check:
    """``rows`` gives one row of total_rows and metric_value (findings; 0 is success), and may
    give status and columns: an array of structs with any of the fields of a finding."""

    name: str
    rows: Callable[[DataFrame], DataFrame]


REGISTERED: dict[str, Check] = {}


def register(check: Check) -> Check:
    """Make a check known under its name; a later one of the same name takes its place."""
    if not check.name or "," in check.name:
        raise ValueError(f"a check needs a name without commas: {check.name!r}")
    REGISTERED[check.name] = check
    return check


def _counted(df: DataFrame, found: DataFrame) -> DataFrame:
    """Findings, one row per column, with the table's number of rows."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return total.crossJoin(found)  # one row each


def outliers(df: DataFrame) -> DataFrame:
    """Numeric columns with values beyond the quartile fences.

    A column's finding: count of values, freq of outliers, the fences as min and max.
    """
    per = outlier_check(df, "")
    entry = F.struct(
        "ordinal", "column_name", F.lit("numeric").alias("type_class"), "count",
        F.col("iqr_outliers").alias("freq"), F.col("lower_fence").alias("min"), F.col("upper_fence").alias("max"),
    )
    return _counted(df, per.agg(F.count_if(F.col("iqr_outliers") > 0).alias("metric_value"), F.sort_array(F.collect_list(entry)).alias("columns")))


def types(df: DataFrame) -> DataFrame:
    """Text columns whose values are partly numbers, dates or times.

    A column's finding: count of values, freq of those of its most frequent type, and as
    type_class the type that all of them fit.
    """
    per = type_check(df, "")
    best = F.greatest("number_count", "date_count", "timestamp_count")
    entry = F.struct("ordinal", "column_name", F.col("fits_type").alias("type_class"), "count", best.alias("freq"))
    return _counted(df, per.agg(F.count_if("mixed").alias("metric_value"), F.sort_array(F.collect_list(entry)).alias("columns")))


register(Check("outliers", outliers))
register(Check("types", types))
