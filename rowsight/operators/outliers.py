"""Outlier counts and type consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import col, run, text
from .statistics import NUMERIC, classes, numbers_long, profile


def outlier_check(df: DataFrame, dataset_id: str, fence: float = 1.5, z: float = 3.0, **options) -> DataFrame:
    """Per numeric column: values beyond the quartile fences and beyond ``z`` deviations."""
    chosen = {k: v for k, v in options.items() if k in ("decimal_as", "id_suffix")}
    numbers = [i for i, k in enumerate(classes(df, **chosen)) if k == NUMERIC]
    limits = run(
        f"""
        SELECT ordinal, column_name, `count`, mean, std,
               p25 - {float(fence)!r}D * (p75 - p25) AS lower_fence, p75 + {float(fence)!r}D * (p75 - p25) AS upper_fence
        FROM @stats@
        """,
        stats=profile(df, only=(NUMERIC,), **options),
    )
    return run(
        f"""
        SELECT /*+ BROADCAST(limits) */ {text(dataset_id)} AS dataset_id, column_name, limits.ordinal, `count`, lower_fence, upper_fence,
          count_if(v < lower_fence OR v > upper_fence) AS iqr_outliers, count_if(abs(v - mean) > {float(z)!r}D * std) AS z_outliers
        FROM @cells@ cells JOIN @limits@ limits ON cells.ordinal = limits.ordinal -- limits: one row per column
        GROUP BY limits.ordinal, column_name, `count`, lower_fence, upper_fence
        """,
        limits=limits, cells=numbers_long(df, numbers),
    )


# fixed values: spellings that count as a value of each type
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"


def type_check(df: DataFrame, dataset_id: str) -> DataFrame:
    """Per string column: how many filled cells read as integer, number, date or
    timestamp, and the narrowest type that all of them fit."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    tests: dict[str, callable] = {
        "integer_count": lambda c: c.rlike(INTEGER) & c.try_cast("bigint").isNotNull(),
        "number_count": lambda c: c.rlike(NUMBER),
        "date_count": lambda c: c.rlike(DATE) & c.try_cast("date").isNotNull(),
        "timestamp_count": lambda c: c.rlike(TIMESTAMP) & c.try_cast("timestamp_ntz").isNotNull(),
    }
    aggs: list[Column] = []
    for i, name in enumerate(names):
        aggs.append(F.count(col(name)).alias(f"n{i}"))
        aggs += [F.count_if(F.coalesce(test(col(name)), F.lit(False))).alias(f"{k}{i}") for k, test in tests.items()]
    if not names:
        aggs = [F.count(F.lit(1)).alias("rows")]
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(df.columns.index(name)).alias("ordinal"),
            F.col(f"n{i}").alias("count"),
            *[F.col(f"{k}{i}").alias(k) for k in tests],
        )
        for i, name in enumerate(names)
    ]
    shape = "array<struct<column_name:string,ordinal:int,count:bigint,integer_count:bigint,number_count:bigint,date_count:bigint,timestamp_count:bigint>>"
    rows = df.agg(*aggs).select(F.inline(F.array(*entries).cast(shape) if entries else F.from_json(F.lit("[]"), shape)))
    n = F.col("count")
    full = F.when(n == 0, "empty")
    for k, t in (("integer_count", "bigint"), ("number_count", "double"), ("date_count", "date"), ("timestamp_count", "timestamp")):
        full = full.when(F.col(k) == n, t)
    best = F.greatest("number_count", "date_count", "timestamp_count")
    return rows.select(
        F.lit(dataset_id).alias("dataset_id"), "column_name", "ordinal", "count", *tests,
        full.otherwise("string").alias("fits_type"),
        ((best > 0) & (best < n)).alias("mixed"),
    )
