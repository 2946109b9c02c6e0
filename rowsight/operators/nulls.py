"""Missing values and placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import col, percent, quoted, run, text

# fixed values: whole-cell spellings that count as missing, case-sensitive
PLACEHOLDERS = ("<NA>", "", "NULL", "null")


def is_missing(name: str, dtype: T.DataType, placeholders=PLACEHOLDERS) -> Column:
    c = col(name)
    missing = c.isNull()
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        missing = missing | F.isnan(c)
    elif isinstance(dtype, T.StringType) and placeholders:
        missing = missing | c.isin(*placeholders)
    return missing


def missing_sql(field: T.StructField, placeholders=PLACEHOLDERS) -> str:
    """``is_missing`` as SQL text."""
    c = quoted(field.name)
    test = f"{c} IS NULL"
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        test += f" OR isnan({c})"
    elif isinstance(field.dataType, T.StringType) and placeholders:
        test += f" OR {c} IN ({', '.join(text(p) for p in placeholders)})"
    return f"({test})"


def normalize_nulls(df: DataFrame, placeholders=PLACEHOLDERS) -> DataFrame:
    """Placeholders in string columns become null."""
    return df.select(
        [
            F.when(~col(f.name).isin(*placeholders), col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def missing_counts(df: DataFrame, placeholders=PLACEHOLDERS) -> DataFrame:
    """One row per column (ordinal, column_name, null_count, total_rows), one scan."""
    fields = df.schema.fields
    counts = "".join(f", count_if({missing_sql(f, placeholders)}) AS n{i}" for i, f in enumerate(fields))
    rows = ", ".join(f"named_struct('ordinal', {i}, 'column_name', {text(f.name)}, 'null_count', n{i})" for i, f in enumerate(fields))
    return run(f"SELECT total_rows, inline(array({rows})) FROM (SELECT count(1) AS total_rows{counts} FROM @df@)", df=df)


def check_nulls(df: DataFrame, dataset_id: str, placeholders=PLACEHOLDERS) -> DataFrame:
    """Columns that have missing values, worst first; ties in column order."""
    found = missing_counts(df, placeholders).where("null_count > 0")
    return found.select(
        F.lit(dataset_id).alias("dataset_id"),
        "column_name",
        "ordinal",
        "null_count",
        percent(F.col("null_count"), F.col("total_rows")).alias("null_percentage"),
    ).orderBy(F.col("null_percentage").desc(), "ordinal")


def null_summary(df: DataFrame, dataset_id: str, placeholders=PLACEHOLDERS) -> DataFrame:
    """Table totals: rows, columns, columns with missing values and their share."""
    width = len(df.columns)
    bad = F.count_if(F.col("null_count") > 0)
    return missing_counts(df, placeholders).agg(
        F.lit(dataset_id).alias("dataset_id"),
        F.max("total_rows").alias("total_rows"),
        F.lit(width).cast("bigint").alias("total_columns"),
        bad.alias("columns_with_nulls"),
        percent(bad, F.lit(width)).alias("missing_coverage"),
        F.lit("success").alias("status"),
    )


def null_rates(df: DataFrame, dataset_id: str) -> DataFrame:
    """Plain null counts and shares of every column, zero included."""
    n, total = F.col("null_count"), F.col("total_rows")
    return missing_counts(df, ()).select(
        F.lit(dataset_id).alias("dataset_id"),
        "column_name",
        "ordinal",
        "null_count",
        F.when(total > 0, n / total).alias("null_rate"),
    )


def null_patterns(df: DataFrame, dataset_id: str, placeholders=PLACEHOLDERS) -> DataFrame:
    """Which columns are missing together: one 0/1 string per combination."""
    bits = F.concat(*[is_missing(f.name, f.dataType, placeholders).cast("int").cast("string") for f in df.schema.fields])
    return (
        df.select(bits.alias("pattern"))
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            F.lit(dataset_id).alias("dataset_id"),
            "pattern",
            F.length(F.replace("pattern", F.lit("0"), F.lit(""))).cast("bigint").alias("missing_columns"),
            "row_count",
        )
    )


def completeness(df: DataFrame, dataset_id: str, placeholders=PLACEHOLDERS) -> DataFrame:
    """Share of filled cells."""
    width = len(df.columns)
    cells = F.max("total_rows") * width
    return missing_counts(df, placeholders).agg(
        F.lit(dataset_id).alias("dataset_id"),
        cells.alias("cells"),
        F.sum("null_count").alias("missing_cells"),
        F.when(cells > 0, 1 - F.sum("null_count") / cells).alias("completeness"),
    )
