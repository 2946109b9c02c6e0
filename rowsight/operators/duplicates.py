"""Duplicate rows: counts, percentages, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import col, has_type, percent, plain_float


#: timestamps inside nested values, to the microsecond
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def key_columns(df: DataFrame, subset=None, exclude=()) -> list[str]:
    return [c for c in (subset or df.columns) if c not in set(exclude)]


def groupable(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns in a form that can be grouped: null equals null, NaN equals null
    as in a float column, maps compare by their entries."""
    out = []
    for name in names:
        dtype, c = df.schema[name].dataType, col(name)
        if isinstance(dtype, T.MapType) and not has_type(dtype.valueType, (T.MapType, T.VariantType)):
            c = F.array_sort(F.map_entries(c))
        elif has_type(dtype, (T.MapType, T.VariantType)):
            c = F.to_json(c)
        else:
            c = plain_float(c, dtype)
        out.append(c.alias(name))
    return out


def row_groups(df: DataFrame, subset=None, exclude=()) -> DataFrame:
    """One row per distinct row and the number of its copies (``copies``).
    Copies fold before the shuffle, so a hot row costs one record per task."""
    names = key_columns(df, subset, exclude)
    keys = df.select(groupable(df, names))
    return keys.groupBy([col(n) for n in names]).agg(F.count(F.lit(1)).alias("copies"))


def row_digest(df: DataFrame, names: list[str]) -> list[Column]:
    """128-bit digest of a row as two numbers: two differently started hashes of its
    typed values and of which are null (a hash passes nulls over)."""
    parts = []
    for name, c in zip(names, groupable(df, names)):
        dtype = df.schema[name].dataType
        if has_type(dtype, (T.VariantType,)) and not isinstance(dtype, T.VariantType):
            c = F.to_json(F.struct(c.alias("v")), {"timestampFormat": MICROS, "timestampNTZFormat": MICROS, "ignoreNullFields": "false"})
        elif isinstance(dtype, T.VariantType):
            c = c.cast("string")
        elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(F.struct(_instants(c, dtype).alias("v")), {"timestampNTZFormat": MICROS, "ignoreNullFields": "false"})
        parts.append(c)
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in parts])
    return [F.xxhash64(nulls, *parts).alias("a"), F.xxhash64(F.lit(1), nulls, *parts).alias("b")]


def _instants(c: Column, dtype: T.DataType) -> Column:
    """A nested value with its timestamps as microseconds: text of an instant repeats where clocks go back."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if not has_type(dtype, (T.TimestampType,)):
        return c
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _instants(x, dtype.elementType))
    if isinstance(dtype, T.MapType):  # grouped as its sorted entries
        return F.transform(c, lambda x: F.struct(_instants(x["key"], dtype.keyType).alias("key"), _instants(x["value"], dtype.valueType).alias("value")))
    return F.when(c.isNotNull(), F.struct(*[_instants(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]))


def _collated(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return dtype.collation not in (None, "UTF8_BINARY")
    if isinstance(dtype, T.ArrayType):
        return _collated(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _collated(dtype.keyType) or _collated(dtype.valueType)
    return isinstance(dtype, T.StructType) and any(_collated(f.dataType) for f in dtype.fields)


def duplicate_counts(df: DataFrame, subset=None, exclude=()) -> DataFrame:
    """One row (total_rows, duplicate_qty); surplus copies, not group members.

    Counts per 128-bit digest of a row: a row costs 16 bytes of the shuffle whatever
    its width, and a hot row one record per task. Where a collation makes texts equal
    that are spelt differently, rows are grouped by their values instead.
    """
    names = key_columns(df, subset, exclude)
    if not names:
        return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
            "total_rows", F.greatest(F.col("total_rows") - 1, F.lit(0)).alias("duplicate_qty")
        )
    if any(_collated(df.schema[n].dataType) for n in names):
        groups = row_groups(df, subset, exclude).select("copies")
    else:
        groups = df.select(row_digest(df, names)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_qty"),
    )


def check_duplicates(df: DataFrame, dataset_id: str, subset=None, exclude=()) -> DataFrame:
    counts = duplicate_counts(df, subset, exclude)
    qty, total = F.col("duplicate_qty"), F.col("total_rows")
    return counts.select(
        F.lit(dataset_id).alias("dataset_id"),
        total,
        qty,
        F.coalesce(percent(qty, total), F.lit(0.0)).alias("duplicate_percentage"),
        F.when(qty == 0, "success").otherwise("failure").alias("status"),
    )


def duplicate_examples(df: DataFrame, limit: int = 3, subset=None, exclude=()) -> DataFrame:
    """The most repeated rows; equal counts in column order."""
    groups = row_groups(df, subset, exclude)
    order = [F.col("copies").desc()] + [col(c).asc_nulls_first() for c in groups.columns[:-1]]
    return groups.where("copies > 1").orderBy(*order).limit(limit)
