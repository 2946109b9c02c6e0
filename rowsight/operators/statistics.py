"""Descriptive statistics per column.

Numeric columns: count, mean, std, min, quartiles, max. Timestamps: the same
without std. All others, and every ``*_id`` column: count, unique, top, freq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import quoted, run, text
from .nulls import PLACEHOLDERS, missing_sql
from .quantiles import column_quantiles

ID_SUFFIX = "_id"
QUARTILES = (0.25, 0.5, 0.75)
QUARTILE_NAMES = ("p25", "p50", "p75")
NUMERIC, CATEGORICAL, TEMPORAL, NESTED = "numeric", "categorical", "temporal", "nested"


def type_class(field: T.StructField, decimal_as: str = NUMERIC, id_suffix: str = ID_SUFFIX) -> str:
    dtype = field.dataType
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return NESTED
    if id_suffix and field.name.lower().endswith(id_suffix):
        return CATEGORICAL
    if isinstance(dtype, T.DecimalType):
        return decimal_as
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    return CATEGORICAL


def classes(df: DataFrame, decimal_as: str = NUMERIC, id_suffix: str = ID_SUFFIX) -> list[str]:
    return [type_class(f, decimal_as, id_suffix) for f in df.schema.fields]


def _filled(field: T.StructField) -> str:
    """The column with NaN as null."""
    c = quoted(field.name)
    return f"nullif({c}, CAST('NaN' AS {field.dataType.simpleString()}))" if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else c


def as_number(field: T.StructField) -> str:
    """Numeric and temporal columns as double; times as microseconds."""
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return f"CAST(unix_micros(CAST({quoted(field.name)} AS TIMESTAMP)) AS DOUBLE)"
    return f"CAST({_filled(field)} AS DOUBLE)"


def as_label(field: T.StructField) -> str:
    if isinstance(field.dataType, T.BinaryType):
        return f"hex({quoted(field.name)})"
    if isinstance(field.dataType, T.BooleanType):
        return f"initcap(CAST({quoted(field.name)} AS STRING))"
    return f"CAST({_filled(field)} AS STRING)"


def _long(df: DataFrame, wanted: list[int], make) -> DataFrame:
    """(ordinal, v) rows of the wanted columns; nulls dropped."""
    cells = ", ".join(f"named_struct('ordinal', {i}, 'v', {make(df.schema.fields[i])})" for i in wanted) or "named_struct('ordinal', -1, 'v', CAST(NULL AS DOUBLE))"
    return run(f"SELECT * FROM (SELECT inline(array({cells})) FROM @df@) WHERE v IS NOT NULL", df=df)


def numbers_long(df: DataFrame, wanted: list[int]) -> DataFrame:
    return _long(df, wanted, as_number)


#: characters of a value that are shuffled to find the smallest of equally frequent values
PREFIX = 64


def mode_and_distinct(df: DataFrame, wanted: list[int]) -> DataFrame:
    """(ordinal, unique, top, freq): exact. Equal counts take the smallest value.

    Values are counted by a 128-bit digest and shuffled with their first characters
    only; where the winner is longer, a second pass counts the values that start like
    it. It reads nothing where no winner is long.
    """
    heads = ", ".join(
        f"named_struct('ordinal', {i}, 'head', substr({v}, 1, {PREFIX}), 'a', xxhash64({v}), 'b', xxhash64(1, {v}))"
        for i, v in ((i, as_label(df.schema.fields[i])) for i in wanted)
    )
    counted = run(
        f"""
        SELECT ordinal, count(1) AS `unique`, max(n) AS freq, min_by(head, struct(-n, head)) AS head FROM (
          SELECT ordinal, head, a, b, count(1) AS n FROM (SELECT inline(array({heads})) FROM @df@) WHERE head IS NOT NULL GROUP BY ordinal, head, a, b)
        GROUP BY ordinal
        """,
        df=df,
    )
    # one row per column at most
    whole = run(
        f"""
        SELECT ordinal, min_by(v, struct(-n, v)) AS v FROM (
          SELECT /*+ BROADCAST(w) */ c.ordinal, c.v, count(1) AS n FROM @cells@ c
          JOIN (SELECT ordinal, head FROM @counted@ WHERE char_length(head) = {PREFIX}) w ON c.ordinal = w.ordinal AND substr(c.v, 1, {PREFIX}) = w.head
          GROUP BY c.ordinal, c.v)
        GROUP BY ordinal
        """,
        cells=_long(df, wanted, as_label), counted=counted,
    )
    return run(
        "SELECT /*+ BROADCAST(w) */ c.ordinal, `unique`, coalesce(w.v, head) AS top, freq FROM @counted@ c LEFT JOIN @whole@ w ON c.ordinal = w.ordinal",
        counted=counted, whole=whole,
    )


def quick_distinct(df: DataFrame, wanted: list[int]) -> DataFrame:
    """(ordinal, unique) by sketch: no shuffle of values."""
    found = ", ".join(f"approx_count_distinct({as_label(df.schema.fields[i])}) AS u{i}" for i in wanted)
    rows = ", ".join(f"named_struct('ordinal', {i}, 'unique', u{i})" for i in wanted)
    return run(f"SELECT inline(array({rows})) FROM (SELECT {found} FROM @df@)", df=df)


def moments(df: DataFrame, kinds: list[str], placeholders=PLACEHOLDERS, sketch: bool = False) -> DataFrame:
    """One row per column from one scan: counts, missing values, mean, std,
    min, max; with ``sketch`` also approximate quartiles."""
    aggs, rows = ["count(1) AS total_rows"], []
    probs = f"array({', '.join(f'{p!r}D' for p in QUARTILES)})"
    for i, (f, kind) in enumerate(zip(df.schema.fields, kinds)):
        aggs.append(f"count({_filled(f)}) AS n{i}")
        stat = {"null_count": f"total_rows - n{i}"}
        if isinstance(f.dataType, T.StringType) and placeholders:
            aggs.append(f"count_if({missing_sql(f, placeholders)}) AS miss{i}")
            stat["null_count"] = f"miss{i}"
        stat |= {"count": f"n{i}", **dict.fromkeys(("mean", "std", "min", "max", *QUARTILE_NAMES), "CAST(NULL AS DOUBLE)")}
        if kind in (NUMERIC, TEMPORAL):
            x = as_number(f)
            made = {"mean": "avg", "min": "min", "max": "max"} | ({"std": "stddev_samp"} if kind == NUMERIC else {})
            for name, function in made.items():
                aggs.append(f"{function}({x}) AS {name}{i}")
                stat[name] = f"{name}{i}"
            if sketch:
                aggs.append(f"percentile_approx({x}, {probs}, 10000) AS q{i}")
                stat |= {q: f"q{i}[{j}]" for j, q in enumerate(QUARTILE_NAMES)}
        cells = ", ".join(f"'{k}', {v}" for k, v in stat.items())
        rows.append(f"named_struct('ordinal', {i}, 'column_name', {text(f.name)}, 'type_class', '{kind}', {cells})")
    return run(f"SELECT total_rows, inline(array({', '.join(rows)})) FROM (SELECT {', '.join(aggs)} FROM @df@)", df=df)


PROFILE = {
    "total_rows": "bigint", "column_name": "string", "type_class": "string", "null_count": "bigint", "count": "bigint",
    "unique": "bigint", "top": "string", "freq": "bigint",
    "mean": "double", "std": "double", "min": "double", "p25": "double", "p50": "double", "p75": "double", "max": "double",
}


def merged(parts: list[DataFrame]) -> DataFrame:
    """One row per column from partial rows; each field comes from one part."""
    selects = []
    for i, part in enumerate(parts):
        have = set(part.columns)
        cells = ", ".join(f"CAST({quoted(k) if k in have else 'NULL'} AS {t}) AS {quoted(k)}" for k, t in PROFILE.items())
        selects.append(f"SELECT ordinal, {cells} FROM @part{i}@")
    nan = "CAST('NaN' AS DOUBLE)"  # infinities may leave NaN behind: no value
    fields = ", ".join(
        (f"nullif(max({quoted(k)}), {nan})" if t == "double" else f"max({quoted(k)})") + f" AS {quoted(k)}" for k, t in PROFILE.items()
    )
    return run(
        f"SELECT ordinal, {fields} FROM ({' UNION ALL '.join(selects)}) GROUP BY ordinal",
        **{f"part{i}": part for i, part in enumerate(parts)},
    )


def profile(
    df: DataFrame,
    placeholders=PLACEHOLDERS,
    decimal_as: str = NUMERIC,
    id_suffix: str = ID_SUFFIX,
    approximate: bool = False,
    only: tuple[str, ...] = (NUMERIC, CATEGORICAL, TEMPORAL, NESTED),
) -> DataFrame:
    """All statistics of all columns, one row per column; times in microseconds.

    Quartiles are exact: brackets from sketches, then one counting pass. ``approximate`` takes quartiles and distinct counts from
    sketches, in the scan of the other statistics, and leaves the mode out.
    """
    if not df.columns:
        raise ValueError("cannot describe a table without columns")
    kinds = classes(df, decimal_as, id_suffix)
    keep = [i for i, k in enumerate(kinds) if k in only]
    numbers = [i for i in keep if kinds[i] in (NUMERIC, TEMPORAL)]
    labels = [i for i in keep if kinds[i] == CATEGORICAL]
    scanned = [k if i in keep else NESTED for i, k in enumerate(kinds)]
    parts = [moments(df, scanned, placeholders, approximate)]
    if numbers and not approximate:
        parts.append(column_quantiles(df, {i: as_number(df.schema.fields[i]) for i in numbers}, QUARTILES, QUARTILE_NAMES))
    if labels:
        parts.append((quick_distinct if approximate else mode_and_distinct)(df, labels))
    chosen = ", ".join(str(i) for i in keep) or "NULL"
    return run(
        f"""
        SELECT * EXCEPT (`unique`), CASE WHEN type_class = '{CATEGORICAL}' THEN coalesce(`unique`, 0) END AS `unique`
        FROM @all@ WHERE ordinal IN ({chosen})
        """,
        all=merged(parts),
    )


def as_time(micros: Column) -> Column:
    return F.timestamp_micros(F.floor(micros).cast("bigint")).cast("timestamp_ntz")


def micros_as_time(x: str) -> str:
    return f"CAST(timestamp_micros(CAST(floor({x}) AS BIGINT)) AS TIMESTAMP_NTZ)"


def column_profile(df: DataFrame, dataset_id: str, **options) -> DataFrame:
    """Profile of every column; temporal columns fill the ``ts_`` fields."""
    time = f"type_class = '{TEMPORAL}'"
    numbers = ", ".join(f"CASE WHEN NOT {time} THEN {s} END AS {s}" for s in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    times = ", ".join(f"CASE WHEN {time} THEN {micros_as_time(s)} END AS ts_{s}" for s in ("mean", "min", "p25", "p50", "p75", "max"))
    return run(
        f"""
        SELECT {text(dataset_id)} AS dataset_id, column_name, ordinal, type_class, `count`, `unique`, top, freq, {numbers}, {times}
        FROM @found@
        """,
        found=profile(df, **options),
    )


def numeric_profile(df: DataFrame, dataset_id: str, **options) -> DataFrame:
    return column_profile(df, dataset_id, only=(NUMERIC,), **options).select(
        "dataset_id", "column_name", "ordinal", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def categorical_profile(df: DataFrame, dataset_id: str, **options) -> DataFrame:
    return column_profile(df, dataset_id, only=(CATEGORICAL,), **options).select(
        "dataset_id", "column_name", "ordinal", "count", "unique", "top", "freq"
    )


def temporal_profile(df: DataFrame, dataset_id: str, **options) -> DataFrame:
    return column_profile(df, dataset_id, only=(TEMPORAL,), **options).select(
        "dataset_id", "column_name", "ordinal", "count", *[f"ts_{s}" for s in ("mean", "min", "p25", "p50", "p75", "max")]
    )


def quick_profile(df: DataFrame, dataset_id: str) -> DataFrame:
    """Snapshot for generated data: table totals, plain nulls, and mean, median,
    min, max, std of the 64-bit numeric columns."""
    from .duplicates import duplicate_counts

    fields = df.schema.fields
    kinds = [NUMERIC if isinstance(f.dataType, (T.LongType, T.DoubleType)) else NESTED for f in fields]
    numbers = [i for i, k in enumerate(kinds) if k == NUMERIC]
    parts = [moments(df, kinds, ())]
    if numbers:
        parts.append(column_quantiles(df, {i: as_number(fields[i]) for i in numbers}, (0.5,), ("p50",)))
    return run(
        f"""
        SELECT {text(dataset_id)} AS dataset_id, column_name, ordinal, total_rows, CAST({len(fields)} AS BIGINT) AS total_columns,
          duplicate_count, CASE WHEN total_rows > 0 THEN duplicate_count / total_rows END AS duplicate_rate,
          null_count, CASE WHEN total_rows > 0 THEN null_count / total_rows END AS null_rate, mean, p50 AS median, min, max, std
        FROM (SELECT *, (SELECT duplicate_qty FROM @copies@) AS duplicate_count FROM @all@)
        """,
        all=merged(parts), copies=duplicate_counts(df),
    )
