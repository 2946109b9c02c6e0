"""Assessment: chosen checks over one or many tables, as rows.

A check row carries its per-column findings as an array, one entry per column
of the table. Everything after the checks (summary, recommendations, reports)
works on these rows and never reads the table again.
"""

from __future__ import annotations

import hashlib
import logging
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.identifiers import CHECKS, default_connector
from ..functions.scalars import run, text, union_all
from ..operators.duplicates import duplicate_counts
from ..operators.nulls import PLACEHOLDERS
from ..operators.statistics import NESTED, merged, moments, profile
from ..sources.tables import try_scan
from .checks import REGISTERED

log = logging.getLogger(__name__)

FINDING = (
    "struct<ordinal:int,column_name:string,type_class:string,null_count:bigint,null_percentage:double,count:bigint,"
    "unique:bigint,top:string,freq:bigint,mean:double,std:double,min:double,p25:double,p50:double,p75:double,max:double>"
)
FINDING_FIELDS = [part.split(":")[0] for part in FINDING[len("struct<"):-1].split(",")]
CHECK_ROW = (
    "dataset_id string, connector string, position int, check_name string, status string, error string, "
    f"total_rows bigint, total_columns bigint, metric_value bigint, columns array<{FINDING}>"
)


def chosen_checks(checks=None) -> list[str]:
    """List or comma-separated names, registered checks too; the three basic ones by default; unknown ones are skipped."""
    if checks is None:
        return list(CHECKS)
    names = [c.strip() for c in checks.split(",")] if isinstance(checks, str) else list(checks)
    for c in names:
        if c not in CHECKS and c not in REGISTERED:
            log.warning("unknown check %r skipped", c)
    return list(dict.fromkeys(c for c in names if c in CHECKS or c in REGISTERED))


def _row(dataset_id, connector, order, name, status, width, metric, columns, error=None, rows="total_rows") -> str:
    """One check row as a struct in SQL."""
    cells = {
        "dataset_id": text(dataset_id), "connector": text(connector), "position": str(order.index(name) + 1), "check_name": text(name),
        "status": status, "error": text(error), "total_rows": rows, "total_columns": f"CAST({width} AS BIGINT)",
        "metric_value": f"CAST({metric} AS BIGINT)", "columns": columns,
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in cells.items()) + ")"


def error_rows(spark: SparkSession, dataset_id: str, connector: str | None, checks, reason: str, status: str = "error") -> DataFrame:
    order = chosen_checks(checks)
    rows = [(dataset_id, connector, i + 1, c, status, reason, None, None, None, []) for i, c in enumerate(order)]
    return spark.createDataFrame(rows, CHECK_ROW)


# columns with missing values, worst first, ties in column order
WORST_FIRST = """array_sort(filter(columns, c -> c.null_count > 0), (a, b) -> CASE
  WHEN a.null_percentage > b.null_percentage THEN -1 WHEN a.null_percentage < b.null_percentage THEN 1 ELSE a.ordinal - b.ordinal END)"""
SHARE = "CASE WHEN total_rows > 0 THEN ((null_count * 20000 + total_rows) div (total_rows * 2)) / 100.0D END"


def assess(
    df: DataFrame, dataset_id: str, connector: str | None = "postgres", checks=None, placeholders=PLACEHOLDERS, **options,
) -> DataFrame:
    """Check rows of one table. Nulls and statistics share their scan."""
    order, width = chosen_checks(checks), len(df.columns)
    spark, parts = df.sparkSession, []
    if not order:
        return spark.createDataFrame([], CHECK_ROW)
    none = f"CAST(array() AS array<{FINDING}>)"
    if "duplicates" in order:
        row = _row(dataset_id, connector, order, "duplicates", "if(duplicate_qty = 0, 'success', 'failure')", width, "duplicate_qty", none)
        parts.append(run(f"SELECT inline(array({row})) FROM @found@", found=duplicate_counts(df)))
    scanned = [c for c in order if c in CHECKS and c != "duplicates"]
    if scanned and not width:
        rows = []
        for name in scanned:
            status, why = ("'success'", None) if name == "null_values" else ("'failure'", "cannot describe a table without columns")
            rows.append(_row(dataset_id, connector, order, name, status, 0, 0, none, why))
        parts.append(run(f"SELECT inline(array({', '.join(rows)})) FROM (SELECT count(1) AS total_rows FROM @df@)", df=df))
    elif scanned:
        if "descriptive_stats" in order:
            found = profile(df, placeholders=placeholders, **options)
        else:
            found = merged([moments(df, [NESTED] * width, placeholders)])
        cells = ", ".join(
            f"'{name}', " + (SHARE if name == "null_percentage" else f"`{name}`") for name in FINDING_FIELDS
        )
        rows = []
        if "null_values" in order:
            rows.append(_row(dataset_id, connector, order, "null_values", "'success'", width, "size(worst)", "worst"))
        if "descriptive_stats" in order:
            rows.append(_row(dataset_id, connector, order, "descriptive_stats", "'success'", width, "size(columns)", "columns"))
        # one array entry per column of the table
        parts.append(run(
            f"""
            SELECT inline(array({', '.join(rows)})) FROM (
              SELECT total_rows, columns, {WORST_FIRST} AS worst FROM (
                SELECT max(total_rows) AS total_rows, sort_array(collect_list(named_struct({cells}))) AS columns FROM @found@))
            """,
            found=found,
        ))
    parts += [_registered(df, dataset_id, connector, order, c) for c in order if c not in CHECKS]
    return union_all(parts)


def _registered(df: DataFrame, dataset_id: str, connector: str | None, order: list[str], name: str) -> DataFrame:
    """The row of a registered check, with the fields of the others."""
    found = REGISTERED[name].rows(df)
    status = "status" if "status" in found.columns else "if(metric_value = 0, 'success', 'failure')"
    columns = f"CAST(array() AS array<{FINDING}>)"
    if "columns" in found.columns:
        have = found.schema["columns"].dataType.elementType.fieldNames()
        cells = ", ".join(f"'{f}', " + (f"c.{f}" if f in have else "NULL") for f in FINDING_FIELDS)
        columns = f"CAST(transform(columns, c -> named_struct({cells})) AS array<{FINDING}>)"
    row = _row(dataset_id, connector, order, name, status, len(df.columns), "metric_value", columns)
    return run(f"SELECT inline(array({row})) FROM @found@", found=found)


def assess_table(spark: SparkSession, dataset_id: str, connector: str | None = None, checks=None, configured=(), jdbc=None, **options) -> DataFrame:
    """Load and assess; a table that cannot be loaded yields ``error`` rows."""
    kind = connector or default_connector(list(configured))
    df, reason = try_scan(spark, dataset_id, connector=connector if jdbc else None, jdbc=jdbc)
    if df is None:
        return error_rows(spark, dataset_id, kind, checks, reason)
    return assess(df, dataset_id, kind, checks, **options)


def assess_all(tables: dict[str, tuple[str, DataFrame]], checks=None, **options) -> DataFrame:
    """Check rows of many tables: {dataset_id: (connector, table)}."""
    return union_all([assess(df, name, kind, checks, **options) for name, (kind, df) in tables.items()])


def passed() -> Column:
    """Did this check row pass?"""
    clean = F.col("check_name").isin("duplicates", "null_values") & (F.coalesce("metric_value", F.lit(0)) > 0)
    return (F.col("status") == "success") & ~clean


def assess_into(
    path: str, tables: dict[str, tuple[str, DataFrame]], checks=None, batch: int = 10, at_once: int = 2, **options,
) -> DataFrame:
    """Check rows of any number of tables, kept as Parquet below ``path``, a folder for each batch.

    Tables are assessed ``batch`` at a time, so that planning time grows with their number
    only, and ``at_once`` batches side by side. A table whose data fails to read gets ``error`` rows;
    its batch is halved until it stands alone. Datasets that ``path`` holds already are
    finished: a rerun assesses the others only. Returns the rows at ``path``.
    """
    spark = SparkSession.active()
    rows = lambda: spark.read.schema(CHECK_ROW).option("recursiveFileLookup", True).parquet(path)
    try:
        done = {r[0] for r in rows().select("dataset_id").distinct().collect()}  # one row per dataset
    except PySparkException:  # nothing there yet
        done = set()
    names = [n for n in tables if n not in done]

    def work(chunk: list[str]) -> None:
        folder = f"{path}/{hashlib.md5(chr(0).join(chunk).encode()).hexdigest()}"
        reason = _written(assess_all({n: tables[n] for n in chunk}, checks, **options), folder)
        if reason is None:
            return
        if len(chunk) > 1:
            work(chunk[: len(chunk) // 2])
            work(chunk[len(chunk) // 2 :])
        else:
            _written(error_rows(spark, chunk[0], tables[chunk[0]][0], checks, reason), folder, strict=True)

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        list(pool.map(work, [names[start : start + batch] for start in range(0, len(names), batch)]))
    return rows() if names or done else spark.createDataFrame([], CHECK_ROW)


def _written(rows: DataFrame, folder: str, strict: bool = False) -> str | None:
    """None once written, else the reason; a failed job leaves no rows behind."""
    try:
        rows.write.mode("overwrite").parquet(folder)
    except (PySparkException, Py4JError) as e:
        if strict:
            raise
        log.warning("assessment failed: %s", e)
        return (str(e).strip().splitlines() or [type(e).__name__])[0]
    return None


def check_results(checks: DataFrame) -> DataFrame:
    return checks.select(
        "dataset_id", "connector", "check_name", "status", passed().alias("passed"), "error", "total_rows", "total_columns", "metric_value"
    )


def null_analysis(checks: DataFrame) -> DataFrame:
    return checks.where("check_name = 'null_values'").select("dataset_id", F.inline("columns")).select(
        "dataset_id", "column_name", "ordinal", "null_count", "null_percentage"
    )


def summary(checks: DataFrame) -> DataFrame:
    """Passed, failed and error counts, and the two pass rates: of all checks,
    and of those that ran (as shown text)."""
    ok, error = passed(), ~F.col("status").isin("success", "failure")
    counted = checks.groupBy("dataset_id", "connector").agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(ok).alias("passed_checks"),
        F.count_if(~ok & ~error).alias("failed_checks"),
        F.count_if(error).alias("error_checks"),
    )
    p, f = F.col("passed_checks"), F.col("failed_checks")
    return counted.select(
        "*",
        (p / F.col("total_checks")).alias("pass_rate"),
        F.concat(F.format_number(p / F.greatest(F.lit(1), p + f) * 100, 1), F.lit("%")).alias("pass_rate_text"),
    )
