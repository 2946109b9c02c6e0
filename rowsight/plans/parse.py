"""Check rows read back from report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .assess import FINDING, FINDING_FIELDS
from .report import REPORT_JSON, STAT_NAMES, checks_of

# fixed values: how findings are spelled in report texts
TOTAL_ROWS = r"(?i)Total Rows.*?(\d+(?:,\d+)*)"
DUPLICATES = r"(?i)Duplicate Records.*?(\d+(?:,\d+)*)\s*\(([0-9.]+)%"
DUPLICATES_FAILED = r"(?i)### [❌✅] Duplicates[\s\S]*?- \*\*Status\*\*: ERROR"
MISSING = r"(?i)Columns with Missing Data.*?(\d+)\s*out of\s*(\d+)\s*columns"
MISSING_COLUMN = r"`([^`]+)`:\s*([0-9,]+)\s*nulls?\s*\(([0-9.]+)%\)"
ANALYZED = r"(?i)Columns Analyzed.*?(\d+)\s*columns"
STAT_ROW = r"\|\s*`([^`]+)`\s*" + r"\|\s*((?:[^|\\\n]|\\.)*)" * 11 + r"\|"
STAT_TABLE = "Statistical Summary"
EMBEDDED_JSON = r"(\{[\s\S]*\"assessment_results\"[\s\S]*\})"


def _number(c: Column) -> Column:
    return F.translate(F.trim(c), ",", "").try_cast("double")


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _every(text: Column, pattern: str, groups: int) -> Column:
    """Array of structs g1..gn, one per match."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, groups + 1)])


def _finding(**known) -> Column:
    return F.struct(*[known.get(n, F.lit(None)).alias(n) for n in FINDING_FIELDS]).cast(FINDING)


def _stat(text: Column) -> Column:
    # marks keep an escaped backslash apart from what follows it
    shown = F.replace(F.trim(text), F.lit("\\\\"), F.lit("\x00"))
    for escape, plain in (("\\|", "|"), ("\\n", "\n"), ("\\r", "\r"), ("\x00", "\\")):
        shown = F.replace(shown, F.lit(escape), F.lit(plain))
    return F.when(~shown.isin("-", ""), shown)


def _from_markdown(text: Column) -> Column:
    """Array of check rows found in a Markdown report."""
    rows, dup = _number(_group(text, TOTAL_ROWS, 1)), _number(_group(text, DUPLICATES, 1))
    found_dup = rows.isNotNull() & dup.isNotNull()
    bad, width = _number(_group(text, MISSING, 1)), _number(_group(text, MISSING, 2))
    analyzed = _number(_group(text, ANALYZED, 1))

    nulls = F.transform(_every(text, MISSING_COLUMN, 3), lambda m, i: _finding(
        ordinal=i, column_name=m["g1"], null_count=_number(m["g2"]), null_percentage=m["g3"].try_cast("double")))

    def stat(m: Column, i: Column) -> Column:
        shown = {n: m[f"g{k + 2}"] for k, n in enumerate(STAT_NAMES)}
        label = _stat(shown["unique"]).isNotNull()
        time = _stat(shown["mean"]).isNotNull() & _number(shown["mean"]).isNull()
        values = {n: (_stat(t) if n == "top" else _number(t)) for n, t in shown.items()}
        kind = F.when(label, "categorical").when(time, "temporal").otherwise("numeric")
        return _finding(ordinal=i, column_name=F.trim(m["g1"]), type_class=kind, **values)

    table = F.when(text.contains(STAT_TABLE), F.transform(_every(text, STAT_ROW, 12), stat))
    none = F.array().cast(f"array<{FINDING}>")

    def row(name, when, status, error, total, columns_n, metric, columns):
        return F.when(when, F.struct(
            F.lit(name).alias("check_name"), status.cast("string").alias("status"), error.cast("string").alias("error"),
            total.cast("bigint").alias("total_rows"), columns_n.cast("bigint").alias("total_columns"),
            metric.cast("bigint").alias("metric_value"), F.coalesce(columns, none).alias("columns"),
        ))

    null = F.lit(None)
    failed = ~found_dup & text.rlike(DUPLICATES_FAILED)
    found = F.array(
        row("duplicates", found_dup, F.when(dup == 0, "success").otherwise("failure"), null, rows, null, dup, none),
        row("duplicates", failed, F.lit("error"), F.lit("reported error, needs a fresh run"), null, null, null, none),
        # rows come from the duplicate section, 0 without one
        row("null_values", bad.isNotNull(), F.lit("success"), null, F.when(found_dup, rows).otherwise(0), width, bad, nulls),
        row("descriptive_stats", analyzed.isNotNull() | F.lower(text).contains("descriptive"), F.lit("success"), null, null,
            null, F.coalesce(analyzed, F.size(F.coalesce(table, none))), table),
    )
    return F.filter(found, lambda r: r.isNotNull())


def parse_reports(texts: DataFrame, column: str = "document", keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Check rows of report texts: embedded JSON results first, Markdown otherwise.

    (keys, check_name, status, error, total_rows, total_columns, metric_value,
    columns). Duplicates count as success only at zero; a report that shows the
    duplicate check as failed yields ``error``.
    """
    embedded = F.nullif(F.regexp_extract(F.col(column), EMBEDDED_JSON, 1), F.lit(""))
    parsed = F.from_json(F.get_json_object(embedded, "$.assessment_results"), REPORT_JSON)
    from_json = F.when(F.size(parsed["check_results"]) > 0, checks_of(parsed))
    return texts.select(*keys, F.inline(F.coalesce(from_json, _from_markdown(F.col(column)))))
