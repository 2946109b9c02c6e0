"""Reports as rows and documents: Markdown, HTML, JSON, short summary.

All work on assessment rows (one per table), so a report costs no scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import fixed, grouped
from ..operators.statistics import TEMPORAL, as_time
from .assess import CHECK_ROW, FINDING, FINDING_FIELDS

STAT_NAMES = ("count", "mean", "std", "min", "p25", "p50", "p75", "max", "unique", "top", "freq")
STAT_TITLES = ("Count", "Mean", "Std", "Min", "25%", "50%", "75%", "Max", "Unique", "Top", "Freq")
JSON_NAMES = {"p25": "25%", "p50": "50%", "p75": "75%"}
WHOLE = ("count", "unique", "freq")
TEXT_WIDTH = 15


#: in this order; undone by ``parse``
CELL_ESCAPES = (("\\", "\\\\"), ("|", "\\|"), ("\n", "\\n"), ("\r", "\\r"))

def _title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def stat_text(c: Column, name: str) -> Column:
    """Shown value of a statistic: '-' for none, 1,234 / 1,234.50, long texts cut."""
    v = c[name]
    if name in WHOLE:
        shown = grouped(v)
    elif name == "top":
        shown = F.substring(v, 1, TEXT_WIDTH)
    else:
        shown = F.when(c["type_class"] == TEMPORAL, F.substring(as_time(v).cast("string"), 1, TEXT_WIDTH)).otherwise(F.format_number(v, 2))
    return F.coalesce(shown, F.lit("-"))


def format_stats(checks: DataFrame) -> DataFrame:
    """Shown statistics per column."""
    rows = checks.where("check_name = 'descriptive_stats'").select("dataset_id", F.explode("columns").alias("c"))
    return rows.select(
        "dataset_id", F.col("c.column_name").alias("column_name"), *[stat_text(F.col("c"), n).alias(n) for n in STAT_NAMES]
    )


def _lines(section: str, *lines: Column) -> Column:
    """Array of (section, line); null lines drop out."""
    made = F.array(*[F.struct(F.lit(section).alias("section"), x.alias("line")) for x in lines])
    return F.filter(made, lambda x: x["line"].isNotNull())


def _each(section: str, items: Column, make) -> Column:
    return F.transform(items, lambda x, i: F.struct(F.lit(section).alias("section"), make(x, i).alias("line")))


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _share(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, fixed(part / whole * 100, digits)).otherwise(F.lit(fixed_zero(digits)))


def fixed_zero(digits: int) -> str:
    return f"{0:.{digits}f}"


def _count(c: Column) -> Column:
    return c.cast("string")


def _check_lines(c: Column) -> Column:
    """Lines of one check struct."""
    name, qty, rows, width = c["check_name"], c["metric_value"], c["total_rows"], c["total_columns"]
    ran = (c["status"] == "success") | ((c["status"] == "failure") & (name == "duplicates"))
    verdict = F.when(c["passed"], "PASS").otherwise("FAIL")
    head = _lines("check", _say("### ", F.when(c["passed"], "✅").otherwise("❌"), " ", _title(name)), F.lit(""))
    duplicates = _lines(
        "duplicates",
        _say("- **Status**: ", verdict),
        _say("- **Total Rows**: ", grouped(rows)),
        _say("- **Duplicate Records**: ", grouped(qty), " (", _share(qty, rows, 2), "% of data)"),
        F.when(qty > 0, _say("- **Impact**: Data redundancy detected - ", grouped(qty), " rows are duplicated")).otherwise(
            "- **Quality**: Excellent - No duplicate records found"
        ),
    )
    nulls = F.concat(
        _lines(
            "null_values",
            _say("- **Status**: ", verdict),
            _say("- **Dataset Size**: ", grouped(rows), " rows × ", _count(width), " columns"),
            _say("- **Columns with Missing Data**: ", _count(qty), " out of ", _count(width), " columns"),
            F.when(qty > 0, _say("- **Missing Data Coverage**: ", _share(qty, width, 1), "% of columns affected")).otherwise(
                "- **Quality**: Excellent - No missing values detected in any column"
            ),
            F.when(qty > 0, ""),
            F.when(qty > 0, "**Detailed Null Analysis:**"),
        ),
        _each("null_values", c["columns"], lambda x, i: _say(
            "- `", x["column_name"], "`: ", grouped(x["null_count"]), " nulls (", fixed(x["null_percentage"], 1), "%)")),
    )
    some = F.size(c["columns"]) > 0
    stats = F.concat(
        _lines(
            "descriptive_stats",
            F.lit("- **Status**: PASS (Statistics Generated)"),
            _say("- **Columns Analyzed**: ", _count(F.size(c["columns"])), " columns"),
            F.when(some, ""), F.when(some, "**📊 Complete Statistical Summary:**"), F.when(some, ""),
            F.when(some, "| Column | " + " | ".join(STAT_TITLES) + " |"),
            F.when(some, "|--------|" + "|".join("-" * (len(t) + 2) for t in STAT_TITLES) + "|"),
        ),
        _each("descriptive_stats", c["columns"], lambda x, i: _say(
            "| `", x["column_name"], "` | ", F.concat_ws(" | ", *[cell(stat_text(x, n)) for n in STAT_NAMES]), " |")),
    )
    error = _lines("error", F.lit("- **Status**: ERROR"), _say("- **Error**: ", F.coalesce(c["error"], F.lit("Unknown error"))))
    body = (
        F.when(~ran, error).when(name == "duplicates", duplicates).when(name == "null_values", nulls).otherwise(stats)
    )
    return F.concat(head, body, _lines("check", F.lit("")))


def _markdown(stamp: str) -> Column:
    checks, advice = F.col("checks"), F.col("recommendations")
    some = F.size(advice) > 0
    return F.concat(
        _lines(
            "header",
            F.lit("# Data Quality Assessment Report"), F.lit(""), F.lit("## Dataset Information"),
            _say("- **Dataset**: `", F.col("dataset_id"), "`"),
            _say("- **Connector**: ", F.upper(F.coalesce("connector", F.lit("-")))),
            F.lit(f"- **Assessment Date**: {stamp}"),
            _say("- **Total Checks**: ", _count(F.col("total_checks"))), F.lit(""),
            F.lit("## Executive Summary"),
            _say("- ✅ **Passed**: ", _count(F.col("passed_checks")), " checks"),
            _say("- ❌ **Failed**: ", _count(F.col("failed_checks")), " checks"),
            _say("- 🚫 **Errors**: ", _count(F.col("error_checks")), " checks"),
            F.lit(""), F.lit("---"), F.lit(""), F.lit("## Detailed Check Results"), F.lit(""),
        ),
        F.flatten(F.transform(checks, _check_lines)),
        _lines("recommendations", F.when(some, "---"), F.when(some, ""), F.when(some, "## Recommendations"), F.when(some, "")),
        F.flatten(F.transform(advice, lambda r, i: _lines(
            "recommendations",
            _say((i + 1).cast("string"), ". **", r["title"], "**"),
            _say("   - ", r["description"]),
            _say("   - *Priority*: ", r["priority"]),
            F.lit(""),
        ))),
        _lines(
            "footer",
            F.lit("---"), F.lit(""), F.lit("## Report Generation"), F.lit(f"- **Generation Time**: {stamp}"),
            F.lit("- **Report Format**: Markdown"), F.lit(""),
            F.lit("*This report was automatically generated. Please review recommendations and take appropriate action.*"),
        ),
    )


def report_lines(assessments: DataFrame, stamp: str) -> DataFrame:
    """Markdown report, one row per line."""
    return assessments.select("dataset_id", F.posexplode(_markdown(stamp)).alias("at", "l")).select(
        "dataset_id", (F.col("at") + 1).alias("line_no"), "l.section", "l.line"
    )


def _document(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")


def cell(c: Column) -> Column:
    """Text for a cell of a Markdown table: bars, backslashes and line breaks escaped."""
    for plain, safe in CELL_ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _tag(name: str, *parts, kind: str | None = None) -> Column:
    return _say(f'<{name} class="{kind}">' if kind else f"<{name}>", *parts, f"</{name}>")


def _html_check(c: Column) -> Column:
    name, qty, rows, width = c["check_name"], c["metric_value"], c["total_rows"], c["total_columns"]
    ran = (c["status"] == "success") | ((c["status"] == "failure") & (name == "duplicates"))
    verdict = F.when(~ran, "ERROR").when(c["passed"], "PASS").otherwise("FAIL")

    def say(label, *parts):
        return _tag("p", f"<strong>{label}:</strong> ", *parts)

    found = (
        F.when(name == "duplicates", F.array(
            say("Total Rows", grouped(rows)),
            say("Duplicate Records", grouped(qty), " (", _share(qty, rows, 2), "% of data)"),
        ))
        .when(name == "null_values", F.concat(
            F.array(
                say("Dataset Size", grouped(rows), " rows × ", _count(width), " columns"),
                say("Columns with Missing Data", _count(qty), " out of ", _count(width), " columns"),
                say("Missing Data Coverage", _share(qty, width, 1), "% of columns affected"),
                F.lit("<ul>"),
            ),
            F.transform(c["columns"], lambda x: _tag(
                "li", _tag("code", _escape(x["column_name"])), ": ", grouped(x["null_count"]), " nulls (", fixed(x["null_percentage"], 1), "%)")),
            F.array(F.lit("</ul>")),
        ))
        .otherwise(F.concat(
            F.array(
                say("Columns Analyzed", _count(F.size(c["columns"])), " columns"),
                F.lit("<table><tr><th>Column</th>" + "".join(f"<th>{t}</th>" for t in STAT_TITLES) + "</tr>"),
            ),
            F.transform(c["columns"], lambda x: _tag(
                "tr", _tag("td", _tag("code", _escape(x["column_name"]))), *[_tag("td", _escape(stat_text(x, n))) for n in STAT_NAMES])),
            F.array(F.lit("</table>")),
        ))
    )
    body = F.when(ran, found).otherwise(F.array(say("Error", _escape(F.coalesce(c["error"], F.lit("Unknown error"))))))
    return F.concat(
        F.array(_tag("h3", F.when(c["passed"], "✅").otherwise("❌"), " ", _title(name)), say("Status", _tag("span", verdict, kind="badge"))), body
    )


def _html(stamp: str) -> Column:
    def fact(label, value):
        return _tag("tr", f"<td>{label}</td>", _tag("td", value))

    advice = F.col("recommendations")
    return F.array_join(
        F.concat(
            F.array(
                F.lit('<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="UTF-8"><title>Data Quality Assessment Report</title></head>\n<body>'),
                F.lit("<h1>Data Quality Assessment Report</h1>"),
                F.lit("<table>"),
                fact("Dataset", _tag("code", _escape(F.col("dataset_id")))),
                fact("Connector", F.upper(F.coalesce("connector", F.lit("-")))),
                fact("Assessment Date", F.lit(stamp)),
                fact("Total Checks", _count(F.col("total_checks"))),
                fact("Passed", _count(F.col("passed_checks"))),
                fact("Failed", _count(F.col("failed_checks"))),
                fact("Errors", _count(F.col("error_checks"))),
                F.lit("</table>\n<h2>Detailed Check Results</h2>"),
            ),
            F.flatten(F.transform("checks", _html_check)),
            F.array(F.lit("<h2>Recommendations</h2>\n<ol>")),
            F.transform(advice, lambda r: _tag("li", _tag("strong", _escape(r["title"])), " ", _escape(r["description"]), _say(" <em>Priority: ", r["priority"], "</em>"))),
            F.array(F.lit("</ol>\n</body>\n</html>")),
        ),
        "\n",
    )


def _short(c: Column) -> Column:
    name, qty = c["check_name"], c["metric_value"]
    ran = (c["status"] == "success") | ((c["status"] == "failure") & (name == "duplicates"))
    verdict = F.when(c["passed"], "PASS").otherwise("FAIL")
    detail = (
        F.when(~ran, _say("ERROR (", F.coalesce(c["error"], F.lit("Unknown error")), ")"))
        .when(name == "duplicates", _say(verdict, " (", grouped(qty), " duplicates)"))
        .when(name == "null_values", _say(verdict, " (", _count(qty), " columns with nulls)"))
        .otherwise(_say("PASS (", _count(F.size(c["columns"])), " columns analyzed)"))
    )
    return _say(F.when(c["passed"], "✅").otherwise("❌"), " ", _title(name), ": ", detail)


def _summary(top: int = 3) -> Column:
    first = F.slice("recommendations", 1, top)
    return F.array_join(
        F.concat(
            F.array(
                F.lit("📊 DATA QUALITY ASSESSMENT SUMMARY"),
                _say("Dataset: ", F.col("dataset_id"), " (", F.upper(F.coalesce("connector", F.lit("-"))), ")"), F.lit(""),
                F.lit("OVERALL RESULTS:"),
                _say("✅ Passed: ", _count(F.col("passed_checks")), " checks"),
                _say("❌ Failed: ", _count(F.col("failed_checks")), " checks"),
                _say("🚫 Errors: ", _count(F.col("error_checks")), " checks"), F.lit(""),
                F.lit("📋 CHECK DETAILS:"),
            ),
            F.transform("checks", _short),
            F.when(F.size(first) > 0, F.concat(
                F.array(F.lit(""), F.lit("TOP RECOMMENDATIONS:")),
                F.transform(first, lambda r, i: _say((i + 1).cast("string"), ". [", r["priority"], "] ", r["title"])),
            )).otherwise(F.array().cast("array<string>")),
        ),
        "\n",
    )


def report_summary(assessments: DataFrame, top: int = 3) -> DataFrame:
    """Short text per table: totals, one line per check, first recommendations."""
    return assessments.select(
        "dataset_id", "connector", "total_checks", "passed_checks", "failed_checks", "error_checks",
        _say(F.format_number(F.col("passed_checks") / F.greatest(F.lit(1), F.col("passed_checks") + F.col("failed_checks")) * 100, 1), "%").alias("pass_rate"),
        F.size("recommendations").cast("bigint").alias("recommendations_count"),
        _summary(top).alias("summary"),
    )


def _json_stats(c: Column) -> Column:
    time = c["type_class"] == TEMPORAL
    return F.struct(*[
        (c[n] if n in (*WHOLE, "top", "std") else F.when(time, as_time(c[n]).cast("string").cast("variant")).otherwise(c[n].cast("variant"))).alias(JSON_NAMES.get(n, n))
        for n in STAT_NAMES
    ])


def _json(stamp: str) -> Column:
    checks = F.col("checks")

    def one(name):
        return F.get(F.filter(checks, lambda c: c["check_name"] == name), F.lit(0))

    def result(name, *fields):
        c = one(name)
        return F.when(c.isNotNull(), F.struct(F.col("dataset_id"), c["total_rows"].alias("total_rows"), *fields, c["status"].alias("status"), c["error"].alias("error"))).alias(name)

    dup, nulls, stats = one("duplicates"), one("null_values"), one("descriptive_stats")
    body = F.struct(
        F.struct(
            "dataset_id", F.col("connector").alias("connector_type"), F.lit(stamp).alias("timestamp"),
            F.transform(checks, lambda c: c["check_name"]).alias("checks_requested"), "total_checks",
        ).alias("metadata"),
        F.struct(
            result("duplicates", dup["metric_value"].alias("duplicate_qty")),
            result(
                "null_values", nulls["total_columns"].alias("total_columns"), nulls["metric_value"].alias("columns_with_nulls"),
                F.transform(nulls["columns"], lambda c: F.struct(
                    c["column_name"].alias("column_name"), c["null_count"].alias("null_count"), c["null_percentage"].alias("null_percentage"))).alias("null_analysis"),
            ),
            result("descriptive_stats", F.map_from_entries(
                F.transform(stats["columns"], lambda c: F.struct(c["column_name"], _json_stats(c)))).alias("descriptive_stats")),
        ).alias("check_results"),
        F.struct("passed_checks", "failed_checks", "error_checks").alias("summary"),
        F.transform("recommendations", lambda r: F.struct(r["title"].alias("title"), r["description"].alias("description"), r["priority"].alias("priority"))).alias("recommendations"),
    )
    return F.to_json(body, {"ignoreNullFields": "true", "pretty": "true"})


def assessment_json(assessments: DataFrame, stamp: str) -> DataFrame:
    """(dataset_id, document): one JSON object per table."""
    return assessments.select("dataset_id", _json(stamp).alias("document"))


def documents(assessments: DataFrame, stamp: str, formats=("markdown", "html", "json")) -> DataFrame:
    """(dataset_id, format, document) for the wanted formats; ``summary`` is one
    too. All formats of a table come from the same row, so nothing runs twice."""
    made = {
        "markdown": lambda: _document(_markdown(stamp)), "html": lambda: _html(stamp), "json": lambda: _json(stamp), "summary": _summary,
    }
    wanted = [f.strip().lower() for f in (formats.split(",") if isinstance(formats, str) else formats)]
    rows = [F.struct(F.lit(f).alias("format"), made[f]().alias("document")) for f in wanted if f in made]
    if not rows:
        return assessments.sparkSession.createDataFrame([], "dataset_id string, format string, document string")
    return assessments.select("dataset_id", F.inline(F.array(*rows)))


# JSON reports as read back: numbers may come as text, so every value is text first
_STAT_JSON = "struct<" + ",".join(f"`{JSON_NAMES.get(n, n)}`:string" for n in STAT_NAMES) + ">"
_RESULT_JSON = (
    "struct<total_rows:string,duplicate_qty:string,total_columns:string,columns_with_nulls:string,status:string,error:string,"
    "null_analysis:array<struct<column_name:string,null_count:string,null_percentage:string>>,"
    f"descriptive_stats:map<string,{_STAT_JSON}>>"
)
REPORT_JSON = f"struct<metadata:struct<dataset_id:string,connector_type:string>,check_results:map<string,{_RESULT_JSON}>>"


def _whole(c: Column) -> Column:
    return c.try_cast("double").cast("bigint")


def checks_of(report: Column) -> Column:
    """Array of check rows of a parsed JSON report, in the order of its checks."""

    def time_or_number(v: Column) -> Column:
        return F.coalesce(v.try_cast("double"), F.unix_micros(v.try_cast("timestamp")).cast("double"))

    none = F.lit(None)
    def entry(**known) -> Column:
        return F.struct(*[known.get(n, none).alias(n) for n in FINDING_FIELDS]).cast(FINDING)

    def finding(item: Column, i: Column) -> Column:
        s = item["value"]
        time = s["mean"].isNotNull() & s["mean"].try_cast("double").isNull()
        kind = F.when(s["unique"].isNotNull(), "categorical").when(time, TEMPORAL).otherwise("numeric")
        return entry(
            ordinal=i, column_name=item["key"], type_class=kind, top=s["top"], **{n: _whole(s[n]) for n in WHOLE},
            **{n: time_or_number(s[JSON_NAMES.get(n, n)]) for n in ("mean", "std", "min", "p25", "p50", "p75", "max")},
        )

    def missing(x: Column, i: Column) -> Column:
        share = x["null_percentage"].try_cast("double")
        return entry(ordinal=i, column_name=x["column_name"], null_count=_whole(x["null_count"]), null_percentage=share)

    def row(e: Column) -> Column:
        name, v = e["key"], e["value"]
        columns = F.coalesce(
            F.when(name == "null_values", F.transform(v["null_analysis"], missing)).when(
                name == "descriptive_stats", F.transform(F.map_entries(v["descriptive_stats"]), finding)
            ),
            F.array().cast(f"array<{FINDING}>"),
        )
        metric = (
            F.when(name == "duplicates", _whole(v["duplicate_qty"]))
            .when(name == "null_values", _whole(v["columns_with_nulls"]))
            .otherwise(F.size(F.map_keys(v["descriptive_stats"])).cast("bigint"))
        )
        return F.struct(
            name.alias("check_name"), v["status"].alias("status"), v["error"].alias("error"), _whole(v["total_rows"]).alias("total_rows"),
            _whole(v["total_columns"]).alias("total_columns"), metric.alias("metric_value"), columns.alias("columns"),
        )

    return F.transform(F.filter(F.map_entries(report["check_results"]), lambda e: e["value"].isNotNull()), row)


def checks_from_json(texts: DataFrame, column: str = "document") -> DataFrame:
    """Check rows from JSON reports, without reading any table."""
    parsed = texts.select(F.from_json(F.col(column), REPORT_JSON).alias("r")).where("r is not null")
    made = parsed.select(
        F.col("r.metadata.dataset_id").alias("dataset_id"), F.col("r.metadata.connector_type").alias("connector"),
        F.posexplode(checks_of(F.col("r"))).alias("place", "c"),
    ).select("dataset_id", "connector", (F.col("place") + 1).alias("position"), "c.*")
    return made.select([F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(CHECK_ROW).fields])
