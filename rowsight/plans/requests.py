"""From replies to reports: validity, table, source, assessment, documents; and from
questions to the rows of the checks they ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.identifiers import CHECKS, connector_from_text, dataset_suffix, extract_dataset, is_valid_response, route_intent


def resolve_requests(replies: DataFrame) -> DataFrame:
    """(request_id, output) -> request with status, reason, dataset_id, connector, file stem."""
    text = F.col("output")
    named = replies.select("request_id", text, is_valid_response(text).alias("valid"), extract_dataset(text).alias("dataset_id"))
    usable = F.col("valid") & F.col("dataset_id").isNotNull()
    return named.select(
        "request_id",
        F.when(usable, "success").otherwise("failed").alias("status"),
        F.when(~F.col("valid"), "low_relevance").when(F.col("dataset_id").isNull(), "metadata_extraction_failed").alias("reason"),
        F.when(usable, F.col("dataset_id")).alias("dataset_id"),
        F.when(usable, connector_from_text(text, F.col("dataset_id"))).alias("connector"),
        F.when(usable, F.concat(F.lit("comprehensive_dq_report_"), dataset_suffix(F.col("dataset_id")))).alias("file_stem"),
    )


def matched_tables(names: DataFrame, known: DataFrame) -> DataFrame:
    """(dataset_id, known_id) for each of the distinct ``names`` that a known table answers to.

    Case tells tables apart: the exact id counts first; without one, the id that
    differs in case only, if there is just one.
    """
    known = known.select(F.col("dataset_id").alias("known_id")).distinct()
    folds = known.groupBy(F.lower("known_id").alias("fold")).agg(F.min("known_id").alias("only"), F.count("*").alias("n")).where("n = 1")
    names = names.select("dataset_id").where("dataset_id IS NOT NULL").distinct()
    exact = names.join(known, F.col("dataset_id") == F.col("known_id"), "left")
    both = exact.join(folds, F.lower("dataset_id") == F.col("fold"), "left")
    return both.select("dataset_id", F.coalesce("known_id", "only").alias("known_id")).where("known_id IS NOT NULL")


def process_requests(replies: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per request and report format, with the file's name; requests that
    fail keep one row with the reason.

    ``documents`` (dataset_id, format, ...) are the reports of the known tables; texts
    stay there, found by report_id and format. Distinct names meet the known tables,
    not requests; failed requests pass by the joins.
    """
    resolved = resolve_requests(replies)
    good = resolved.where("status = 'success'")
    # a list of formats per table: bounded, and one row to join per request
    formats = documents.groupBy(F.col("dataset_id").alias("report_id")).agg(F.array_sort(F.collect_set("format")).alias("formats"))
    answers = matched_tables(good, documents).join(formats, F.col("known_id") == F.col("report_id")).select(F.col("dataset_id").alias("named"), "report_id", "formats")
    joined = good.join(answers, F.col("dataset_id") == F.col("named"), "left")
    missing = F.col("report_id").isNull()
    found = joined.select(
        "request_id", F.when(missing, "failed").otherwise("success").alias("status"), F.when(missing, "table_not_found").alias("reason"),
        "dataset_id", "connector", "file_stem", "report_id", F.explode_outer("formats").alias("format"),
    )
    failed = resolved.where("status <> 'success'").select(
        "request_id", "status", "reason", "dataset_id", "connector", "file_stem", F.lit(None).cast("string").alias("report_id"), F.lit(None).cast("string").alias("format")
    )
    return found.union(failed).withColumn("file_name", F.concat("file_stem", F.lit("."), "format"))


def answer_requests(requests: DataFrame, gate: DataFrame, checks: DataFrame) -> DataFrame:
    """The check rows that each question asks for: the chain from search to results.

    ``requests`` (request_id, text); ``gate`` (request_id, found, best_table, message) of
    ``search_gate``; ``checks`` the check rows of the known tables. The gate picks the
    table, the question's wording the checks. A request without a table, or whose table
    was not assessed, keeps one row with the reason.
    """
    intent = route_intent(F.col("text"))
    asked = requests.select("request_id", intent["action"].alias("action"), intent["checks"].alias("wanted"))
    asked = asked.join(gate.select("request_id", "found", "best_table", "message"), "request_id", "left")
    rows = F.struct("check_name", "status", "passed", "total_rows", "total_columns", "metric_value")
    # at most one row per kind of check and table
    by_table = checks.groupBy(F.col("dataset_id").alias("t")).agg(F.array_sort(F.collect_list(rows)).alias("results"))
    joined = asked.join(by_table, F.col("best_table") == F.col("t"), "left")
    chosen = F.filter("results", lambda r: F.array_contains(F.when(F.size("wanted") > 0, F.col("wanted")).otherwise(F.array(*map(F.lit, CHECKS))), r["check_name"]))
    one = joined.withColumn("r", F.explode_outer(chosen))
    return one.select(
        "request_id", "action", F.when(F.col("found"), F.col("best_table")).alias("dataset_id"),
        F.col("r.check_name").alias("check_name"), F.coalesce("r.status", F.lit("failed")).alias("status"), "r.passed", "r.total_rows", "r.total_columns", "r.metric_value",
        F.when(~F.coalesce("found", F.lit(False)), "no_table").when(F.col("t").isNull(), "table_not_assessed").alias("reason"),
    )
