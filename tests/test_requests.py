import pytest

from rowsight.plans import assess, requests
from rowsight.sources import tables


def test_case_twins_and_unknown_tables(spark):
    replies = spark.createDataFrame(
        [(1, "Report for `DB.S.T` in snowflake"), (2, "Report for `db.s.t` in postgres"), (3, "Report for `A.B.C`"), (4, "Report for `NO.SUCH.TABLE`"), (5, "nothing named"), (6, "No relevant tables found.")] + [(i, "Report for `db.s.t`") for i in range(10, 40)],
        "request_id bigint, output string",
    )
    documents = spark.createDataFrame(
        [(t, f, "text") for t in ("DB.S.T", "db.s.t", "a.b.c") for f in ("html", "json")], "dataset_id string, format string, document string"
    )
    got = {}
    for r in requests.process_requests(replies, documents).collect():
        got.setdefault(r.request_id, []).append((r.status, r.reason, r.report_id, r.format))
    both = lambda t: {("success", None, t, "html"), ("success", None, t, "json")}
    assert set(got[1]) == both("DB.S.T") and set(got[2]) == both("db.s.t") and set(got[3]) == both("a.b.c")
    assert got[4] == [("failed", "table_not_found", None, None)]
    assert got[5] == [("failed", "metadata_extraction_failed", None, None)] and got[6] == [("failed", "low_relevance", None, None)]
    assert all(set(got[i]) == both("db.s.t") for i in range(10, 40))


def test_answers(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    checks = assess.check_results(assess.assess(df, "db.s.t"))
    asked = spark.createDataFrame([(1, "duplicate rows in t"), (2, "everything about t"), (3, "duplicates of q"), (4, "what")], "request_id bigint, text string")
    gate = spark.createDataFrame([(1, True, "db.s.t", None), (2, True, "db.s.t", None), (3, True, "db.s.q", None), (4, False, None, "none")], "request_id bigint, found boolean, best_table string, message string")
    got = {}
    for r in requests.answer_requests(asked, gate, checks).collect():
        got.setdefault(r.request_id, []).append((r.check_name, r.status, r.metric_value, r.reason))
    assert got[1] == [("duplicates", "failure", 1, None)]
    assert sorted(x[0] for x in got[2]) == ["descriptive_stats", "duplicates", "null_values"]
    assert got[3] == [(None, "failed", None, "table_not_assessed")] and got[4] == [(None, "failed", None, "no_table")]


def test_any_failed_load_is_an_error_row(spark, tmp_path):
    (tmp_path / "broken.parquet").mkdir()
    (tmp_path / "broken.parquet" / "part-0.parquet").write_bytes(b"not parquet at all")
    source = {"postgres": tables.JdbcSource("jdbc:unheard-of:thing")}
    for found in (
        assess.assess_table(spark, f"{tmp_path}/broken.parquet"),
        assess.assess_table(spark, "s.t", "postgres", jdbc=source),
        assess.assess_table(spark, "no.such.table"),
    ):
        rows = found.collect()
        assert len(rows) == 3 and all(r.status == "error" and r.error for r in rows)


def test_top_values_survive_the_round_trip(spark):
    from rowsight.plans import parse, recommend, report

    for top in ("a|b", "back\\slash|n", "two\nlines", "\\n", "plain", "x \\| y"):
        df = spark.createDataFrame([(top, 1.5), (top, 2.5), ("zz", 4.0)], "s string, n double")
        docs = report.documents(recommend.assessment(assess.assess(df, "a.b.c")), "2025-01-01 00:00:00", "markdown")
        rows = parse.parse_reports(docs).where("check_name = 'descriptive_stats'").selectExpr("inline(columns)").collect()
        found = {r.column_name: r for r in rows}
        assert (found["s"].top, found["s"].freq, found["s"].unique) == (top, 2, 2), top
        assert (found["n"].min, found["n"].p50, found["n"].max, found["n"]["count"]) == (1.5, 2.5, 4.0, 3)


def test_rules_of_many_null_columns_and_errors(spark):
    from rowsight.plans import recommend

    wide = spark.range(10).selectExpr(*[f"CASE WHEN id % 10 > 0 THEN 'v' END AS c{i}" for i in range(6)], "id AS k")
    five = wide.drop("c5")
    rules = lambda checks: {r.rule_id for r in recommend.recommendations(checks).collect()}
    assert "many_null_columns" in rules(assess.assess(wide, "a.b.wide"))
    assert "many_null_columns" not in rules(assess.assess(five, "a.b.five"))
    # a check that did not run gives no advice of its own
    broken = assess.error_rows(spark, "a.b.gone", "postgres", None, "gone")
    assert rules(broken) == {"errors", "low_pass_rate"}


def test_tables_in_batches(spark, tmp_path):
    tables = {f"db.s.t{i}": ("postgres", spark.range(i + 1).withColumnRenamed("id", "n")) for i in range(5)}
    tables["db.s.bad"] = ("postgres", spark.range(3).selectExpr("CAST(concat('x', id) AS INT) AS n"))
    rows = assess.assess_into(f"{tmp_path}/checks", tables, batch=3).collect()
    assert len(rows) == 18
    status = {r.dataset_id: set() for r in rows}
    for r in rows:
        status[r.dataset_id].add(r.status)
    assert status.pop("db.s.bad") == {"error"} and all(v == {"success"} for v in status.values())
    # a rerun reads what is finished and assesses the rest
    tables = {"db.s.more": ("postgres", spark.range(2).toDF("n"))} | {k: (kind, spark.sql("SELECT raise_error('read again') AS n")) for k, (kind, _) in tables.items()}
    again = assess.assess_into(f"{tmp_path}/checks", tables).collect()
    assert len(again) == 21 and {r.status for r in again if r.dataset_id != "db.s.bad"} == {"success"}
    assert assess.assess_into(f"{tmp_path}/none", {}).count() == 0


def test_registered_checks(spark):
    from pyspark.sql import functions as F

    from rowsight.plans import checks, recommend, report

    rows = [(float(i), f"{i}" if i % 2 else "word", f"t{i}") for i in range(50)] + [(9000.0, None, "x")]
    df = spark.createDataFrame(rows, "x double, mixed string, plain string")
    got = {r.check_name: r for r in assess.assess(df, "a.b.c", checks="outliers, types, null_values").collect()}
    assert [got[c].position for c in ("outliers", "types", "null_values")] == [1, 2, 3]
    assert (got["outliers"].status, got["outliers"].metric_value, got["outliers"].total_rows) == ("failure", 1, 51)
    assert [(c.column_name, c["count"], c.freq) for c in got["outliers"].columns] == [("x", 51, 1)]
    assert (got["types"].metric_value, [(c.column_name, c.freq) for c in got["types"].columns]) == (1, [("mixed", 25), ("plain", 0)])
    checks.register(checks.Check("no_rows_over_10", lambda t: t.agg(F.count("*").alias("total_rows"), F.greatest(F.count("*") - 10, F.lit(0)).alias("metric_value"))))
    try:
        both = assess.assess(df, "a.b.c", checks=["duplicates", "no_rows_over_10"])
        assert {r.check_name: (r.status, r.metric_value) for r in both.collect()} == {"duplicates": ("success", 0), "no_rows_over_10": ("failure", 41)}
        assert assess.summary(both).first().failed_checks == 1
        assert report.documents(recommend.assessment(both), "2025-01-01 00:00:00").count() == 3
    finally:
        del checks.REGISTERED["no_rows_over_10"]
    assert assess.chosen_checks("no_rows_over_10,types") == ["types"]
    # tables without numbers or without rows
    bare = assess.assess(df.select("plain").where("false"), "a.b.d", checks=["outliers", "types"]).collect()
    assert {(r.check_name, r.status, r.total_rows) for r in bare} == {("outliers", "success", 0), ("types", "success", 0)}
    with pytest.raises(ValueError):
        checks.register(checks.Check("a,b", lambda t: t))


def test_cleansing_adds_up_with_nan_and_maps(spark):
    from rowsight.operators import cleanse

    nan = float("nan")
    rows = [(i % 7, f"p{i % 5}" if i % 4 else None, f"s{i % 3}", [nan, 1.0, -1.0][i % 3], i % 5 - 1, [nan, 3.0][i % 2], [nan, 5.0, 2000.0][i // 3 % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "product_id int, product_name string, sku string, price double, stock_quantity int, rating double, weight double")
    for table in (df, df.selectExpr("*", "map('a', product_id) AS m")):
        kept = cleanse.cleanse(table, cleanse.product_rules())
        steps = cleanse.attrition(table, cleanse.product_rules(), "t")
        assert sum(r.removed for r in steps.collect()) + kept.count() == 200
        assert kept.where("price IS NULL OR isnan(price) OR isnan(weight)").count() == 0 and kept.where("weight IS NULL").count() > 0
