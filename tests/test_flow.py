import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowsight.functions.identifiers import default_connector
from rowsight.operators import cleanse, generate, inject
from rowsight.plans import assess, parse, recommend, report
from rowsight.sources import catalog, sinks, tables

FINDINGS = assess.FINDING_FIELDS


def finding(**known):
    return tuple(known.get(n) for n in FINDINGS)


def titles(checks):
    return [r.title for r in recommend.recommendations(checks).orderBy("position").collect()]


def test_golden_recommendations(spark):
    """Numbers of a published report on 30,000 products, and its advice in order."""
    nulls = [("supplier", 5400, 18.0), ("description", 4500, 15.0), ("brand", 3600, 12.0), ("weight", 2915, 9.72)]
    stats = [("price", 251.41, 376.93), ("cost", 222.11, 293.43), ("rating", 5.60, 12.80)]
    columns = [finding(ordinal=i, column_name=c, type_class="numeric", count=30000, mean=m, std=s) for i, (c, m, s) in enumerate(stats)]
    columns += [finding(ordinal=i, column_name=f"c{i}", type_class="categorical", count=30000, unique=7) for i in range(3, 25)]
    rows = [
        ("d", "postgres", 1, "duplicates", "failure", None, 30000, 25, 599, []),
        ("d", "postgres", 2, "null_values", "success", None, 30000, 25, 4,
         [finding(ordinal=i, column_name=c, null_count=n, null_percentage=p) for i, (c, n, p) in enumerate(nulls)]),
        ("d", "postgres", 3, "descriptive_stats", "success", None, 30000, 25, 25, columns),
    ]
    checks = spark.createDataFrame(rows, assess.CHECK_ROW)
    assert titles(checks) == [
        "Establish Data Quality Framework", "Remove Duplicate Records", "Implement Null Handling Strategy",
        "Investigate High Variability in price", "Investigate High Variability in cost", "Investigate High Variability in rating",
        "Data Documentation and Profiling",
    ]
    text = {r.title: r.description for r in recommend.recommendations(checks).collect()}
    assert "`supplier`, `description`, `brand`" in text["Implement Null Handling Strategy"]
    assert "(CV=149.93)" in text["Investigate High Variability in price"]
    assert text["Establish Data Quality Framework"].startswith("Only 33% of checks passed.")


def test_failed_load_is_an_error(spark):
    checks = assess.assess_table(spark, "no_such.table_here", checks="duplicates, null_values, nonsense")
    got = assess.summary(checks).first()
    assert (got.total_checks, got.error_checks, got.passed_checks) == (2, 2, 0)
    assert "Fix Check Execution Errors" in titles(checks)


def test_check_selection(spark):
    df = spark.range(3).toDF("a")
    assert [r.check_name for r in assess.assess(df, "t", checks=["null_values"]).collect()] == ["null_values"]
    assert assess.assess(df, "t", checks="nonsense").count() == 0
    none = {r.check_name: r for r in assess.assess(df.select(), "t").collect()}
    assert none["descriptive_stats"].status == "failure" and none["null_values"].status == "success"


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, None if i % 3 else "x", float(i)) for i in range(120)], "k int, s string, v double")
    checks = spark.createDataFrame(assess.assess(df.unionByName(df.limit(7)), "stage_a.b.c").collect(), assess.CHECK_ROW)
    docs = report.documents(recommend.assessment(checks), "2025-01-01 00:00:00", "markdown, html, json, summary, pdf")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() == 4
    want = {(r.check_name, r.status, r.metric_value) for r in checks.collect()}
    md = parse.parse_reports(docs.where("format = 'markdown'"))
    assert {(r.check_name, r.status, r.metric_value) for r in md.collect()} == want
    again = report.checks_from_json(docs.where("format = 'json'"))
    assert {(r.check_name, r.status, r.metric_value) for r in again.collect()} == want
    assert titles(again) == titles(checks)
    wrapped = docs.where("format = 'json'").selectExpr("dataset_id", "concat('Done: {\"assessment_results\": ', document, '}') AS document")
    assert {(r.check_name, r.metric_value) for r in parse.parse_reports(wrapped).collect()} == {(a, c) for a, _, c in want}
    for path in (str(tmp_path / "out"), f"file://{tmp_path}/uri", str(tmp_path / "out")):  # the last one once more
        files = sinks.save_reports(docs, path, "20250101_000000", "markdown,json,pdf")
        names = {f"comprehensive_dq_report_stage_a_c_20250101_000000.{e}" for e in ("md", "json")}
        assert {r.file_name for r in files.collect()} == names
        folder = tmp_path / path.rsplit("/", 1)[1]
        assert {f.name for f in folder.iterdir()} == names and all(f.is_file() for f in folder.iterdir())
    texts = {r.format: r.document for r in docs.collect()}
    assert (tmp_path / "out" / "comprehensive_dq_report_stage_a_c_20250101_000000.md").read_text() == texts["markdown"]
    single = sinks.save_reports(docs, str(tmp_path / "single"), "20250101_000000", ("html",), comprehensive=False).first().file_name
    assert [f.name for f in (tmp_path / "single").iterdir()] == [single]
    # a job that fails leaves no file behind
    with pytest.raises(PySparkException):
        sinks.save_reports(docs.withColumn("document", F.raise_error(F.lit("lost"))), str(tmp_path / "failed"), "20250101_000000")
    assert not (tmp_path / "failed").exists() or not list((tmp_path / "failed").iterdir())


def test_json_numbers_as_text(spark):
    doc = '{"metadata": {"dataset_id": "a.b.c", "connector_type": "postgres"}, "check_results": {"null_values": {"status": "success", "total_rows": 10,' \
          ' "total_columns": 2, "columns_with_nulls": 1, "null_analysis": [{"column_name": "x", "null_count": "3", "null_percentage": 30.0}]}}}'
    got = report.checks_from_json(spark.createDataFrame([(doc,)], "document string")).first()
    assert (got.metric_value, got.columns[0].null_count, got.columns[0].null_percentage) == (1, 3, 30.0)


def test_exact_counts(spark):
    df = spark.range(1000).selectExpr("id", "id * 1.5D AS x", "CAST(id AS INT) AS n")
    blank = inject.inject_nulls(df, {"x": 0.137, "missing": 0.5}, ["id"])
    assert blank.where("x is null").count() == 137
    odd = inject.inject_outliers(df, {"n": {"rate": 0.1, "min": -9, "max": -3}, "x": {"rate": 0.03, "value": -1.0}}, ["id"])
    assert odd.where("n between -9 and -3").count() == 100 and odd.where("x = -1").count() == 30
    more = inject.inject_duplicates(df, 0.25, ["id"])
    assert more.count() == 1250 and more.distinct().count() == 1000
    assert inject.inject_nulls(df, {"x": 0.0}, ["id"]).where("x is null").count() == 0
    keyed = inject.with_row_key(df.select("x").unionByName(df.select("x")))
    assert keyed.select("row_key").distinct().count() == 2000


def test_generated_tables(spark):
    ids, day = generate.row_ids(spark, 460), dt.date(2025, 1, 1)
    products = generate.dirty_products(ids, day)
    rows = products.collect()
    assert len(rows) == 500 and len(products.columns) == 25
    assert len({r.product_id for r in rows}) == 460
    assert sum(r.supplier is None for r in rows) == 90 and sum(r.brand is None for r in rows) == 60
    steps = cleanse.attrition(products, cleanse.product_rules(), "p").orderBy("step").collect()
    kept = cleanse.cleanse(products, cleanse.product_rules())
    assert steps[0].rows_before == 500 and steps[-1].rows_after == kept.count()
    assert kept.distinct().count() == kept.count()
    bills = generate.invoices(ids, ids, ids, day)
    assert bills.count() == 460 and len(bills.columns) == 20
    bad = bills.where("abs(total_amount - (subtotal - coalesce(discount_amount, 0) + coalesce(tax_amount, 0))) > 0.011")
    assert bad.count() == 0


def test_scan_options(spark, tmp_path):
    source = tables.JdbcSource("jdbc:x:y", partition_column="id", lower_bound=0, upper_bound=9, partitions=4)
    assert source.read_options("a.b")["numPartitions"] == "4"
    assert source.read_options("a.b", "SELECT 1")["dbtable"] == "(SELECT 1) source_query"
    assert tables.JdbcSource("jdbc:x:y").read_options("a.b", "SELECT 1")["query"] == "SELECT 1"
    with pytest.raises(ValueError):
        tables.scan(spark, "t", connector="postgresql")
    assert tables.scan(spark, query="SELECT * FROM range(5)", limit=2).count() == 5
    path = str(tmp_path / "t.csv")
    sinks.write_csv(spark.range(4).toDF("a"), path)
    assert tables.read_csv(spark, path, "a bigint").agg({"a": "sum"}).first()[0] == 6
    assert tables.scan(spark, path, limit=0).count() == 4
    index = str(tmp_path / "index")
    for recreate, rows in ((True, 3), (False, 6), (True, 3)):
        sinks.write_index(spark.range(3).toDF("full_name"), index, recreate)
        assert spark.read.parquet(index).count() == rows


def test_choices():
    assert default_connector(["postgres"], "snowflake") == "postgres"
    assert default_connector([], "") == "snowflake" and default_connector([], "postgres") == "postgres"
    assert catalog.select_schemas(["a"], auto=True) is None
    assert catalog.select_schemas(["a"], config={"auto_discover_schemas": True}) is None
    assert catalog.select_schemas(None, False, {"schema": "s"}) == ["s"] and catalog.select_schemas() == [None]


def test_rows_not_picked_are_not_made(spark):
    """Numbering up to a row leaves out the others by their key, before their columns are computed."""
    ids = spark.range(1, 401)
    number = {r.id: r.row_index for r in inject.with_dense_index(ids, ["id"], "s").collect()}
    assert sorted(number.values()) == list(range(1, 401))
    late = [i for i, n in number.items() if n > 100]
    made = ids.withColumn("x", F.when(F.col("id").isin(late), F.raise_error(F.lit("made in vain")).cast("bigint")).otherwise(F.col("id")))
    for last in (0, 1, 60):
        got = {r.id: r.row_index for r in inject.with_dense_index(made, ["id"], "s", last=F.lit(last)).collect()}
        assert got == {i: n for i, n in number.items() if n <= last}
