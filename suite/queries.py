"""One entry per operator: (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from rowsight import fixtures
from rowsight.fixtures import table, view
from rowsight.functions import identifiers as ids
from rowsight.functions.identifiers import CHECKS
from rowsight.functions.scalars import union_all
from rowsight.operators import cleanse, duplicates, generate, inject, nearest, nulls, outliers, search, statistics
from rowsight.plans import assess, indexing, parse, recommend, report, requests
from rowsight.session import new_folder
from rowsight.sources import catalog, sinks, tables

AS_OF = dt.date(2025, 1, 1)
STAMP = "2025-01-01 00:00:00"
SALT = 42


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to a few decimals: engines sum in different orders."""
    return df.select(
        [F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def _seconds(df: DataFrame) -> DataFrame:
    return df.select([F.date_trunc("second", c).cast("timestamp_ntz").alias(c) if c == "ts_mean" else F.col(c) for c in df.columns])


# ---- scans


def scan_table(spark, sf):
    return tables.scan(spark, f"{sf}/lineitem.parquet")


def scan_query(spark, sf):
    view(spark, sf, "orders", "SELECT * FROM orders")
    q = "SELECT o_custkey, count(*) AS order_count, max(o_totalprice) AS top_price FROM orders GROUP BY o_custkey"
    return tables.scan(spark, query=q, limit=1)


def scan_limit(spark, sf):
    return tables.scan(spark, f"{sf}/orders.parquet", limit=100, order_by=("o_totalprice", "o_orderkey"))


def table_sample(spark, sf):
    return catalog.table_sample(table(spark, sf, "customer"), 5, ("c_acctbal", "c_custkey"))


# ---- duplicates


def dup_check(spark, sf):
    return duplicates.check_duplicates(view(spark, sf, "dirty_orders"), "dirty_orders")


def dup_check_hashed(spark, sf):
    return duplicates.check_duplicates(view(spark, sf, "dirty_lineitem"), "dirty_lineitem")


def dup_check_key(spark, sf):
    return duplicates.check_duplicates(view(spark, sf, "dirty_orders"), "dirty_orders", exclude=("order_id", "o_totalprice"))


def dup_check_text(spark, sf):
    return duplicates.check_duplicates(table(spark, sf, "documents"), "documents", subset=["text"])


def dup_examples(spark, sf):
    return duplicates.duplicate_examples(table(spark, sf, "lineitem"), subset=["l_returnflag", "l_linestatus", "l_shipdate"])


# ---- nulls


def null_normalize(spark, sf):
    return nulls.normalize_nulls(view(spark, sf, "dirty_orders"))


def null_profile(spark, sf):
    return nulls.check_nulls(view(spark, sf, "dirty_orders"), "dirty_orders")


def null_summary(spark, sf):
    return nulls.null_summary(view(spark, sf, "doc_labels"), "doc_labels")


def null_rates(spark, sf):
    return _rounded(nulls.null_rates(view(spark, sf, "dirty_orders"), "dirty_orders"))


def null_patterns(spark, sf):
    return nulls.null_patterns(view(spark, sf, "dirty_orders"), "dirty_orders")


def completeness(spark, sf):
    return _rounded(nulls.completeness(view(spark, sf, "dirty_orders"), "dirty_orders"))


# ---- statistics


def numeric_profile(spark, sf):
    return _rounded(statistics.numeric_profile(view(spark, sf, "dirty_lineitem"), "dirty_lineitem"))


def categorical_profile(spark, sf):
    return statistics.categorical_profile(view(spark, sf, "dirty_orders"), "dirty_orders")


def temporal_profile(spark, sf):
    parts = [
        statistics.temporal_profile(table(spark, sf, "events"), "events"),
        statistics.temporal_profile(view(spark, sf, "dirty_lineitem"), "dirty_lineitem"),
    ]
    return _seconds(union_all(parts))


def column_profile(spark, sf):
    return _seconds(_rounded(statistics.column_profile(view(spark, sf, "dirty_orders"), "dirty_orders")))


def quick_profile(spark, sf):
    return _rounded(statistics.quick_profile(view(spark, sf, "dirty_orders"), "dirty_orders"))


def outlier_check(spark, sf):
    return _rounded(outliers.outlier_check(view(spark, sf, "dirty_lineitem"), "dirty_lineitem"))


def type_check(spark, sf):
    return outliers.type_check(view(spark, sf, "mixed_text"), "mixed_text")


# ---- assessment


def _orders_checks(spark, sf):
    return assess.assess(view(spark, sf, "dirty_orders"), "stage_sales.public.orders", "postgres")


def _known(spark, sf):
    return {
        "stage_sales.public.orders": ("postgres", view(spark, sf, "dirty_orders")),
        "PROD_SALES.PUBLIC.CUSTOMER": ("snowflake", table(spark, sf, "customer")),
        "DATA_HUB.CORE.LINEITEM": ("snowflake", view(spark, sf, "dirty_lineitem")),
        "data_hub.core.documents": ("postgres", view(spark, sf, "doc_labels")),
    }


def _all_checks(spark, sf):
    return assess.assess_all(_known(spark, sf))


def assessment(spark, sf):
    return assess.check_results(_orders_checks(spark, sf)).drop("error")


def assess_all(spark, sf):
    """In batches of three tables, kept in a folder."""
    rows = assess.assess_into(new_folder(spark, "checks"), _known(spark, sf), batch=3)
    return assess.check_results(rows).drop("error")


def assessment_registered(spark, sf):
    """The three checks and the registered ones, with what these find per column."""
    rows = assess.assess(view(spark, sf, "dirty_orders"), "stage_sales.public.orders", "postgres", [*CHECKS, "outliers", "types"])
    shown = F.transform(F.filter("columns", lambda c: F.col("position") > 3), lambda c: F.concat_ws(":", c["column_name"], c["type_class"], c["count"], c["freq"]))
    return assess.check_results(rows).drop("error").join(rows.select("check_name", F.array_join(shown, ",").alias("found")), "check_name")


def assessment_summary(spark, sf):
    return _rounded(assess.summary(_all_checks(spark, sf)))


def null_analysis(spark, sf):
    return assess.null_analysis(_all_checks(spark, sf))


def recommendations(spark, sf):
    return recommend.recommendations(_all_checks(spark, sf))


def assessment_from_json(spark, sf):
    texts = report.assessment_json(recommend.assessment(_orders_checks(spark, sf)), STAMP)
    return recommend.recommendations(report.checks_from_json(texts))


# ---- cleansing


def cleanse_customers(spark, sf):
    return cleanse.cleanse(view(spark, sf, "raw_customers"), cleanse.customer_rules())


def cleanse_products(spark, sf):
    return cleanse.cleanse(view(spark, sf, "raw_products"), cleanse.product_rules())


def cleanse_invoices(spark, sf):
    return cleanse.cleanse(view(spark, sf, "raw_invoices"), cleanse.invoice_rules())


def cleanse_attrition(spark, sf):
    return union_all([
        cleanse.attrition(view(spark, sf, "raw_customers"), cleanse.customer_rules(), "customers"),
        cleanse.attrition(view(spark, sf, "raw_products"), cleanse.product_rules(), "products"),
        cleanse.attrition(view(spark, sf, "raw_invoices"), cleanse.invoice_rules(), "invoices"),
    ])


def attrition_summary(spark, sf):
    return cleanse.attrition_summary(cleanse_attrition(spark, sf))


# ---- injection and generation


def inject_nulls(spark, sf):
    return inject.inject_nulls(table(spark, sf, "orders"), {"o_totalprice": 0.15, "o_orderpriority": 0.08}, ["o_orderkey"], SALT)


def inject_outliers(spark, sf):
    return inject.inject_outliers(
        table(spark, sf, "orders"),
        {"o_totalprice": {"rate": 0.05, "value": 999999999.99}, "o_custkey": {"min": -1000, "max": -1}},
        ["o_orderkey"], SALT,
    )


def inject_duplicates(spark, sf):
    return inject.inject_duplicates(table(spark, sf, "orders"), 0.08, ["o_orderkey"], SALT)


def near_duplicates(spark, sf):
    return inject.near_duplicates(table(spark, sf, "orders"), 0.08, "o_orderkey", "o_orderdate", seed=SALT)


def _customer_ids(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))


def _product_ids(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


def made_customers(spark, sf):
    """Customers before any defect."""
    return generate.customers(_customer_ids(spark, sf), AS_OF)


def made_products(spark, sf):
    return generate.products(_product_ids(spark, sf), AS_OF)


def gen_customers(spark, sf):
    return generate.dirty_customers(_customer_ids(spark, sf), AS_OF)


def gen_products(spark, sf):
    return generate.dirty_products(_product_ids(spark, sf), AS_OF)


def gen_invoices(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return generate.dirty_invoices(orders, _customer_ids(spark, sf), _product_ids(spark, sf), AS_OF)


# ---- identifiers and requests


def detect_connector(spark, sf):
    name = F.col("dataset_id")
    return view(spark, sf, "dataset_ids").select("c_custkey", name, ids.detect_connector(name).alias("connector"))


def dataset_suffix(spark, sf):
    name = F.col("dataset_id")
    return view(spark, sf, "dataset_ids").select("c_custkey", name, ids.dataset_suffix(name).alias("suffix"))


def extract_dataset(spark, sf):
    text = F.col("output")
    named = view(spark, sf, "replies").select("request_id", text, ids.extract_dataset(text).alias("dataset_id"))
    return named.select("request_id", "dataset_id", ids.connector_from_text(text, F.col("dataset_id")).alias("connector"))


def valid_responses(spark, sf):
    return view(spark, sf, "replies").where(ids.is_valid_response(F.col("output")))


def route_intent(spark, sf):
    return view(spark, sf, "replies").select("request_id", ids.route_intent(F.col("output")).alias("r")).select(
        "request_id", "r.action", F.concat_ws(",", "r.checks").alias("checks")
    )


def resolve_requests(spark, sf):
    return requests.resolve_requests(view(spark, sf, "replies"))


def process_requests(spark, sf):
    docs = report.documents(recommend.assessment(_all_checks(spark, sf)), STAMP)
    return requests.process_requests(view(spark, sf, "replies"), docs)


# ---- catalog


SCHEMA_OF = {"region": "ref", "nation": "ref", "events": "web", "pages": "web", "documents": "text", "benchmark": "text", "labels": "text",
             "conversations": "text", "embeddings": "text"}


def _frames(spark, sf):
    return {t: table(spark, sf, t) for t in fixtures.TABLES}


def _tables(spark, sf):
    found = catalog.describe_tables(_frames(spark, sf), "PROD_SALES", "sales", sizes=False)
    place = F.create_map(*[F.lit(x) for kv in SCHEMA_OF.items() for x in kv])
    return found.withColumn("schema_name", F.coalesce(F.element_at(place, F.col("table_name")), F.col("schema_name")))


def list_schemas(spark, sf):
    return catalog.list_schemas(view(spark, sf, "schemata"), "postgres", ("scratch",))


def list_tables(spark, sf):
    return catalog.list_tables(_tables(spark, sf)).select("database_name", "schema_name", "table_name", "table_type", "row_count")


def table_storage(spark, sf):
    """Sizes and dates of the tables' files."""
    found = catalog.describe_tables(_frames(spark, sf), "PROD_SALES", "sales")
    return found.select("table_name", "row_count", "bytes", "created", "last_altered")


def list_columns(spark, sf):
    """Columns with their tables' schemas and numbers of rows."""
    columns = catalog.describe_columns(_frames(spark, sf), "PROD_SALES", "sales").drop("schema_name")
    return columns.join(_tables(spark, sf).select("table_name", "schema_name", "row_count"), "table_name")


def table_documents(spark, sf):
    frames = _frames(spark, sf)
    columns = catalog.describe_columns(frames, "PROD_SALES", "sales")
    samples = union_all([catalog.sample_text(df, name, 3, (df.columns[0],)) for name, df in frames.items()])
    return catalog.table_documents(catalog.describe_tables(frames, "PROD_SALES", "sales", sizes=False), columns, samples)


def build_index(spark, sf):
    """All tables and one that fails when it is read, indexed in one call; what the index holds then, and what failed."""
    frames = _frames(spark, sf) | {"broken": table(spark, sf, "orders").where(F.when(F.col("o_orderkey") >= 0, F.raise_error(F.lit("damaged file"))).isNotNull())}
    entries = [indexing.Entry(SCHEMA_OF.get(name, "sales"), name, df) for name, df in frames.items()]
    path = new_folder(spark, "index")
    outcome = indexing.build_index(spark, entries, path, "PROD_SALES", sample_rows=0, sizes=False)
    found = indexing.read_index(spark, path).select("schema", "table_name", "full_name", "document", F.size("embedding").alias("width"))
    return outcome.select(F.col("schema_name").alias("schema"), "table_name", "status").join(found, ["schema", "table_name"], "left")


def schema_fingerprint(spark, sf):
    found = _tables(spark, sf)
    per = catalog.schema_fingerprint(found)
    rows = found.groupBy("schema_name").agg(F.sum("row_count").alias("row_count"))
    return per.join(rows, "schema_name").select("schema_name", F.array_join("tables", ",").alias("tables"), "table_count", "row_count")


def fingerprint_totals(spark, sf):
    return catalog.fingerprint_totals(_tables(spark, sf)).select(
        F.array_join("schemas", ",").alias("schemas"),
        F.array_join(F.transform(F.map_entries("tables_per_schema"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("tables_per_schema"),
        "total_schemas", "total_tables",
    )


def schema_history(spark, sf):
    """Six daily snapshots of the names in the part table, a window of sizes each."""
    names = view(spark, sf, "index_names").join(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    days = names.select(F.col("db").alias("schema_name"), "table_name", "p_size", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("day"))
    held = days.where("p_size BETWEEN day * 5 AND day * 5 + 20 OR p_size % 7 = day % 3")
    taken = F.make_timestamp_ntz(F.lit(2025), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0))
    return indexing.schema_history(held.select("schema_name", "table_name", taken.alias("taken")))


def schema_diff(spark, sf):
    names = view(spark, sf, "index_names").join(table(spark, sf, "part"), "p_partkey").select(
        F.col("db").alias("schema_name"), "table_name", "p_size"
    )
    return catalog.schema_diff(names.where("p_size <= 40"), names.where("p_size >= 10"))


SOURCES = [(1, "snowflake", "PROD_SALES"), (2, "postgres", "stage_sales")]


def _sources(spark):
    return spark.createDataFrame(SOURCES, "source_no int, connector string, database string")


def keyword_map(spark, sf):
    names = view(spark, sf, "index_names").select(F.concat_ws(".", "db", F.lit("public"), "table_name").alias("full_name"), "connector")
    return search.keyword_map(_sources(spark), names).select("keyword", "connector")


# ---- search


NAMES = ["orders", "customers", "invoices", "products", "call_center", "sales", "income_band", "suppliers", "shipments", "returns"]
ASKED = [
    "Find duplicate rows in prod orders", "null values in the customers table of postgres", "statistics for invoices",
    "report for stage database products table", "summary statistics for call center table", "Analyze staging sales table data quality",
    "income_band in snowflake please", "who supplies what", "live shipments since monday", "UNKNOWN table",
]


def _pick(label, options):
    return F.element_at(F.array(*[F.lit(o) for o in options]), label + 1)


def _index(vectors):
    low = F.concat(_pick(F.col("label"), NAMES), F.lit("_"), F.col("vec_id").cast("string"))
    stage = F.col("label") % 2 == 0
    return vectors.select(
        F.when(stage, F.concat(F.lit("stage_sales.public."), low)).otherwise(F.concat(F.lit("PROD_SALES.PUBLIC."), F.upper(low))).alias("full_name"),
        F.when(stage, low).otherwise(F.upper(low)).alias("table_name"),
        F.when(stage, "postgres").otherwise("snowflake").alias("connector"),
        "embedding",
    )


def _first_of_label(spark, sf):
    """The earliest vector of each label."""
    return table(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("embedding"))


def _requests(spark, sf):
    """Every vector as a request: a phrase of its label, and the whole text of the document of its number."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("said"))
    asked = table(spark, sf, "embeddings").join(texts, "vec_id", "left")
    phrase = F.concat(_pick(F.col("label"), ASKED), F.lit(" "), F.coalesce("said", F.lit("")))
    return asked.select(F.col("vec_id").cast("bigint").alias("request_id"), phrase.alias("text"), "embedding")


def vector_topk(spark, sf):
    wanted = table(spark, sf, "embeddings").select(F.col("vec_id").alias("request_id"), "embedding")
    items = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return _rounded(nearest.nearest(wanted, items, 10), 6)


def search_tables(spark, sf):
    index = _index(table(spark, sf, "embeddings"))
    keywords = search.keyword_map(_sources(spark), index)
    return _rounded(search.search_tables(_requests(spark, sf), index, keywords), 6)


def search_gate(spark, sf):
    index = _index(table(spark, sf, "embeddings"))
    keywords = search.keyword_map(_sources(spark), index)
    return search.search_gate(_requests(spark, sf), index, keywords).drop("context")


ASSESSED = ["stage_sales.public.orders", "PROD_SALES.PUBLIC.CUSTOMER", "DATA_HUB.CORE.LINEITEM", "data_hub.core.documents"]


def answer_requests(spark, sf):
    """Every vector as a question over the assessed tables, which stand at the first labels' vectors."""
    known = _first_of_label(spark, sf).where(F.col("label") < len(ASSESSED))
    name = _pick(F.col("label"), ASSESSED)
    index = known.select(
        name.alias("full_name"), F.substring_index(name, ".", -1).alias("table_name"),
        F.when(F.col("label").isin(1, 2), "snowflake").otherwise("postgres").alias("connector"), "embedding",
    )
    asked = _requests(spark, sf)
    gate = search.search_gate(asked, index, search.keyword_map(_sources(spark), index), threshold=-2.0)
    return requests.answer_requests(asked, gate, assess.check_results(_all_checks(spark, sf)))


def search_context(spark, sf):
    index = _index(table(spark, sf, "embeddings")).withColumn("document", F.concat(F.lit("TABLE: "), "full_name"))
    keywords = search.keyword_map(_sources(spark), index)
    return search.search_gate(_requests(spark, sf), index, keywords).select("request_id", "context")


def text_index(spark, sf):
    return search.text_vectors(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "embedding")


def table_index(spark, sf):
    index = search.build_index(table_documents(spark, sf))
    return index.select("connector", "schema", "full_name", "table_name", "embedding")


# ---- reports


def format_stats(spark, sf):
    return report.format_stats(_orders_checks(spark, sf))


def report_lines(spark, sf):
    return report.report_lines(recommend.assessment(_all_checks(spark, sf)), STAMP)


def report_summary(spark, sf):
    return report.report_summary(recommend.assessment(_all_checks(spark, sf)))


def report_documents(spark, sf):
    return sinks.named_reports(report.documents(recommend.assessment(_all_checks(spark, sf)), STAMP), "20250101_000000")


def parse_reports(spark, sf):
    docs = report.documents(recommend.assessment(_all_checks(spark, sf)), STAMP, ("markdown",))
    return parse.parse_reports(docs).select("dataset_id", "check_name", "status", "metric_value")


def parse_null_analysis(spark, sf):
    docs = report.documents(recommend.assessment(_all_checks(spark, sf)), STAMP, ("markdown",))
    found = parse.parse_reports(docs).where("check_name = 'null_values'").select("dataset_id", F.inline("columns"))
    return found.select("dataset_id", "column_name", "ordinal", "null_count", "null_percentage")



def all_queries():
    from types import FunctionType

    return {
        k: v for k, v in globals().items()
        if isinstance(v, FunctionType) and v.__module__ == __name__ and not k.startswith("_") and k != "all_queries"
    }
