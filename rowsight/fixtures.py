"""Dirty views over clean tables, in SQL that Spark and DuckDB both read.

Each view covers its whole source tables; defects fall on key residues.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

DIRTY_ORDERS = """
WITH base AS (
  SELECT o_orderkey AS order_id, o_custkey AS cust_id, o_orderstatus, o_orderdate,
         CASE WHEN o_orderkey % 7  = 0 THEN '<NA>' WHEN o_orderkey % 11 = 0 THEN ''
              WHEN o_orderkey % 13 = 0 THEN 'NULL' WHEN o_orderkey % 17 = 0 THEN 'null'
              WHEN o_orderkey % 19 = 0 THEN NULL   WHEN o_orderkey % 23 = 0 THEN 'Null'
              ELSE o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL
              WHEN o_orderkey % 29 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice
  FROM orders)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE order_id % 20 = 0
"""

DIRTY_LINEITEM = """
WITH base AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN (l_orderkey + l_partkey) % 31 = 0 THEN CAST(15000 AS DOUBLE)
              WHEN (l_orderkey + l_partkey) % 37 = 0 THEN CAST(-10 AS DOUBLE) ELSE l_quantity END AS l_quantity,
         CASE WHEN (l_orderkey + l_partkey) % 43 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS l_extendedprice,
         CASE WHEN (l_orderkey + l_suppkey) % 41 = 0 THEN CAST(75 AS DOUBLE) ELSE l_discount END AS l_discount,
         CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE l_tax END AS l_tax,
         CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate,
         l_returnflag, l_linestatus
  FROM lineitem)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE l_orderkey % 25 = 0
"""

DOC_LABELS = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

MIXED_TEXT = """
SELECT o_orderkey AS order_id,
       CAST(o_custkey AS STRING) AS number_text,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_totalprice AS STRING) WHEN o_orderkey % 4 = 1 THEN CAST(o_orderkey AS STRING)
            WHEN o_orderkey % 4 = 2 THEN o_orderpriority ELSE NULL END AS mixed_text,
       CASE WHEN o_orderkey % 9 = 0 THEN '2024-02-31' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_text,
       CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 12:30:00' AS time_text,
       o_orderstatus AS label_text
FROM orders
"""

# one table name per part; source and database follow the part's type and size
TABLE_INDEX_NAMES = """
SELECT p_partkey,
       CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'stage_sales' WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'PROD_SALES'
            WHEN p_type = 'STANDARD' THEN 'dev_hub' ELSE 'LIVE_FIN' END AS db,
       CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'STANDARD') THEN 'postgres' ELSE 'snowflake' END AS connector,
       replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) AS table_name
FROM part
"""

SCHEMATA = """
SELECT CASE WHEN p_type = 'ECONOMY' THEN 'pg_temp_' || CAST(p_partkey AS STRING)
            WHEN p_type = 'PROMO' THEN 'pg_toast_temp_' || CAST(p_partkey AS STRING)
            WHEN p_type = 'SMALL' AND p_size < 10 THEN 'information_schema'
            WHEN p_type = 'SMALL' AND p_size < 20 THEN 'pg_catalog'
            WHEN p_type = 'SMALL' AND p_size < 30 THEN 'scratch'
            ELSE 'mart_' || CAST(p_partkey AS STRING) END AS schema_name
FROM part
"""

# replies of earlier checks: a sentence that names a table (or none) before each turn's text
REPLIES = """
SELECT conv_id * 1000 + turn AS request_id,
       CASE WHEN (conv_id + turn) % 8 = 0 THEN 'No tables found with sufficient relevance (minimum 20% match required). '
            WHEN (conv_id + turn) % 8 = 1 THEN 'Full report for `PROD_SALES.PUBLIC.CUSTOMER` follows. '
            WHEN (conv_id + turn) % 8 = 2 THEN 'Checked stage_sales.public.orders for duplicate rows. '
            WHEN (conv_id + turn) % 8 = 3 THEN 'Missing values in DATA_HUB.CORE.LINEITEM. '
            WHEN (conv_id + turn) % 8 = 4 THEN 'Descriptive statistics of the snowflake table `my_db.core.part`. '
            WHEN (conv_id + turn) % 8 = 5 THEN 'No relevant tables found. '
            WHEN (conv_id + turn) % 8 = 6 THEN 'Export report and run all checks on data_hub.core.documents in Postgres. '
            ELSE 'Nothing named here: ' END || text AS output
FROM conversations
"""

DATASET_IDS = """
SELECT c_custkey,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'PROD_SALES.PUBLIC.' || upper(c_name)
            WHEN c_mktsegment = 'AUTOMOBILE' THEN 'stage_sales.public.' || lower(c_name)
            WHEN c_mktsegment = 'MACHINERY' THEN 'Prod_Hub.Core.' || c_name
            WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Stage_Hub.' || c_name
            ELSE c_name END AS dataset_id
FROM customer
"""

RAW_CUSTOMERS = """
WITH base AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'c' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
         CASE WHEN c_custkey % 21 = 0 THEN 150 + c_custkey % 800 ELSE 18 + c_custkey % 68 END AS age,
         CASE WHEN c_custkey % 26 = 0 THEN CAST(-1000 AS DOUBLE) ELSE c_acctbal * 10 + 20000 END AS income,
         CASE WHEN c_custkey % 33 = 0 THEN CAST(999999999 AS DOUBLE) ELSE c_acctbal END AS account_balance,
         c_mktsegment AS customer_segment
  FROM customer)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE customer_id % 12 = 0
"""

RAW_PRODUCTS = """
WITH base AS (
  SELECT p_partkey AS product_id, 'SKU-' || CAST(p_partkey AS STRING) AS sku,
         CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name END AS product_name,
         CASE WHEN p_partkey % 19 = 0 THEN -p_retailprice ELSE p_retailprice END AS price,
         CASE WHEN p_partkey % 23 = 0 THEN -p_size ELSE p_size * 10 END AS stock_quantity,
         CASE WHEN p_partkey % 29 = 0 THEN CAST(99 AS DOUBLE) ELSE CAST(p_partkey % 41 AS DOUBLE) / 10 + 1 END AS rating,
         CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN CAST(999999 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS weight
  FROM part)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE product_id % 12 = 0
"""

RAW_INVOICES = """
WITH base AS (
  SELECT l_orderkey * 10 + l_linenumber AS invoice_id, l_suppkey AS customer_id,
         CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE l_partkey END AS product_id, l_shipdate AS invoice_date,
         CASE WHEN (l_orderkey + l_partkey) % 31 = 0 THEN CAST(-10 AS DOUBLE)
              WHEN (l_orderkey + l_partkey) % 37 = 0 THEN CAST(15000 AS DOUBLE) ELSE l_quantity END AS quantity,
         CASE WHEN (l_orderkey + l_partkey) % 43 = 0 THEN CAST(-100 AS DOUBLE) ELSE l_extendedprice END AS unit_price,
         CASE WHEN (l_orderkey + l_suppkey) % 47 = 0 THEN CAST(-2000 AS DOUBLE) ELSE l_extendedprice END AS total_amount,
         CASE WHEN l_orderkey % 20 = 0 THEN NULL WHEN l_orderkey % 41 = 0 THEN CAST(75 AS DOUBLE) ELSE l_tax END AS tax_rate,
         CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 59 = 0 THEN CAST(-500 AS DOUBLE) ELSE l_extendedprice * l_discount END AS discount_amount
  FROM lineitem)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE invoice_id % 12 = 0
"""

VIEWS = {
    "raw_customers": RAW_CUSTOMERS,
    "raw_products": RAW_PRODUCTS,
    "raw_invoices": RAW_INVOICES,
    "dirty_orders": DIRTY_ORDERS,
    "dirty_lineitem": DIRTY_LINEITEM,
    "doc_labels": DOC_LABELS,
    "mixed_text": MIXED_TEXT,
    "index_names": TABLE_INDEX_NAMES,
    "schemata": SCHEMATA,
    "replies": REPLIES,
    "dataset_ids": DATASET_IDS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, sql: str | None = None) -> DataFrame:
    """A fixture (or any query over the tables and fixtures) as a DataFrame."""
    sql = sql or VIEWS[name]
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def with_view(name: str, body: str) -> str:
    """Oracle SQL over a fixture."""
    return f"WITH {name} AS ({VIEWS[name]}) {body}"
