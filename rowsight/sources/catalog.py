"""Catalog metadata: schemas, tables, columns, samples, documents, fingerprints."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.identifiers import WAREHOUSE
from ..functions.scalars import col, grouped, union_all

log = logging.getLogger(__name__)

# fixed values: schemas of the sources themselves
SYSTEM_SCHEMAS = {
    "snowflake": ("INFORMATION_SCHEMA",),
    "postgres": ("information_schema", "pg_catalog", "pg_toast", "pg_temp_1", "pg_toast_temp_1"),
}
SYSTEM_PATTERNS = {"snowflake": (), "postgres": (r"pg_temp_%", r"pg_toast_temp_%")}

TABLES = (
    "connector string, database_name string, schema_name string, table_name string, table_type string, "
    "row_count bigint, bytes bigint, table_comment string, created timestamp_ntz, last_altered timestamp_ntz"
)
COLUMNS = (
    "connector string, database_name string, schema_name string, table_name string, ordinal int, column_name string, "
    "data_type string, is_nullable string, column_default string, column_comment string"
)


def list_schemas(schemata: DataFrame, connector: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(schema_name) rows minus system and excluded schemas, by name."""
    name = F.col("schema_name")
    kept = schemata.where(~name.isin(*SYSTEM_SCHEMAS.get(connector, ("",))))
    for pattern in SYSTEM_PATTERNS.get(connector, ()):
        kept = kept.where(~name.like(pattern))
    if exclude:
        kept = kept.where(~name.isin(*exclude))
    return kept.orderBy("schema_name")


def schemata(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW SCHEMAS").select(F.col("namespace").alias("schema_name"))


def select_schemas(
    schemas: list[str] | None = None, auto: bool | None = None, config: dict | None = None,
) -> list[str | None] | None:
    """Which schemas to index: None = all; [None] = the current one.

    An explicit flag decides, then the configured flag, then the given list,
    then the configured one (``schemas`` or ``schema``).
    """
    config = config or {}
    if auto or (auto is None and config.get("auto_discover_schemas")):
        return None
    named = schemas or config.get("schemas") or config.get("schema")
    if isinstance(named, str):
        named = [named]
    return list(named) if named else [None]


def describe_tables(
    frames: dict[str, DataFrame], database: str, schema: str, connector: str = WAREHOUSE, count_rows: bool = True,
    views: frozenset[str] = frozenset(), comments: dict[str, str] | None = None, sizes: bool = True,
) -> DataFrame:
    """Table rows for named DataFrames; rows are counted unless told not to
    (Parquet counts come from the footers).

    ``sizes``: tables that are files also get bytes, and as dates of creation and last
    change those of their oldest and newest file. Files without rows don't show.
    """
    comments = comments or {}
    rows = []
    for name, df in sorted(frames.items()):
        one = storage(df) if sizes else None
        if one is None:
            one = df.agg(F.count(F.lit(1)).alias("row_count")).select("*", *_no_files())
        if not count_rows:
            one = one.withColumn("row_count", F.lit(None)) if sizes else df.sparkSession.range(1).select(F.lit(None).alias("row_count"), *_no_files())
        rows.append(
            one.select(
                F.lit(connector).alias("connector"), F.lit(database).alias("database_name"), F.lit(schema).alias("schema_name"),
                F.lit(name).alias("table_name"), F.lit("VIEW" if name in views else "BASE TABLE").alias("table_type"),
                F.col("row_count").cast("bigint").alias("row_count"), "bytes",
                F.lit(comments.get(name)).cast("string").alias("table_comment"), "created", "last_altered",
            )
        )
    return union_all(rows)


def _no_files() -> list[Column]:
    return [F.lit(None).cast(kind).alias(name) for name, kind in (("bytes", "bigint"), ("created", "timestamp_ntz"), ("last_altered", "timestamp_ntz"))]


def storage(df: DataFrame) -> DataFrame | None:
    """One row (row_count, files, bytes, created, last_altered) of a table that is files; None for other tables.

    Read from the files' metadata in the scan that counts rows, folded per file before the shuffle.
    """
    try:
        files = df.groupBy("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").agg(F.count(F.lit(1)).alias("n"))
    except PySparkException:  # not a scan of files
        return None
    return files.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"),
        F.min("file_modification_time").cast("timestamp_ntz").alias("created"), F.max("file_modification_time").cast("timestamp_ntz").alias("last_altered"),
    )


def list_tables(tables: DataFrame, schema: str | None = None, include_views: bool = True, max_tables: int | None = None) -> DataFrame:
    """Tables of a schema by name; ``max_tables`` keeps the first ones."""
    kept = tables.where(F.col("schema_name") == schema) if schema else tables
    if not include_views:
        kept = kept.where("table_type = 'BASE TABLE'")
    kept = kept.orderBy("table_name")
    return kept.limit(max_tables) if max_tables else kept


def describe_columns(
    frames: dict[str, DataFrame], database: str, schema: str, connector: str = WAREHOUSE,
) -> DataFrame:
    """Column rows for named DataFrames, from their schemas."""
    spark = next(iter(frames.values())).sparkSession
    rows = [
        (connector, database, schema, name, i + 1, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO", None, f.metadata.get("comment"))
        for name, df in sorted(frames.items())
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def catalog_frames(spark: SparkSession, schema: str | None = None) -> dict[str, DataFrame]:
    """Tables of the session catalog; one that fails to resolve is left out."""
    out = {}
    for t in spark.catalog.listTables(schema) if schema else spark.catalog.listTables():
        try:
            out[t.name] = spark.table(t.name if t.isTemporary else f"{schema}.{t.name}" if schema else t.name)
        except PySparkException as e:  # a broken table must not stop the others
            log.warning("skipped %s: %s", t.name, e)
    return out


def table_sample(df: DataFrame, rows: int = 5, order_by: tuple[str, ...] = ()) -> DataFrame:
    return (df.orderBy(*[col(c) for c in order_by]) if order_by else df).limit(rows)


def sample_text(df: DataFrame, table_name: str, rows: int = 3, order_by: tuple[str, ...] = ()) -> DataFrame:
    """(table_name, sample): the sampled rows as JSON lines."""
    few = table_sample(df, rows, order_by)
    return few.select(F.to_json(F.struct(*[col(c) for c in df.columns])).alias("line")).agg(
        F.lit(table_name).alias("table_name"), F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("sample")
    )


def _optional(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(label), value))


def table_documents(tables: DataFrame, columns: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One text per table for the search index: source, name, type, description,
    size, columns, sample rows, dates."""
    keys = ["connector", "database_name", "schema_name", "table_name"]
    note = F.coalesce(_optional(" - ", F.col("column_comment")), F.lit(""))
    line = F.concat(F.lit("  - "), "column_name", F.lit(" ("), "data_type", F.lit(")"), note)
    listed = columns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("listed"))
    joined = tables.join(listed, keys, "left")
    joined = joined.join(samples, "table_name", "left") if samples is not None else joined.withColumn("sample", F.lit(None).cast("string"))
    full = F.concat_ws(".", "database_name", "schema_name", "table_name")
    when = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("None"))
    document = F.concat_ws(
        "\n",
        F.concat(F.lit("DATA SOURCE: "), F.upper("connector")),
        F.concat(F.lit("TABLE: "), full),
        F.concat(F.lit("Type: "), F.col("table_type")),
        _optional("Description: ", F.col("table_comment")),
        F.when(F.col("row_count") > 0, F.concat(F.lit("Row Count: "), grouped(F.col("row_count")))),
        F.lit("\nCOLUMNS:"),
        F.when(F.size("listed") > 0, F.array_join(F.transform("listed", lambda c: c["line"]), "\n")),
        _optional("\nSAMPLE DATA:\n", F.col("sample")),
        F.concat(F.lit("\nCreated: "), when("created")),
        F.concat(F.lit("Last Modified: "), when("last_altered")),
    )
    return joined.select(
        "connector", F.col("schema_name").alias("schema"), "table_name", full.alias("full_name"), document.alias("document")
    )


def schema_fingerprint(tables: DataFrame) -> DataFrame:
    """(schema_name, table_name) rows -> one row per schema: its table names and
    count. ``table_name`` may be null for a schema without tables."""
    return tables.groupBy("schema_name").agg(
        F.sort_array(F.collect_set("table_name")).alias("tables"), F.count_distinct("table_name").alias("table_count")
    )


def fingerprint_totals(tables: DataFrame) -> DataFrame:
    """Snapshot row: schemas, tables per schema, totals."""
    per = schema_fingerprint(tables)
    return per.agg(
        F.sort_array(F.collect_list("schema_name")).alias("schemas"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("schema_name", "tables")))).alias("tables_per_schema"),
        F.count(F.lit(1)).alias("total_schemas"),
        F.sum("table_count").alias("total_tables"),
    )


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tables added or removed between two (schema_name, table_name) snapshots."""
    keys = ["schema_name", "table_name"]
    before, after = (d.select(*keys).distinct().withColumn(flag, F.lit(True)) for d, flag in ((old, "was"), (new, "is")))
    return (
        before.join(after, keys, "full_outer")
        .where("was is null or is is null")
        .select(*keys, F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"))
    )
