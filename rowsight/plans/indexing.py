"""Index of a whole catalog in one call, and its history.

``build_index`` walks schemas, makes one document per table, and keeps the documents
and their vectors as a new version of an index folder. A table that can't be resolved
or read is reported and doesn't stop the others. Documents are compared by digest with
the version before: where none changed, no version is written and nothing is embedded
anew. Vectors depend on how often words occur in all documents, so a new version embeds
all of its documents.

Snapshots of a catalog are rows of an append-only table; any two of them, or all in
their order, are compared without a join between snapshots.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import union_all
from ..operators.search import build_index as with_vectors
from ..sources import catalog

log = logging.getLogger(__name__)

OUTCOME = "schema_name string, table_name string, status string, reason string"
#: tables whose documents are made in one job
BATCH = 20


@dataclass
class Entry:
    """A table of the walk: its rows, or why they can't be had."""

    schema: str | None
    name: str
    frame: DataFrame | None
    reason: str | None = None
    view: bool = False
    comment: str | None = None


def _reason(e: Exception) -> str:
    return (str(e).strip().splitlines() or [type(e).__name__])[0]


def walk(
    spark: SparkSession, schemas: list[str] | None = None, auto: bool | None = None, config: dict | None = None, connector: str = catalog.WAREHOUSE,
    exclude: tuple[str, ...] = (), include_views: bool = True, max_tables: int | None = None,
) -> list[Entry]:
    """Tables of the session catalog's chosen schemas (see ``catalog.select_schemas``), by name; ``max_tables`` per schema."""
    chosen = catalog.select_schemas(schemas, auto, config)
    if chosen is None:
        chosen = [r["schema_name"] for r in catalog.list_schemas(catalog.schemata(spark), connector, exclude).collect()]
    out = []
    for schema in chosen:
        try:
            found = sorted(spark.catalog.listTables(schema) if schema else spark.catalog.listTables(), key=lambda t: t.name)
        except PySparkException as e:
            out.append(Entry(schema, "", None, _reason(e)))
            continue
        found = [t for t in found if not (schema and t.isTemporary) and (include_views or t.tableType != "VIEW")]
        for t in found[:max_tables]:
            view = t.tableType in ("VIEW", "TEMPORARY")
            try:
                name = t.name if t.isTemporary or not schema else f"`{schema}`.`{t.name}`"
                out.append(Entry(schema, t.name, spark.table(name), None, view, t.description))
            except PySparkException as e:
                out.append(Entry(schema, t.name, None, _reason(e), view))
    return out


def documents(entries: list[Entry], database: str, connector: str = catalog.WAREHOUSE, sample_rows: int = 3, sizes: bool = True) -> DataFrame:
    """One document per table, in one job for all of them."""
    parts = []
    for e in entries:
        schema = e.schema or "default"
        tables = catalog.describe_tables({e.name: e.frame}, database, schema, connector, views=frozenset([e.name] if e.view else []), comments={e.name: e.comment}, sizes=sizes)
        columns = catalog.describe_columns({e.name: e.frame}, database, schema, connector)
        sample = catalog.sample_text(e.frame, e.name, sample_rows) if sample_rows and e.frame.columns else None
        parts.append(catalog.table_documents(tables, columns, sample))
    return union_all(parts)


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The index at ``path`` as of its latest version, or of the one asked for; None where there is none."""
    try:
        rows = spark.read.parquet(path)
    except PySparkException:
        return None
    wanted = F.lit(version) if version is not None else rows.agg(F.max("version")).scalar()
    return rows.where(F.col("version") == wanted)


def build_index(
    spark: SparkSession, entries: list[Entry], path: str, database: str, connector: str = catalog.WAREHOUSE, sample_rows: int = 3,
    recreate: bool = True, features: int = 256, sizes: bool = True,
) -> DataFrame:
    """Index the tables of a walk; returns (schema_name, table_name, status, reason).

    status is ``indexed`` (new or changed), ``unchanged`` or ``failed``. With ``recreate`` the new version
    holds these tables only; without it, tables indexed before stay, and a table that
    fails now keeps its earlier document. A rerun after a failure starts from the last
    whole version: a version counts once its write has committed. A walk without any
    readable table leaves the index as it is.
    """
    before = read_index(spark, path)
    failed = {(e.schema or "default", e.name): e.reason for e in entries if e.frame is None}
    open_ = [e for e in entries if e.frame is not None]
    kept: list[tuple] = []

    def collected(few: list[Entry]) -> None:
        # a document per table: names, columns and a few rows
        kept.extend(tuple(r) for r in documents(few, database, connector, sample_rows, sizes).collect())

    todo = [open_[start : start + BATCH] for start in range(0, len(open_), BATCH)]
    while todo:
        batch = todo.pop()
        try:
            collected(batch)
        except (PySparkException, Py4JError) as problem:
            if len(batch) > 1:  # halve it until the table that fails stands alone
                todo += [batch[: len(batch) // 2], batch[len(batch) // 2 :]]
                continue
            log.warning("skipped %s: %s", batch[0].name, problem)
            failed[batch[0].schema or "default", batch[0].name] = _reason(problem)
    made = spark.createDataFrame(kept, "connector string, schema string, table_name string, full_name string, document string")
    made = made.withColumn("digest", F.sha2("document", 256))
    names = made.columns
    if before is None:
        merged, same = made, set()
        gone = False
    else:
        old = {r["full_name"]: r["digest"] for r in before.select("full_name", "digest").collect()}
        new = {r["full_name"]: r["digest"] for r in made.select("full_name", "digest").collect()}
        same = {n for n, d in new.items() if old.get(n) == d}
        gone = recreate and bool(set(old) - set(new))
        merged = made if recreate else made.union(before.select(names).join(made.select("full_name"), "full_name", "left_anti").select(names))
    if kept and (before is None or gone or len(same) < len(kept)):
        version = 0 if before is None else before.agg(F.max("version")).first()[0] + 1
        with_vectors(merged, features).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)
    rows = [(schema, name, "unchanged" if full in same else "indexed", None) for _, schema, name, full, _ in kept]
    return spark.createDataFrame(rows + [(s, n, "failed", reason) for (s, n), reason in failed.items()], OUTCOME)


# ---- history of a catalog

SNAPSHOT = ("taken", "connector", "database_name", "schema_name", "table_name", "row_count", "bytes")


def record_snapshot(tables: DataFrame, path: str, taken: str) -> None:
    """Append the tables of a catalog as they were at ``taken`` (a timestamp as text)."""
    tables.withColumn("taken", F.lit(taken).cast("timestamp_ntz")).select(*SNAPSHOT).write.mode("append").parquet(path)


def as_of(snapshots: DataFrame, time: str) -> DataFrame:
    """The latest snapshot not after ``time``."""
    at = F.lit(time).cast("timestamp_ntz")
    latest = snapshots.where(F.col("taken") <= at).agg(F.max("taken")).scalar()
    return snapshots.where(F.col("taken") == latest)


def schema_history(snapshots: DataFrame) -> DataFrame:
    """(taken, schema_name, table_name, change): what each snapshot added or removed against the one before.

    Each table's snapshots are read in their order, so any number of snapshots costs one
    shuffle. Tables of the first snapshot are no change.
    """
    times = snapshots.select("taken").distinct()
    order = Window.orderBy("taken")  # one row per snapshot
    numbered = times.select("taken", F.row_number().over(order).alias("number"), F.lead("taken").over(order).alias("next"))
    seen = snapshots.select("schema_name", "table_name", "taken").distinct().join(numbered, "taken")
    own = Window.partitionBy("schema_name", "table_name").orderBy("number")
    steps = seen.withColumn("before", F.lag("number").over(own)).withColumn("after", F.lead("number").over(own))
    came = F.when((F.col("number") > 1) & (F.coalesce("before", F.lit(0)) < F.col("number") - 1), F.struct("taken", F.lit("added").alias("change")))
    went = F.when(F.col("next").isNotNull() & (F.coalesce("after", F.lit(-1)) != F.col("number") + 1), F.struct(F.col("next").alias("taken"), F.lit("removed").alias("change")))
    return steps.select("schema_name", "table_name", F.explode(F.array_compact(F.array(came, went))).alias("c")).select("c.taken", "schema_name", "table_name", "c.change")
