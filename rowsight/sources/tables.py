"""Scans: tables, files, queries and JDBC sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, types as T

from ..functions.identifiers import ALIASES

FORMATS = ("parquet", "orc", "csv", "json")


@dataclass(frozen=True)
class JdbcSource:
    """Where a connector's tables live. Split reads need a numeric, date or
    timestamp column and its bounds."""

    url: str
    driver: str | None = None
    partition_column: str | None = None
    lower_bound: str | None = None
    upper_bound: str | None = None
    partitions: int = 1
    fetch_size: int = 10_000
    options: dict = field(default_factory=dict)

    def read_options(self, dataset_id: str | None = None, query: str | None = None) -> dict[str, str]:
        o = {"url": self.url, "fetchsize": str(self.fetch_size), **self.options}
        if self.driver:
            o["driver"] = self.driver
        split = self.partition_column and self.partitions > 1
        if query and not split:
            o["query"] = query
        else:
            o["dbtable"] = f"({query}) source_query" if query else dataset_id
        if split:
            o |= {
                "partitionColumn": self.partition_column,
                "lowerBound": str(self.lower_bound),
                "upperBound": str(self.upper_bound),
                "numPartitions": str(self.partitions),
            }
        return o


def scan(
    spark: SparkSession,
    dataset_id: str | None = None,
    connector: str | None = None,
    query: str | None = None,
    limit: int | None = None,
    order_by: tuple[str, ...] = (),
    jdbc: dict[str, JdbcSource] | None = None,
) -> DataFrame:
    """Rows of a table or query.

    ``query`` overrides ``dataset_id`` and ignores ``limit``; a limit of None or
    0 means all rows. With ``connector`` the read goes through its JDBC source.
    """
    if connector is not None:
        kind = ALIASES.get(connector.lower(), connector.lower())
        if not jdbc or kind not in jdbc:
            raise ValueError(f"unknown connector {connector}")
        df = spark.read.format("jdbc").options(**jdbc[kind].read_options(dataset_id, query)).load()
    elif query:
        return spark.sql(query)
    else:
        df = _by_name(spark, dataset_id)
    if query or not limit:
        return df
    return (df.orderBy(*order_by) if order_by else df).limit(limit)


def _by_name(spark: SparkSession, dataset_id: str) -> DataFrame:
    if "/" in dataset_id:
        kind = dataset_id.rstrip("/").rsplit(".", 1)[-1].lower()
        kind = kind if kind in FORMATS else "parquet"
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        return reader.format(kind).load(dataset_id)
    return spark.table(dataset_id)


def try_scan(spark: SparkSession, dataset_id: str, **kw) -> tuple[DataFrame | None, str | None]:
    """(table, None) or (None, reason); a failed load is an error, never an empty table."""
    try:
        return scan(spark, dataset_id, **kw), None
    except (PySparkException, Py4JError, ValueError) as e:
        first = str(e).strip().splitlines()
        return None, first[0] if first else type(e).__name__


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
