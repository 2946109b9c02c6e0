"""Index of a catalog, file sizes, history of schemas."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rowsight.plans import indexing
from rowsight.sources import catalog


@pytest.fixture
def shop(spark, tmp_path):
    """Two schemas of the session catalog; one table's file is damaged, another's folder is gone."""
    for schema in ("shop_a", "shop_b", "shop_empty"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema} LOCATION '{tmp_path}/{schema}'")
    spark.range(7).selectExpr("id", "concat('v', id) AS name").write.saveAsTable("shop_a.items", format="parquet", path=f"{tmp_path}/items")
    spark.range(3).write.saveAsTable("shop_b.dents", format="parquet", path=f"{tmp_path}/dents")
    for file in os.listdir(tmp_path / "dents"):
        if file.endswith(".parquet"):
            (tmp_path / "dents" / file).write_bytes(b"no parquet at all")
    spark.sql("CREATE VIEW shop_b.seen AS SELECT id FROM shop_a.items")
    spark.sql("CREATE VIEW shop_b.stale AS SELECT id, name FROM shop_a.items")
    yield tmp_path
    for schema in ("shop_a", "shop_b", "shop_empty"):
        spark.sql(f"DROP DATABASE {schema} CASCADE")


def outcome(df):
    return {(r.schema_name, r.table_name): r.status for r in df.collect()}


def test_index_of_a_catalog(spark, shop):
    path = f"{shop}/index"
    chosen = ["shop_a", "shop_b", "shop_empty", "not_there"]
    entries = indexing.walk(spark, chosen)
    got = indexing.build_index(spark, entries, path, "hub")
    want = {("shop_a", "items"): "indexed", ("shop_b", "dents"): "failed", ("shop_b", "seen"): "indexed", ("shop_b", "stale"): "indexed", ("not_there", ""): "failed"}
    assert outcome(got) == want
    assert all(r.reason for r in got.collect() if r.status == "failed")
    index = {r.table_name: r for r in indexing.read_index(spark, path).collect()}
    assert set(index) == {"items", "seen", "stale"} and len(index["items"].embedding) == 256
    assert "Row Count: 7" in index["items"].document and '"name":"v' in index["items"].document and "Type: VIEW" in index["seen"].document

    # nothing changed: no new version; a changed table: one more
    again = outcome(indexing.build_index(spark, indexing.walk(spark, chosen), path, "hub"))
    assert again == {k: "unchanged" if v == "indexed" else v for k, v in want.items()}
    assert sorted(x for x in os.listdir(path) if x.startswith("version")) == ["version=0"]
    spark.range(1).selectExpr("id", "'w' AS name").write.insertInto("shop_a.items")
    third = outcome(indexing.build_index(spark, indexing.walk(spark, ["shop_a"]), path, "hub", recreate=False))
    assert third == {("shop_a", "items"): "indexed"}
    index = {r.table_name: r.document for r in indexing.read_index(spark, path).collect()}
    assert set(index) == {"items", "seen", "stale"} and "Row Count: 8" in index["items"]
    assert "Row Count: 7" in {r.table_name: r.document for r in indexing.read_index(spark, path, 0).collect()}["items"]
    indexing.build_index(spark, indexing.walk(spark, ["shop_a"]), path, "hub")  # these tables only
    assert [r.table_name for r in indexing.read_index(spark, path).collect()] == ["items"]
    assert indexing.read_index(spark, f"{shop}/none") is None


def test_walk_options(spark, shop):
    assert [(e.schema, e.name) for e in indexing.walk(spark, ["shop_b"], include_views=False)] == [("shop_b", "dents")]
    assert [e.name for e in indexing.walk(spark, ["shop_b"], max_tables=2)] == ["dents", "seen"]
    every = {e.schema for e in indexing.walk(spark, auto=True, exclude=("shop_a",))}
    assert "shop_b" in every and "shop_a" not in every
    assert outcome(indexing.build_index(spark, [], f"{shop}/nothing", "hub")) == {}


def test_sizes_are_those_of_the_files(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(f"{tmp_path}/t")
    files = [os.stat(tmp_path / "t" / f) for f in os.listdir(tmp_path / "t") if f.endswith(".parquet")]
    frames = {"t": spark.read.parquet(f"{tmp_path}/t"), "made": spark.range(4).toDF("x")}
    got = {r.table_name: r for r in catalog.list_tables(catalog.describe_tables(frames, "d", "s")).collect()}
    assert got["t"].row_count == 1000 and got["t"].bytes == sum(f.st_size for f in files)
    when = [dt.datetime.fromtimestamp(f.st_mtime, dt.timezone.utc).replace(tzinfo=None) for f in files]
    assert abs(got["t"].created - min(when)) < dt.timedelta(seconds=1) and abs(got["t"].last_altered - max(when)) < dt.timedelta(seconds=1)
    assert (got["made"].row_count, got["made"].bytes, got["made"].created) == (4, None, None)
    uncounted = catalog.describe_tables(frames, "d", "s", count_rows=False).where("table_name = 't'").first()
    assert uncounted.row_count is None and uncounted.bytes == got["t"].bytes


def test_snapshots(spark, tmp_path):
    def tables(*names):
        rows = [("c", "d", n.split(".")[0], n.split(".")[1], "BASE TABLE", 1, None, None, None, None) for n in names]
        return spark.createDataFrame(rows, catalog.TABLES)

    path = f"{tmp_path}/snapshots"
    for day, names in (("2025-01-01", ["a.x", "a.y"]), ("2025-01-02", ["a.y", "b.x"]), ("2025-01-04", ["a.x", "a.y", "b.x"]), ("2025-01-05", ["a.x", "b.x"])):
        indexing.record_snapshot(tables(*names), path, day)
    kept = spark.read.parquet(path)
    held = indexing.as_of(kept, "2025-01-03")
    assert sorted((r.schema_name, r.table_name) for r in held.collect()) == [("a", "y"), ("b", "x")]
    assert indexing.as_of(kept, "2024-12-31").count() == 0
    changes = sorted((r.taken.day, f"{r.schema_name}.{r.table_name}", r.change) for r in indexing.schema_history(kept).collect())
    assert changes == [(2, "a.x", "removed"), (2, "b.x", "added"), (4, "a.x", "added"), (5, "a.y", "removed")]
    diff = catalog.schema_diff(indexing.as_of(kept, "2025-01-01"), indexing.as_of(kept, "2025-01-05"))
    assert sorted((f"{r.schema_name}.{r.table_name}", r.change) for r in diff.collect()) == [("a.y", "removed"), ("b.x", "added")]
    assert indexing.schema_history(kept.where(F.lit(False))).count() == 0


def test_columns_come_with_their_tables_rows(spark, tmp_path):
    from rowsight.fixtures import TABLES
    from suite import queries

    for n, name in enumerate(TABLES):
        spark.range(n).selectExpr("id AS a", "CAST(id AS STRING) AS b").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.schema_name, r.table_name, r.ordinal, r.column_name, r.row_count) for r in queries.list_columns(spark, str(tmp_path)).collect()}
    assert got == {(queries.SCHEMA_OF.get(t, "sales"), t, i, c, n) for n, t in enumerate(TABLES) for i, c in ((1, "a"), (2, "b"))}
