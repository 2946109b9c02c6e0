import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowsight.operators import nearest, search


def vectors(spark, n, key, seed, kind="bigint"):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 8))
    v[n // 2 :] = v[n // 2]  # half of all rows are the same vector
    rows = [(i if kind == "bigint" else f"t{i:04d}", [float(x) for x in r]) for i, r in enumerate(v)]
    return v, spark.createDataFrame(rows, f"{key} {kind}, embedding array<double>")


def brute(a, b, n):
    d = ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
    return {i: [(int(j), round(float(d[i, j]), 9)) for j in np.lexsort((np.arange(len(b)), d[i]))[:n]] for i in range(len(a))}


@pytest.mark.parametrize("block_bytes", [64 << 20, 700])
def test_nearest(spark, block_bytes):
    a, requests = vectors(spark, 30, "request_id", 1)
    b, items = vectors(spark, 90, "item_id", 2)
    odd = spark.createDataFrame([(900, None), (901, []), (902, [1.0]), (903, [float("nan")] * 8), (904, [None] * 8)], "item_id bigint, embedding array<double>")
    got = {}
    found = nearest.nearest(requests.repartition(4), items.union(odd).repartition(5), 7, block_bytes=block_bytes)
    for r in found.orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append((r.item_id, round(r.distance, 9)))
    assert got == brute(a, b, 7)


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,0)"])
def test_a_block_that_no_request_visits(spark, kind):
    """Keys of any type; a slice of requests and a block of items far from it make a group without rows."""
    key = {"string": lambda c: F.concat(F.lit("t"), c.cast("string")), "date": lambda c: F.date_add(F.lit("2020-01-01"), c.cast("int"))}.get(kind, lambda c: c.cast(kind))
    place = F.array((F.col("id") % 4 * 1000 + F.col("id") / 1000).cast("double"), F.lit(1.0))
    items = spark.range(400).select(key(F.col("id")).alias("item_id"), place.alias("embedding"))
    requests = spark.range(3).select(key(F.col("id") * 4).alias("request_id"), place.alias("embedding")).where("embedding[0] < 1")
    index = nearest.cell_index(items, block_bytes=2000)
    assert (index.first + index.parts).max() > 1
    got = nearest.search(requests, index, 5)
    assert dict(got.dtypes)["item_id"] == kind and got.groupBy("request_id").count().where("count = 5").count() == requests.count() > 0
    assert got.where("distance >= 1").count() == 0


@pytest.mark.parametrize("metric", ["sqeuclidean", "cosine"])
def test_cells_are_skipped_and_nothing_is_lost(spark, metric, tmp_path):
    """Clustered items, equal distances, a cell above the size of a block, lengths without a centre, an index read back."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 6)) * 10
    b = np.concatenate([middles[rng.integers(0, 12, 500)] + rng.normal(size=(500, 6)) * 0.1, np.repeat(middles[:1], 300, axis=0)])
    a = np.concatenate([middles + 0.05, rng.normal(size=(10, 6)) * 10, middles[:1]])
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)] + [(9000 + i, [float(i)] * 2) for i in range(3)], "item_id bigint, embedding array<double>")
    requests = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(99, [1.0, 1.0])], "request_id bigint, embedding array<double>")
    index = nearest.cell_index(items, metric=metric, block_bytes=4000, cells=20, path=f"{tmp_path}/cells")
    assert index.parts.max() > 1
    got = {}
    for r in nearest.search(requests, index, 9).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append(r.item_id)
    unit = (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)) if metric == "cosine" else (lambda x: x)
    want = brute(unit(a), unit(b), 9)
    if metric == "sqeuclidean":
        assert {k: v for k, v in got.items() if k != 99} == {k: [i for i, _ in v] for k, v in want.items()}
    else:  # copies differ by rounding only: the same distances
        for k, v in want.items():
            assert np.allclose(sorted(((unit(a)[k] - unit(b)[got[k]]) ** 2).sum(1)), [d for _, d in v], atol=1e-8)
    if metric == "sqeuclidean":
        assert got[99] == [9001, 9000, 9002]
    assert len(got[99]) == 3


@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e20])
def test_kernel_in_single_precision_finds_what_doubles_do(scale):
    """Near ties within the rounding of floats, more equal vectors than asked for, a bound, vectors of any size."""
    rng = np.random.default_rng(3)
    b = rng.normal(size=(9000, 16))
    b[4000:6000] = b[100] + rng.normal(size=(2000, 16)) * 1e-9
    a = np.concatenate([b[100:101], rng.normal(size=(700, 16))])
    a, b = a * scale, b * scale
    r, i, d = nearest.best(a, b, np.arange(len(b))[::-1].copy(), 6, "sqeuclidean")
    for q in (0, 1, 350, 700):
        exact = ((b - a[q]) ** 2).sum(1)
        want = np.lexsort((-np.arange(len(b)), exact))[:6]
        assert i[r == q].tolist() == want.tolist() and d[r == q].tolist() == exact[want].tolist()
    bound = np.full(len(a), np.median(d))
    r2, i2, d2 = nearest.best(a, b, np.arange(len(b))[::-1].copy(), 6, "sqeuclidean", bound)
    inside = d <= np.median(d)
    assert np.array_equal(r2, r[inside]) and np.array_equal(i2, i[inside]) and np.array_equal(d2, d[inside])


def test_a_search_of_one_block_is_dealt_to_many_groups(spark):
    """Requests are dealt too: a small index is no single task for all requests, not even if they are all the same."""
    vector = F.array(*[((F.col("id") * k) % 97).cast("double") for k in (1, 3, 7)])
    items = spark.range(300).select(F.col("id").alias("item_id"), vector.alias("embedding"))
    for wanted in (vector, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))):
        requests = spark.range(9000).select(F.col("id").alias("request_id"), wanted.alias("embedding"))
        found = nearest.nearest(requests, items, 4)
        dealt = re.findall(r"RepartitionByExpression \[__block#\d+L?, __slice#\d+L?\], (\d+)", found._jdf.queryExecution().toString())
        assert dealt and all(int(x) > 4 for x in dealt)
        assert found.count() == 36000


def test_cosine(spark):
    requests = spark.createDataFrame([(1, [2.0, 0.0])], "request_id bigint, embedding array<double>")
    items = spark.createDataFrame([(1, [0.0, 3.0]), (2, [5.0, 0.0])], "item_id bigint, embedding array<double>")
    got = [(r.item_id, round(r.distance, 9)) for r in nearest.nearest(requests, items, 2, metric="cosine").orderBy("rank").collect()]
    assert got == [(2, 0.0), (1, 1.0)]


def test_preferred_connector(spark):
    keywords = spark.createDataFrame(
        [("prod_sales", "snowflake", 1), ("prod", "snowflake", 2), ("sales", "postgres", 3), ("stage", "postgres", 4)],
        "keyword string, connector string, first int",
    )
    asked = {
        1: ("tables in Postgres prod", "postgres"), 2: ("stage prod", "postgres"), 3: ("all products", "snowflake"),
        4: ("the staging area", "postgres"), 5: ("nothing", None), 6: ("wholesales figures", "postgres"),
    }
    rows = [(k, t) for k, (t, _) in asked.items()]
    got = search.preferred_connector(spark.createDataFrame(rows, "request_id bigint, text string"), keywords)
    assert {r.request_id: r.preferred for r in got.collect()} == {k: w for k, (_, w) in asked.items()}


def test_long_texts_and_many_keywords(spark):
    """A 33,000-character request, a word that most requests hold, odd texts: against plain search."""
    rng = np.random.default_rng(8)
    letters = list("abcde_ ")
    names = sorted({"".join(rng.choice(list("abcde_"), rng.integers(3, 9))) for _ in range(400)})
    known = [(k, "snowflake" if i % 3 else "postgres", int(p)) for i, (k, p) in enumerate(zip(names, rng.permutation(len(names))))]
    texts = ["".join(rng.choice(letters, n)) for n in (33_000, 50, 9, 9, 7, 4)] + [names[7] + " x", "Hot " + names[3].upper()] * 20 + ["", None, "é " + names[5], names[4] + "\n" + names[2]]
    requests = spark.createDataFrame(list(enumerate(texts)), "request_id bigint, text string")
    got = {r.request_id: r.preferred for r in search.preferred_connector(requests, spark.createDataFrame(known, "keyword string, connector string, first int")).collect()}
    by_name = {k: (p, c) for k, c, p in known}
    for i, text in enumerate(texts):
        low = (text or "").lower()
        words = [w for w in low.replace("_", " ").split() if w in by_name]
        parts = sorted(by_name[k] for k in names if k in low)
        want = by_name[words[0]][1] if words else parts[0][1] if parts else None
        assert got[i] == want, (i, text and text[:50])
    assert search.preferred_connector(requests, spark.createDataFrame([], "keyword string, connector string, first int")).where("preferred IS NOT NULL").count() == 0


def test_keyword_map_last_writer(spark):
    sources = spark.createDataFrame([(1, "snowflake", "PROD_SALES"), (2, "postgres", "stage_sales")], "source_no int, connector string, database string")
    index = spark.createDataFrame([("LIVE_HUB.A.T", "snowflake"), ("live_db.a.t", "postgres")], "full_name string, connector string")
    got = {r.keyword: r.connector for r in search.keyword_map(sources, index).collect()}
    assert got["sales"] == "postgres" and got["production"] == "snowflake" and got["live"] == "postgres" and got["live_hub"] == "snowflake"


def test_pool_is_cut_before_boosts(spark):
    """A table outside the nearest pool stays out however well its name matches."""
    rows = [(f"db.s.t{i}", f"t{i}", "postgres", [float(i), 0.0]) for i in range(12)] + [("db.s.orders", "orders", "snowflake", [50.0, 0.0])]
    index = spark.createDataFrame(rows, "full_name string, table_name string, connector string, embedding array<double>")
    requests = spark.createDataFrame([(1, "orders orders orders in snowflake", [0.0, 0.0])], "request_id bigint, text string, embedding array<double>")
    keywords = spark.createDataFrame([("zzz", "postgres", 1)], "keyword string, connector string, first int")
    got = search.search_tables(requests, index, keywords, min_relevance=-1e9).collect()
    assert "orders" not in {r.table_name for r in got} and len(got) == 3
