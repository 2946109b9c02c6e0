import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest

from rowsight.operators import duplicates, nulls, outliers, quantiles, statistics
from rowsight.operators.quantiles import exact_quantiles


def by_column(df):
    return {r.column_name: r.asDict() for r in df.collect()}


def close(a, b):
    return (a is None and (b is None or math.isnan(b))) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def test_describe_parity(spark):
    """All classes against pandas: ties, NaN, all-null, id suffix, bool, date, timestamp."""
    rng = random.Random(7)
    rows = [
        (
            i % 17, rng.choice([1.5, -2.0, None, float("nan"), 1e9]), rng.choice(["b", "a", None]), rng.random() < 0.6,
            dt.date(2024, 1, 1 + i % 3), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=37 * i), None, f"r{i}",
        )
        for i in range(240)
    ]
    df = spark.createDataFrame(rows, "n int, x double, s string, ok boolean, d date, t timestamp_ntz, gone string, row_id string")
    got = by_column(statistics.column_profile(df, "t"))
    pdf = pd.DataFrame(rows, columns=df.columns)
    for c in ("n", "x"):
        want = pdf[c].astype(float).describe()
        for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert close(float(got[c][ours]), float(want[theirs])), (c, ours)
    for c in ("s", "ok", "d", "row_id"):
        want = pdf[c].astype(object).describe()
        assert (got[c]["count"], got[c]["unique"], got[c]["freq"]) == (want["count"], want["unique"], want["freq"])
    assert got["ok"]["top"] in ("True", "False")
    assert got["row_id"]["top"] == "r0" and got["row_id"]["type_class"] == "categorical"
    assert (got["gone"]["count"], got["gone"]["unique"], got["gone"]["top"], got["gone"]["freq"]) == (0, 0, None, None)
    assert got["t"]["type_class"] == "temporal" and got["t"]["std"] is None
    want = pd.to_datetime(pdf["t"]).describe()
    for ours, theirs in (("ts_mean", "mean"), ("ts_min", "min"), ("ts_p25", "25%"), ("ts_p50", "50%"), ("ts_max", "max")):
        assert abs((got["t"][ours] - want[theirs].to_pydatetime()).total_seconds()) < 1e-3


def test_quantiles_against_numpy(spark):
    """Values that stress every level: wide magnitudes, hot values, close neighbours."""
    rng = np.random.default_rng(3)
    sets = [
        np.concatenate([np.full(2000, 5.0), rng.normal(0, 1, 1000), [1e300, -1e300, 5e-324, 0.0, -0.0]]),
        1.0 + np.arange(3000) * 2.0**-50,
        rng.choice([-3.0, 7.0], 999),
        np.array([42.0]),
        1.7e15 + rng.integers(0, 10**12, 2500).astype(float),
    ]
    rows = [(i, float(v)) for i, s in enumerate(sets) for v in s]
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    names = [f"q{i}" for i in range(len(probs))]
    got = {r.ordinal: r for r in exact_quantiles(spark.createDataFrame(rows, "ordinal int, v double"), probs, names).collect()}
    for i, s in enumerate(sets):
        for p, name in zip(probs, names):
            assert close(got[i][name], float(np.quantile(s, p))), (i, p)


def test_one_row_and_empty(spark):
    one = spark.createDataFrame([(1.0, "a")], "x double, s string")
    got = by_column(statistics.column_profile(one, "t"))
    assert got["x"]["std"] is None and got["x"]["mean"] == 1.0 and got["s"]["top"] == "a"
    none = by_column(statistics.column_profile(one.where("false"), "t"))
    assert none["x"]["count"] == 0 and none["x"]["mean"] is None and none["s"]["unique"] == 0
    assert duplicates.check_duplicates(one.where("false"), "t").first().duplicate_percentage == 0.0
    with pytest.raises(ValueError):
        statistics.profile(one.select())


@pytest.mark.filterwarnings("ignore")
def test_infinities_against_pandas(spark):
    inf = float("inf")
    for values in ([1.0, inf, inf, inf], [-inf, 1.0, 2.0, inf], [-inf, -inf, 3.0], [0.1 * i + 0.3 for i in range(1, 7)], [inf], [1.0, 2.0, inf]):
        got = by_column(statistics.column_profile(spark.createDataFrame([(v,) for v in values], "x double"), "t"))["x"]
        want = pd.Series(values).describe()
        for ours, theirs in (("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
            w = None if np.isnan(want[theirs]) else want[theirs]
            assert got[ours] == w, (values, ours, got[ours], w)


def test_infinities(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,), (float("-inf"),), (3.0,)], "x double")
    got = by_column(statistics.column_profile(df, "t"))["x"]
    assert (got["p50"], got["min"], got["max"], got["mean"], got["std"]) == (2.0, float("-inf"), float("inf"), None, None)


def test_decimal_class(spark):
    df = spark.sql("SELECT CAST(1.50 AS DECIMAL(10,2)) AS price")
    assert by_column(statistics.column_profile(df, "t"))["price"]["type_class"] == "numeric"
    assert by_column(statistics.column_profile(df, "t", decimal_as="categorical"))["price"]["top"] == "1.50"


def test_duplicates(spark):
    rows = [(1, None, float("nan")), (1, None, float("nan")), (1, "a", None), (None, "a", 0.0), (None, "a", -0.0), (2, "b", 1.0)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    got = duplicates.check_duplicates(df, "t").first()
    assert (got.total_rows, got.duplicate_qty, got.status, got.duplicate_percentage) == (6, 2, "failure", 33.33)
    clean = duplicates.check_duplicates(spark.range(50).selectExpr("id", "id % 3 AS k"), "t").first()
    assert (clean.duplicate_qty, clean.status) == (0, "success")


def test_shifted_nulls_are_no_copies(spark):
    df = spark.sql("SELECT * FROM VALUES (NULL, 'a', array(NULL, 1)), ('a', NULL, array(1, NULL)), ('a', '', array(1)), ('', 'a', array(1)), ('1:', '-', array()), (NULL, 'a', array(NULL, 1)) AS t(x, y, z)")
    assert duplicates.check_duplicates(df, "t").first().duplicate_qty == 1
    times = spark.sql("SELECT array(timestamp_ntz'2024-01-01 00:00:00.000001') AS t UNION ALL SELECT array(timestamp_ntz'2024-01-01 00:00:00.000002')")
    assert duplicates.check_duplicates(times, "t").first().duplicate_qty == 0


def test_long_integers(spark):
    df = spark.createDataFrame([("9223372036854775807",), ("-9223372036854775808",), ("0000000000000000000000012",)], "a string")
    assert outliers.type_check(df, "t").first().fits_type == "bigint"
    big = spark.createDataFrame([("9223372036854775808",)], "a string")
    assert outliers.type_check(big, "t").first().fits_type == "double"


def test_map_and_variant_rows(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, parse_json('{\"x\": 1}') AS v UNION ALL SELECT map('b', 2, 'a', 1), parse_json('{\"x\": 1}')")
    assert duplicates.check_duplicates(df, "t").first().duplicate_qty == 1
    assert by_column(statistics.column_profile(df, "t"))["m"]["count"] == 2


def test_placeholders_case_and_odd_names(spark):
    df = spark.createDataFrame([("NULL", 1.0), ("Null", float("nan")), (" ", None), ("", 2.0)], "`a.b` string, `it's` double")
    got = {r.column_name: (r.null_count, r.null_percentage) for r in nulls.check_nulls(df, "t's").collect()}
    assert got == {"a.b": (2, 50.0), "it's": (2, 50.0)}
    assert nulls.normalize_nulls(df).where("`a.b` is null").count() == 2


def test_wide_table(spark):
    df = spark.range(20).selectExpr(*[f"CASE WHEN id % 2 = 0 THEN id + {i} END AS c{i}" for i in range(150)])
    assert nulls.null_summary(df, "t").first().columns_with_nulls == 150
    assert statistics.numeric_profile(df, "t").count() == 150


def test_type_check(spark):
    df = spark.createDataFrame([("1", "2024-01-01"), ("-20", "2024-02-30"), ("3.5", None)], "a string, b string")
    got = {r.column_name: r for r in outliers.type_check(df, "t").collect()}
    assert (got["a"].integer_count, got["a"].number_count, got["a"].fits_type) == (2, 3, "double")
    assert (got["b"].date_count, got["b"].fits_type, got["b"].mixed) == (1, "string", True)


def test_column_quantiles_against_numpy(spark):
    """Above the size where brackets come from sketches: hot values, wide magnitudes, close neighbours, few values, none."""
    rng = np.random.default_rng(4)
    n = 60_000
    data = {
        "hot": np.where(rng.random(n) < 0.4, 5.0, rng.normal(0, 1, n)), "wide": np.exp(rng.normal(0, 200, n)), "near": 1.0 + rng.permutation(n) * 2.0**-50,
        "two": rng.choice([-3.0, 7.0], n), "some": np.where(rng.random(n) < 0.9999, np.nan, rng.random(n)), "none": np.full(n, np.nan), "sorted": np.arange(n) * 1.0,
        "ends": np.concatenate([[-np.inf, np.inf], rng.random(n - 2)]),
    }
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(13)
    probs = (0.0, 0.0001, 0.25, 0.5, 0.75, 0.9999, 1.0)
    names = [f"q{i}" for i in range(len(probs))]
    numbers = {i: f"nullif({c}, CAST('NaN' AS DOUBLE))" for i, c in enumerate(data)}
    got = {r.ordinal: r for r in quantiles.column_quantiles(df, numbers, probs, names).collect()}
    for i, (c, values) in enumerate(data.items()):
        values = values[~np.isnan(values)]
        assert (i in got) == bool(len(values))
        for p, name in zip(probs, names) if len(values) else ():
            want = float(np.quantile(values, p))
            assert close(got[i][name], want) if math.isfinite(want) else got[i][name] == want or math.isnan(got[i][name]), (c, p)
    assert quantiles.column_quantiles(df.where("false"), numbers, probs, names).count() == 0


def test_mode_among_long_values(spark):
    start = "https://example.com/" + "x" * 60
    rows = [(start + "b", "k"), (start + "b", "l"), (start + "a", "m"), (start + "a", None), (start + "c", ""), ("zz", ""), (None, "é" * 80)]
    got = by_column(statistics.column_profile(spark.createDataFrame(rows, "s string, t string"), "t"))
    assert (got["s"]["unique"], got["s"]["top"], got["s"]["freq"]) == (4, start + "a", 2)
    assert (got["t"]["unique"], got["t"]["top"], got["t"]["freq"]) == (5, "", 2)


def test_duplicates_are_values_not_texts(spark):
    """Instants in the hour that clocks repeat, shifted nulls, collations, signed zeros."""
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        twice = spark.sql("SELECT timestamp_seconds(1730622600 + 3600 * id) AS t FROM range(2)")
        nested = twice.selectExpr("array(t) AS a", "named_struct('t', t) AS s", "map('k', t) AS m")
        assert [duplicates.duplicate_counts(d).first().duplicate_qty for d in (twice, nested, twice.union(twice), nested.union(nested))] == [0, 0, 2, 2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    nulls_ = spark.createDataFrame([(None, 1), (1, None), (None, None), (None, None)], "a int, b int")
    assert duplicates.duplicate_counts(nulls_).first().duplicate_qty == 1
    parts = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("", "abc"), (None, "abc")], "a string, b string")
    assert duplicates.duplicate_counts(parts).first().duplicate_qty == 0
    assert duplicates.duplicate_counts(spark.sql("SELECT x COLLATE UTF8_LCASE AS s FROM VALUES ('a'), ('A'), ('b') AS t(x)")).first().duplicate_qty == 1
    assert duplicates.duplicate_counts(spark.sql("SELECT explode(array(0.0D, -0.0D, double('NaN'), NULL)) AS x")).first().duplicate_qty == 2
    elements = spark.sql("SELECT explode(array(array(1, NULL), array(NULL, 1), array(1), array(1, NULL))) AS x")
    assert duplicates.duplicate_counts(elements).first().duplicate_qty == 1
