"""Near vectors against brute force, and on odd rows."""

import math

import numpy as np
import pytest

from rowsight.llm import projections

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, threshold=0.95):
    """{(id, n_links, component)} as a sorted list, a row for each distinct (id, vector)"""
    rows = list({(i, None if v is None else tuple(v)): None for i, v in rows if i is not None})
    able = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for size in {len(rows[k][1]) for k in able}:
        mine = [k for k in able if len(rows[k][1]) == size]
        x = np.array([rows[k][1] for k in mine], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                links[mine[a]].add(mine[b])
    least, seen = {}, set()
    for k in links:
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                new = links[todo.pop()] - group
                group |= new
                todo += new
            seen |= group
            low = min(rows[j][0] for j in group)
            least.update(dict.fromkeys(group, low))
    return sorted((rows[k][0], len(links[k]), least[k]) for k in links)


def planted(n, seed=3):
    """Vectors without clusters, pairs at all distances near the threshold, a chain, a dense group, exact copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 32))

    def beside(v, cosine):
        v = v / np.linalg.norm(v)
        away = rng.normal(size=len(v))
        away -= away @ v * v
        return cosine * v + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away)

    pairs = [beside(x[i], c) for i, c in zip(range(n // 10), np.resize(np.linspace(0.94, 0.999, 23), n // 10))]
    chain = [x[-1]]
    for _ in range(40):
        chain.append(beside(chain[-1], 0.97))
    group = [x[-2] / np.linalg.norm(x[-2]) + rng.normal(size=32) * 0.02 for _ in range(400)]
    loose = [beside(x[-3], 0.975) for _ in range(200)]
    copies = [x[-4]] * 30 + [x[-4] * 2] * 5
    every = np.array([*x, *pairs, *chain, *group, *loose, *copies], np.float32)
    order = rng.permutation(len(every))
    return [(i, v) for i, v in enumerate(every[order].tolist())]


@pytest.mark.parametrize("block", [64, 2048])
def test_against_brute_force(spark, block):
    rows = planted(3000)
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = projections.near_vectors(vectors, block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]),
        (9, [1.0, 1.0, 0.0]), (10, [1.0, -1.0]), (10, [-1.0, 1.0]), (11, [1e-38, 1e-38]), (12, [1e38, 1e38]), (13, [1.0, 1.0]), (14, [-0.0, 1.0]), (15, [0.0, 1.0]),
    ]
    for schema in (SCHEMA, SCHEMA.replace("float", "double")):
        vectors = spark.createDataFrame(rows, schema)
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in projections.near_vectors(vectors).collect())
        assert got == plain([(i, v if v is None or nan not in v else [None]) for i, v in rows])
        assert projections.near_vectors(vectors.limit(0)).count() == 0


def test_passes_grow_with_the_table():
    few, many = (projections.passes_for(n, 0.95, 2048, 1e-5) for n in (10_000, 1_000_000_000))
    assert 5 <= few < many < 120
