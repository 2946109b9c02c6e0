"""The pipeline's stages against the operators' rules, each on its own input."""

import collections

import corpus_pipeline
from test_operators import LONG, ODD, SCHEMA, check_packing, plain_classes

SF = "/root/testdata/sf0.001"


def through(spark, docs, tmp_path):
    """Each stage's input and output as rows, written and read as the driver does."""
    docs.write.parquet(f"{tmp_path}/in")
    now, seen = spark.read.parquet(f"{tmp_path}/in"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == corpus_pipeline.COLUMNS
        seen.append((name, now.collect(), after.collect()))
        now = after
    return seen


def test_stages(spark, tmp_path):
    quality, lines, near, mix, pack = through(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)
    given = {r.doc_id: r for r in quality[1]}
    assert all(given[r.doc_id] == r for r in quality[2])
    gone = set(given) - {r.doc_id for r in quality[2]}
    assert 0 < len(gone) < 0.2 * len(given)
    for r in lines[2]:
        assert r.n_chars == len(r.text)
    # one document of each class stays, the one with the smallest id
    classes = plain_classes([(r.doc_id, r.text) for r in near[1]], 5, 80)
    assert {r.doc_id for r in near[2]} == {i for i, (_, c) in classes.items() if i == c}
    kept = {r.doc_id: r for r in mix[1]}
    assert all(kept[r.doc_id] == r for r in mix[2])
    shares = collections.Counter(r.source for r in mix[2])
    assert set(shares) <= {r.source for r in mix[1]} and abs(len(mix[2]) - len(mix[1])) < 6 * len(mix[1]) ** 0.5
    n, total = check_packing(pack[2], pack[1], 2048)
    assert n <= 1.05 * -(-total // 2048) + 1


def test_odd_rows(spark, tmp_path):
    more = [(20 + i, f"some ordinary document number{i} " + " ".join(f"word{j}x{i * j % 97}" for j in range(40)), "en", None, 5) for i in range(8)]
    stages = through(spark, spark.createDataFrame(ODD + more, SCHEMA), tmp_path)
    assert all(LONG not in (r.text or "") for r in stages[0][2])  # it repeats itself
    check_packing(stages[4][2], stages[4][1], 2048)
    empty = through(spark, spark.createDataFrame([], SCHEMA), tmp_path / "none")
    assert all(not after for _, _, after in empty)
