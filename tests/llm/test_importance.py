"""Importance resampling against a plain restatement, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from rowsight.llm import importance, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, order):
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = WORD.findall(lowered)
    return words, [zlib.crc32(b" ".join(words[i : i + n])) % 10000 for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def plain(docs, targets, order=1, percent=10):
    """rows of (doc_id, n_features, weight, score, rank)"""
    found = [(i, *features(text, order)) for i, text in docs]
    s = Counter(b for _, _, f in found for b in f)
    t = Counter(b for text in targets for b in features(text, order)[1])
    s_all, t_all = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))

    rows = []
    for i, words, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    ranks = {r[0]: n + 1 for n, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((*r[:4], ranks.get(r[0])) for r in rows)


def test_query(spark):
    docs = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    targets = [r[0] for r in queries.table(spark, SF, "benchmark").select("text").collect()]
    got = sorted(tuple(r) for r in queries.op12_importance_resampling(spark, SF).collect())
    assert got == plain(docs, targets)


def test_longer_runs_continue_the_hash(spark):
    docs = [(i, f"w{i % 7} Alpha-beta {i % 3} gamma, é{i % 5} " * 6) for i in range(40)]
    targets = ["alpha beta 1 gamma", None, ""]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    rows = importance.resample(frame, target, percent=30, order=3).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, rows)) == plain(docs, targets, order=3, percent=30)


def test_table_is_the_stated_class():
    every = bytes(range(256))
    assert every.translate(importance.TABLE).split() == WORD.findall(every.lower())


def test_odd_rows(spark):
    long = "some words of a long text " * 50_000
    rows = [(1, None, 5), (2, "", 5), (3, "\x00 ,.;", 5), (4, long, 5), (None, long, 5), (6, long, 6), (6, long, 7), (6, long, 7), (7, "a " * 19, 5), (8, "B c " * 10, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = importance.resample(docs, docs.limit(0), percent=50).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id != 6}
    assert [by_id[i].n_features for i in (1, 2, 3, 4, 7, 8)] == [0, 0, 0, 300_000, 19, 20]
    assert by_id[1].weight == by_id[2].weight == by_id[3].weight == 0
    assert by_id[None].score_ is None and by_id[None]["rank"] is None and by_id[7]["rank"] is None
    assert sorted(r.score for r in got) == sorted(r[2] for r in rows)  # the table's own column is kept
    # rows that repeat an id share its noise and take ranks of their own
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    assert len({r.score_ for r in got if r.doc_id == 6}) == 1
    assert importance.resample(docs.limit(0), docs).count() == 0


@pytest.mark.parametrize("percent", [0, 100])
def test_all_or_none(spark, percent):
    docs = spark.createDataFrame([(i, "same words in all of them " * 5) for i in range(300)], "doc_id bigint, text string").repartition(7)
    ranks = sorted(r["rank"] for r in importance.resample(docs, docs, percent=percent).collect() if r["rank"])
    assert ranks == list(range(1, 3 * percent + 1))
