"""Importance resampling towards a target: documents drawn by how much their n-grams
look like those of a target table.

Every text is translated through one 256-byte table (A-Z to lower case, ASCII other
than letters and digits to blanks, bytes of multi-byte characters as they are), split
at blanks, and its runs of 1 to ``order`` words are hashed: the CRC-32 of a longer run
continues that of the run before it, so no n-gram is ever joined as a string. Counters
fold the hashes of a task before anything is shuffled; corpus and target are then two
arrays of ``buckets`` counts, and the log ratio of their smoothed shares is a bucket's
gain. A document's weight is the mean gain of its features; Gumbel noise seeded by its
id turns weights into a draw without replacement, the highest scores first.

Only the arrays of gains (a parameter's size) are broadcast. The draw needs no sort of
all documents: counts per score give the lowest score that can be drawn, and only rows
from there on are ordered, by ranges.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window, functions as F

from rowsight.functions.scalars import col
from rowsight.llm.shared import bounded_batches, free_name, settled
from rowsight.llm.words import slices

#: lower-cases A-Z and blanks all ASCII but letters and digits; other bytes belong to words
TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
#: distinct hashes that a task holds before it emits their counts
FLUSH = 1 << 20


def hashes(text: bytes, order: int) -> tuple[int, list[Iterator[int] | list[int]]]:
    """The number of words, and for each length up to ``order`` the CRC-32 of all runs of words."""
    words = text.translate(TABLE).split()
    levels = [list(map(zlib.crc32, words))]
    if order > 1:
        spaced = [b" " + w for w in words]
        for n in range(1, order):
            levels.append(list(map(zlib.crc32, spaced[n:], levels[-1])))
    return len(words), levels


def bucket_counts(texts: DataFrame, text_col: str, order: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def counts() -> pa.RecordBatch:
            at = np.fromiter(seen.keys(), np.int64, len(seen)) % buckets
            n = np.fromiter(seen.values(), np.int64, len(seen))
            sums = np.zeros(buckets, np.int64)
            np.add.at(sums, at, n)
            used = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["bucket", "n"])

        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                if text:
                    for level in hashes(text, order)[1]:
                        seen.update(level)
            if len(seen) > FLUSH:
                yield counts()
                seen.clear()
        yield counts()

    rows = texts.select(col(text_col).cast("binary").alias("text")).mapInArrow(task, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, target over corpus, rounded down."""
    buckets = len(corpus)
    s_all, t_all = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(seed: int, key: str) -> int:
    """Thousandths of a Gumbel draw that depends on the key alone, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, order: int, seed: int, keep: list[str]) -> DataFrame:
    """(*keep, __words, __features, __weight, __score) of each row; no score without an id."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    n_kept = len(keep)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches, n_kept + 1):
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(n_kept + 1).to_pylist()):
                if text:
                    n_words, levels = hashes(text, order)
                    at = np.fromiter((h for level in levels for h in level), np.int64, sum(map(len, levels))) % len(table)
                    out[:, i] = n_words, len(at), int(table[at].sum()) // len(at) if len(at) else 0
            keys = batch.column(n_kept).to_pylist()
            score = pa.array([None if k is None else w + noise(seed, k) for k, w in zip(keys, out[2].tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_kept], *map(pa.array, out), score], names=[*batch.schema.names[:n_kept], "__words", "__features", "__weight", "__score"]
            )

    rows = docs.select(*map(col, keep), col(id_col).cast("string").alias("__key"), col(text_col).cast("binary").alias("__text"))
    schema = rows.drop("__key", "__text").schema
    for name in ("__words", "__features", "__weight", "__score"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(task, schema)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, order: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Each row of ``docs`` (columns ``keep``, all by default) with n_words, n_features, weight, score and rank.

    rank is 1, 2, 3 ... for the ``percent`` of the rows with ``min_words`` words or more
    that are drawn (rounded down), by falling score, ties to the smaller id; null for the
    others. Null and empty texts have no features and weight 0. Rows that repeat an
    id share its noise, and take ranks of their own; rows without id have no score and
    aren't drawn, nor do they count. An empty target gives all features the gain of an
    unseen one; an empty table gives an empty result. Where ``docs`` has a column of a
    result's name, the result's name gets underscores.
    """
    bounded_batches(docs.sparkSession)
    keep = [id_col, *(c for c in keep or docs.columns if c != id_col)]
    gain = gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, target_text, order, buckets))
    taken = docs.select(*map(col, keep))
    able = F.coalesce(F.col("__score").isNotNull() & (F.col("__words") >= min_words), F.lit(False))
    seen = Observation()
    rows = settled(scored(docs, gain, id_col, text_col, order, seed, keep).observe(seen, F.count_if(able).alias("n")))
    wanted = percent * seen.get["n"] // 100
    # distinct scores are thousandths of logarithms: tens of thousands, however many rows
    per_score = rows.where(able).groupBy("__score").agg(F.count("*").alias("n"))
    reach = per_score.select("__score", F.sum("n").over(Window.orderBy(F.desc("__score"))).alias("reach")).where(F.col("reach") >= max(1, wanted))
    lowest = reach.agg(F.max("__score")).first()[0]
    high = able & (F.col("__score") >= F.lit(lowest)) if wanted else F.lit(False)
    # places: sorted by ranges, then numbered by counts per range; the row's place in the table settles what ties are left
    order_by = [F.desc("__score"), col(id_col).asc(), F.col("__row").asc()]
    ranged = rows.where(high).withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = settled(ranged.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    parts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = parts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    rank = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.join(before, "__part").withColumn("__rank", F.when(rank <= wanted, rank))
    names = {"__words": "n_words", "__features": "n_features", "__weight": "weight", "__score": "score", "__rank": "rank"}
    columns = [*map(col, keep), *(F.col(a).alias(free_name(taken, b)) for a, b in names.items())]
    return ranked.select(*columns).union(rows.where(~high).withColumn("__rank", F.lit(None).cast("bigint")).select(*columns))
