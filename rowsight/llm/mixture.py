"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the corpus over its actual
share. Each document draws its number of copies by inverting the Poisson
distribution of its source's rate at a uniform number hashed from its id, so a rerun
or a lost executor gives the same copies. Copies are dealt out by a hash and sorted
by it: a global shuffle without a sort across partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowsight.functions.scalars import col, digest, digest_number
from rowsight.llm.shared import free_name, settled

#: sources whose rates may be broadcast; beyond, rates are joined by shuffle
MOST_SOURCES = 10_000
#: a larger rate is drawn as the sum of several draws, so that exp(-rate) stays a normal number
LARGEST_RATE = 256.0


def rates(docs: DataFrame, source: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, n, rate): rate = target share / actual share of documents.

    Without ``weights`` all sources present get equal shares. With them, shares are
    relative to the weights of the sources present; others get rate 0.
    """
    counts = docs.groupBy(col(source).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        listed = F.map_from_arrays(F.array(*[F.lit(k) for k in weights]), F.array(*[F.lit(float(v)) for v in weights.values()])) if weights else F.lit(None)
        weight = F.coalesce(listed[F.coalesce("source", F.lit(""))], F.lit(0.0)) if weights else F.lit(0.0)
    weighted = settled(counts.withColumn("weight", weight))
    totals = weighted.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))  # one row
    share = F.col("weight") * F.col("all_n") / (F.col("all_weight") * F.col("n"))
    return weighted.join(F.broadcast(totals)).select("source", "n", F.when(F.col("weight") > 0, share).otherwise(0.0).alias("rate"))


def with_distribution(rates: DataFrame) -> DataFrame:
    """Adds ``draws`` and ``cdf``, the cumulative probabilities of 0, 1, 2, ... up to where they reach 1 in double precision."""
    mean = F.col("rate") / F.col("draws")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * mean / k)).alias("cdf")),
    )
    return rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE)).cast("int")).withColumn("cdf", step["cdf"])


def uniform(keys: list[Column], salt: str) -> Column:
    return digest_number(digest(keys, salt)) / F.lit(float(1 << 52))


def replicate(docs: DataFrame, id_col: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, seed: int = 11, copy: str = "copy", order: str = "shuffle_key") -> DataFrame:
    """Each document as often as drawn, in random order: the columns of ``docs``, the copy's number and its place key.

    Rows that repeat an id draw the same number each. A null source is a source; a
    null id draws one number for all rows without one. Sources without weight and
    documents that draw 0 are absent. An empty table gives an empty result.
    ``copy`` and ``order`` get underscores if ``docs`` has such columns.
    """
    copy, order, cdf, draws, name = (free_name(docs, x) for x in (copy, order, "__cdf", "__draws", "__source"))
    table = settled(with_distribution(rates(docs, source, weights)).where("rate > 0").select(F.col("source").alias(name), F.col("draws").alias(draws), F.col("cdf").alias(cdf)))
    if len(table.select(name).limit(MOST_SOURCES + 1).collect()) <= MOST_SOURCES:
        table = F.broadcast(table)
    ids = [col(id_col)]
    joined = docs.join(table, col(source).cast("string").eqNullSafe(F.col(name)))
    one = F.size(F.filter(F.col(cdf), lambda c: c <= uniform(ids, f"{seed}:1")))
    several = F.aggregate(
        F.sequence(F.lit(1), F.col(draws)), F.lit(0),
        lambda s, k: s + F.size(F.filter(F.col(cdf), lambda c: c <= digest_number(F.md5(F.concat_ws(":", ids[0].cast("string"), F.lit(str(seed)), k.cast("string")))) / F.lit(float(1 << 52)))),
    )
    n = F.when(F.col(draws) == 1, one).otherwise(several)
    counted = joined.withColumn(cdf, n).where(F.col(cdf) > 0)
    copies = counted.select(*[col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(cdf))).alias(copy))
    placed = copies.withColumn(order, digest_number(digest([*ids, F.col(copy)], f"{seed}:order")))
    return placed.repartition(F.col(order)).sortWithinPartitions(order)
