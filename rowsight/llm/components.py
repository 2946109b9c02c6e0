"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from rowsight.llm.shared import forget, settled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node that each node reaches: columns ``node``, ``component``.

    Star contraction: in each round every node and all its neighbours are hung on the
    smallest of them, until no edge changes; then each node hangs on the smallest
    node of its component. The number of rounds grows with the logarithm of the
    longest chain. Minima fold before the shuffle, so a node with very many edges
    costs one record per task there; adaptive execution may split the join back.
    Null ends and loops are left out. An empty table gives an empty result.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("real")).where("real").select("u", "v").distinct()
    last, before = None, None
    while True:
        now, state = _observed(now)
        if before is not None:
            forget(before)
        if state == last:
            break
        last, before = state, now
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = hung.where("u <> v").distinct()
    # each component's smallest node has no edge up
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _observed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, settled, and a digest of them as a set."""
    seen = Observation()
    mark = F.xxhash64("u", "v")
    kept = settled(edges.observe(seen, F.count("*").alias("n"), F.sum(mark.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftright(mark, 32)).alias("high")))
    found = seen.get
    return kept, (found["n"], found["low"], found["high"])
