"""Near copies among vectors by sorted projection passes.

In each pass every vector gets the signs of its products with random directions,
concatenated to one sortable number; vectors in the order of these numbers are cut into
blocks, and each block is compared with itself and the next one in double precision.
Pairs at or above the threshold are links. No list of pairs is made: a window gives
each of its vectors one link, to the smallest vector that links lead to inside the
window, and the links of all passes are united to components. The number of passes
follows from the number of vectors, so that a pair right at the threshold is missed in
all passes with a chance below ``miss``.

How many vectors each one links with is then counted inside components, and so is exact
there even where a window held only a part: members are packed into blocks, pairs of
blocks whose centres and radii already tell are counted as a whole or left out, and
only the others are compared. What is shuffled grows with blocks, not with pairs.

Vectors that are equal byte for byte are one node with its number of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, functions as F, types as T

from rowsight.functions.scalars import col
from rowsight.llm.components import components
from rowsight.llm.shared import bounded_batches, settled

SEED = 13
#: random hashes of a pass and their bits; together they fit into 63 bits
HASHES, BITS = 5, 12
#: a squared distance of unit vectors that is safely rounding and not meaning
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec, raw, digest) of each distinct (id, vector) that can link: float32 or float64
    bytes of the vector, as stored, and their 128-bit hash."""
    kind = vectors.schema[vector_col].dataType.elementType
    double = not isinstance(kind, T.FloatType)
    rows = vectors.select(col(id_col).cast("bigint").alias("vec"), col(vector_col).cast("array<double>" if double else "array<float>").alias("v"))
    rows = rows.where(F.col("vec").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy() + 0.0, lists.offsets.to_numpy() - lists.offsets[0].as_py()  # + 0.0: one zero
            raw = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(map(xxhash.xxh3_128_digest, raw), pa.binary())], names=["vec", "raw", "digest"])

    return rows.mapInArrow(task, "vec bigint, raw binary, digest binary").distinct()


def _units(raw: list[bytes], dtype: type) -> np.ndarray:
    """Directions in double precision of vectors of one length."""
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def passes_for(n: int, threshold: float, block: int, miss: float) -> int:
    """Passes after which a pair at the threshold has met with a chance of 1 - ``miss``.

    A pair surely meets in a pass when it shares the first log2(n / block) signs: then
    no more than about a block's number of vectors lies between the two.
    """
    same = 1 - math.acos(threshold) / math.pi
    met = same ** max(1.0, math.log2(max(1, n) / block) + 1)
    return math.ceil(math.log(miss) / math.log(1 - min(met, 0.999)))


def _links(x: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, smallest number that links lead to from i) for rows of a window whose first ``n`` are compared with all."""
    s = x[:n] @ x.T >= threshold
    s[np.arange(n), np.arange(n)] = False
    rows, columns = np.flatnonzero(s.any(axis=1)), np.flatnonzero(s.any(axis=0))
    s = s[np.ix_(rows, columns)]
    label = np.arange(len(x))
    while len(rows):
        before = label.copy()
        label[rows] = np.minimum(label[rows], np.where(s, label[columns][None, :], len(x)).min(axis=1))
        label[columns] = np.minimum(label[columns], np.where(s, label[rows][:, None], len(x)).min(axis=0))
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(len(x)))
    return at, label[at]


def window_links(nodes: DataFrame, passes: range, threshold: float, block: int, double: bool, n: int) -> DataFrame:
    """Links (a, b) that the windows of some passes give over ``n`` nodes (node, raw).

    Ranges hold many blocks each; the last block of a range and the first one of the
    next meet in a window of their own.
    """
    dtype = np.float64 if double else np.float32

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                kept = [raw[i] for i in mine]
                x = _units(kept, dtype)
                for p in passes:
                    signs = x @ np.random.default_rng([SEED, p]).normal(size=(x.shape[1], HASHES * BITS)) > 0
                    place = (signs.astype(np.int64) << np.arange(HASHES * BITS - 1, -1, -1)).sum(axis=1)
                    m = len(mine)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, p, np.int32)), pa.array(np.full(m, size, np.int32)), pa.array(place), pa.array([ids[i] for i in mine], pa.binary()), pa.array(kept, pa.binary())],
                        names=["run", "size", "place", "node", "raw"],
                    )

    out = ["part", "side", "run", "size", "a", "b", "nodes", "raws"]
    schema = "part int, side int, run int, size int, a binary, b binary, nodes array<binary>, raws array<binary>"

    def linked(ids: list, raw: list, first: int) -> Iterator[pa.RecordBatch]:
        at, to = _links(_units(raw, dtype), first, threshold)
        if len(at):
            none = pa.nulls(len(at), pa.int32())
            lists = pa.nulls(len(at), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([ids[i] for i in at], pa.binary()), pa.array([ids[i] for i in to], pa.binary()), lists, lists], names=out)

    def border(part: int, side: int, key: tuple, rows: tuple[list, list]) -> pa.RecordBatch:
        none = pa.nulls(1, pa.binary())
        lists = [pa.array([r], pa.list_(pa.binary())) for r in rows]
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (part, side, *key)), none, none, *lists], names=out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, starting = TaskContext.get().partitionId(), True  # inside the first run of the range
        key, ids, raw, last = None, [], [], ([], [])

        def finish(end: bool) -> Iterator[pa.RecordBatch]:
            # what is left is compared with itself and with the block before it
            if key is None:
                return
            rest = last[0] + ids, last[1] + raw
            yield from linked(*rest, len(rest[0]))
            if starting and not last[0]:
                yield border(part, 0, key, rest)
            if end:
                yield border(part, 1, key, (rest[0][-block:], rest[1][-block:]))

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for k, i, r in zip(keys, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if k != key:
                    yield from finish(False)
                    starting, key, ids, raw, last = key is None, k, [], [], ([], [])
                ids.append(i), raw.append(r)
                if len(ids) == block:
                    if last[0]:
                        yield from linked(last[0] + ids, last[1] + raw, block)
                    elif starting:
                        yield border(part, 0, key, (ids, raw))
                    last, ids, raw = (ids, raw), [], []
        yield from finish(True)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, left_raw, right, right_raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                yield from linked(left + right, left_raw + right_raw, len(left))

    coded = nodes.select("node", "raw").mapInArrow(code, "run int, size int, place bigint, node binary, raw binary")
    ranges = max(1, n * len(passes) // (4 * block))
    dealt = coded.repartitionByRange(ranges, "run", "size", "place", "node").sortWithinPartitions("run", "size", "place", "node")
    found = settled(dealt.select("run", "size", "node", "raw").mapInArrow(compare, schema))
    ends = found.where("side = 1").select((F.col("part") + 1).alias("part"), "run", "size", F.col("nodes").alias("l"), F.col("raws").alias("lr"))
    starts = found.where("side = 0").select("part", "run", "size", F.col("nodes").alias("r"), F.col("raws").alias("rr"))
    met = ends.join(starts, ["part", "run", "size"]).select("l", "lr", "r", "rr").mapInArrow(stitch, schema)
    return settled(found.where("a IS NOT NULL").select("a", "b").union(met.select("a", "b")).distinct())


def link_counts(members: DataFrame, threshold: float, block: int, double: bool) -> DataFrame:
    """(node, linked): rows that each node of (component, node, n, raw) links with, its own copies and itself included."""
    dtype = np.float64 if double else np.float32
    near = 2 - 2 * threshold  # squared distance at the threshold

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        key = None

        def packed() -> pa.RecordBatch:
            x = _units([h[2] for h in held], dtype)
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
            values = [part << 32 | number, key[0], sum(h[1] for h in held), [h[0] for h in held], [h[1] for h in held], [h[2] for h in held], centre.tobytes(), radius]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, fields)], schema=fields)

        fields = pa.schema([("block", pa.int64()), ("component", pa.binary()), ("rows", pa.int64()), ("nodes", pa.list_(pa.binary())), ("ns", pa.list_(pa.int64())), ("raws", pa.list_(pa.binary())), ("centre", pa.binary()), ("radius", pa.float64())])
        for batch in batches:
            for c, i, n, r in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and ((c, len(r)) != key or len(held) == block):
                    yield packed()
                    held, number = [], number + 1
                key = c, len(r)
                held.append((i, n, r))
        if held:
            yield packed()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(i, j, all): pairs of blocks that are wholly linked or have to be compared."""
        for batch in batches:
            i, j, all_ = [], [], []
            for a, b, ca, cb, ra, rb in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if len(ca) != len(cb):
                    continue
                far = math.sqrt(((np.frombuffer(ca) - np.frombuffer(cb)) ** 2).sum())
                if max(0.0, far - ra - rb) ** 2 > near + SLACK:
                    continue
                i.append(a), j.append(b), all_.append((far + ra + rb) ** 2 < near - SLACK)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(all_, pa.bool_())], names=["i", "j", "all"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, linked = [], []
            for ids, raw, other, ns in zip(*(batch.column(k).to_pylist() for k in range(4))):
                s = _units(raw, dtype) @ _units(other, dtype).T >= threshold
                nodes += ids
                linked.append(s @ np.array(ns, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(np.concatenate(linked) if linked else [], pa.int64())], names=["node", "linked"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block with itself; a vector always counts its own copies."""
        for batch in batches:
            nodes, linked = [], []
            for ids, raw, ns in zip(*(batch.column(k).to_pylist() for k in range(3))):
                x = _units(raw, dtype)
                s = x @ x.T >= threshold
                np.fill_diagonal(s, True)
                nodes += ids
                linked.append(s @ np.array(ns, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(np.concatenate(linked) if linked else [], pa.int64())], names=["node", "linked"])

    # by their first components near vectors of a large component share a block more often than by chance
    dealt = members.repartitionByRange("component", "raw", "node").sortWithinPartitions("component", "raw", "node")
    blocks = settled(dealt.select("component", "node", "n", "raw").mapInArrow(pack, "block bigint, component binary, rows bigint, nodes array<binary>, ns array<bigint>, raws array<binary>, centre binary, radius double"))
    a, b = (blocks.select("component", *(F.col(c).alias(s + c) for c in ("block", "centre", "radius"))) for s in "ab")
    met = a.join(b, "component").where("ablock <> bblock").select("ablock", "bblock", "acentre", "bcentre", "aradius", "bradius")
    pairs = settled(met.mapInArrow(told, "i bigint, j bigint, all boolean"))
    counts = "node binary, linked bigint"
    inside = blocks.select("nodes", "raws", "ns").mapInArrow(own, counts)
    left = blocks.select(F.col("block").alias("i"), "nodes", "raws")
    right = blocks.select(F.col("block").alias("j"), F.col("raws").alias("others"), "ns")
    compared = pairs.where("NOT all").join(left, "i").join(right, "j").select("nodes", "raws", "others", "ns").mapInArrow(compare, counts)
    sums = pairs.where("all").join(blocks.select(F.col("block").alias("j"), "rows"), "j").groupBy("i").agg(F.sum("rows").alias("linked"))
    whole = sums.join(left, "i").select(F.explode("nodes").alias("node"), "linked")
    return inside.union(compared).union(whole).groupBy("node").agg(F.sum("linked").alias("linked"))


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block: int = 2048, miss: float = 1e-5, at_once: int = 4,
) -> DataFrame:
    """Links by cosine of at least ``threshold``: id_col, n_links, component_id, kept, passes.

    A row for each distinct (id, vector). n_links: other rows linked directly, copies
    included; component_id: the smallest id that links lead to, its own included; kept: it is that
    one. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different length. Rows without id are left out, rows that
    repeat an id and vector count once. An empty table gives an empty result.

    ``at_once`` passes share a shuffle. A component of m near copies that don't share a tight ball
    costs (m / ``block``) ** 2 comparisons of blocks.
    """
    bounded_batches(vectors.sparkSession)
    double = not isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    rows = settled(usable(vectors, id_col, vector_col))
    seen = Observation()
    nodes = settled(rows.groupBy("digest", "raw").agg(F.count("*").alias("n"), F.min("vec").alias("least")).withColumnRenamed("digest", "node").observe(seen, F.count("*").alias("n")))
    n = seen.get["n"]
    passes = passes_for(n, threshold, block, miss)
    links = None
    for start in range(0, passes, at_once):
        found = window_links(nodes, range(start, min(passes, start + at_once)), threshold, block, double, n)
        links = found if links is None else links.union(found)
    joined = settled(components(links))
    members = joined.join(nodes, "node")
    smallest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    counted = link_counts(members.select("component", "node", "n", "raw"), threshold, block, double)
    in_groups = counted.join(joined, "node").join(smallest, "component").select("node", "linked", "component_id")
    classes = nodes.select("node", "n", "least").join(in_groups, "node", "left")
    classes = classes.select(F.col("node").alias("digest"), (F.coalesce("linked", "n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    # one row for each digest; adaptive execution splits the copies of a hot one
    able = rows.select("vec", "digest").join(classes, "digest").select("vec", "n_links", "component_id")
    all_ = vectors.select(col(id_col).cast("bigint").alias("vec"), col(vector_col).alias("v")).where("vec IS NOT NULL")
    v = F.col("v")
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    unable = all_.where(F.coalesce(bad, F.lit(True))).select("vec", F.lit(0).cast("bigint").alias("n_links"), F.col("vec").alias("component_id")).distinct()
    out = able.union(unable)
    return out.select(F.col("vec").alias(id_col), "n_links", "component_id", (F.col("vec") == F.col("component_id")).alias("kept"))
