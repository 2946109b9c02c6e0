"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Vectors that are equal up to length are one node of the graph, with the smallest ids
of its class, so that a vector with many copies costs one node and its copies are
still found. The graph starts from a few random projections: nodes sorted by their
sign pattern are cut into blocks of bounded size, and each block gives its nodes
their best neighbours. Then NN-descent: each round joins every node with its
neighbours and the nodes that have it as theirs, compares the neighbours of a node
with each other, and keeps the best found. Searches start at a node's own neighbours
and repeatedly expand the best candidates that are not expanded yet, for all queries in one
set of joins per round, with beams that grow until measured recall is enough. No node
is measured twice for a query (but once more where beams outgrow ``POOL``).

Candidates meet vectors in blocks of bounded size; no task sees all vectors and
nothing is broadcast but the projections, whose size is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, functions as F

from rowsight.llm.shared import forget, settled

SEED = 5


def _matrix(column, width: int | None = None, dtype=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec, unit): direction of each usable vector as float64 bytes; others are left out.

    Left out: null ids and vectors, empty ones, null or non-finite components, length zero.
    """
    v = F.col(vector_col).cast("array<double>")
    usable = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("bigint").alias("vec"), v.alias("v"))
    usable = usable.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = [], []
            for i, v in enumerate(batch.column(1).to_pylist()):
                x = np.array(v)
                most = np.abs(x).max()
                if most > 0:
                    x = x / most  # no overflow or underflow of squares
                    rows.append(i)
                    units.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(units, pa.binary())], names=["vec", "unit"])

    return usable.mapInArrow(task, "vec bigint, unit binary")


def classes(units: DataFrame, k: int) -> DataFrame:
    """(node, unit, members): one row for each distinct direction, with its k + 1 smallest ids.

    More can't be among k nearest: copies are equally near and ties go to smaller ids.
    """
    few = units.distinct().selectExpr("unit", "vec", "row_number() OVER (PARTITION BY unit ORDER BY vec) AS r").where(f"r <= {k + 1}")
    return few.groupBy("unit").agg(F.array_sort(F.collect_list("vec")).alias("members")).select(F.get("members", F.lit(0)).alias("node"), "unit", "members")


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers and values of the k largest of each row."""
    k = min(k, sims.shape[1])
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return at, np.take_along_axis(sims, at, 1)


def projected(nodes: DataFrame, k: int, trees: int, bits: int, block: int) -> DataFrame:
    """Edges (a, b, sim) to the best ``k`` of each node's block, for each of ``trees`` random orders.

    Order: sign pattern of ``bits`` projections (Gray code, so that neighbouring
    patterns differ in one sign), then one more projection. Cut every ``block`` rows of a partition.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dtype=np.float64)
            for t in range(trees):
                p = x @ np.random.default_rng([SEED, t]).normal(size=(x.shape[1], bits + 1))
                gray = ((p[:, :bits] > 0) << np.arange(bits)).sum(axis=1)
                shift = 1
                while shift < bits:
                    gray ^= gray >> shift
                    shift <<= 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(gray * 4.0 + np.tanh(p[:, bits])), batch.column(0), pa.array([v.astype(np.float32).tobytes() for v in x], pa.binary())], names=["tree", "place", "node", "unit"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(tree, ids, x):
            for a in range(0, len(ids), block):
                i, v = ids[a : a + block], x[a : a + block]
                if len(i) < 2:
                    continue
                s = v @ v.T
                np.fill_diagonal(s, -2)
                at, sims = _best(s, k)
                keep = np.flatnonzero((sims > -2).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, at.shape[1])[keep]), pa.array(i[at].ravel()[keep]), pa.array(sims.ravel()[keep].astype(np.float32))], names=["a", "b", "sim"])

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))))
            trees_, ids, x = (np.concatenate(c) for c in zip(*held))
            # whole blocks of the tree that is being read; the rest waits for more rows
            for t in np.unique(trees_[:-1]) if len(trees_) > 1 else ():
                mine = trees_ == t
                n = mine.sum() if t != trees_[-1] else mine.sum() // block * block
                yield from edges(t, ids[mine][:n], x[mine][:n])
                mine[np.flatnonzero(mine)[n:]] = False
                trees_, ids, x = trees_[~mine], ids[~mine], x[~mine]
            held = [(trees_, ids, x)]
        for trees_, ids, x in held:
            for t in np.unique(trees_):
                yield from edges(t, ids[trees_ == t], x[trees_ == t])

    coded = nodes.select("node", "unit").mapInArrow(code, "tree int, place double, node bigint, unit binary")
    # equal places order by id, so that a rerun makes the same blocks
    dealt = coded.repartitionByRange("tree", "place", "node").sortWithinPartitions("tree", "place", "node").select("tree", "node", "unit")
    return dealt.mapInArrow(compare, "a bigint, b bigint, sim float")


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each node: (a, near) with near sorted arrays of (sim, b, fresh)."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    ranked = once.selectExpr("*", "row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r").where(f"r <= {k}")
    return ranked.select("a", "b", "sim", "fresh")


def descent(nodes: DataFrame, start: DataFrame, k: int, sample: int, rounds: int) -> DataFrame:
    """NN-descent from ``start``: edges (a, b, sim), the ``k`` best known of each node.

    A round takes up to ``sample`` fresh and ``sample`` other neighbours of each node,
    its own and those that name it, chosen by a hash; all fresh ones are compared with
    each other and with the others. Sampling is part of the method: neighbours left
    out come up in a later round. It ends when a round changes fewer than 1 % of the
    edges, or after ``rounds``.
    """
    edges = settled(_top(start.withColumn("fresh", F.lit(True)), k))
    half = nodes.select(F.col("node").alias("b"), "unit")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dtype=np.float64).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["b", "unit"])

    half = settled(half.mapInArrow(small, "b bigint, unit binary"))

    def local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_out, b_out, s_out = [], [], []
            for group in batch.column(0).to_pylist():
                ids = np.array([g["b"] for g in group], np.int64)
                fresh = np.array([g["fresh"] for g in group], bool)
                worst = np.array([g["worst"] for g in group], np.float32)
                x = np.frombuffer(b"".join(g["unit"] for g in group), np.float16).reshape(len(ids), -1).astype(np.float32)
                s = x @ x.T
                use = (fresh[:, None] | fresh[None, :]) & (s > worst[:, None])
                np.fill_diagonal(use, False)
                i, j = np.nonzero(use)
                a_out.append(ids[i]), b_out.append(ids[j]), s_out.append(s[i, j])
            if a_out:
                a, b, s = (np.concatenate(o) for o in (a_out, b_out, s_out))
                # the same pair comes up at many nodes: once per batch is enough, and only each node's best
                order = np.lexsort((b, -s, a))
                a, b, s = a[order], b[order], s[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                a, b, s = a[new], b[new], s[new]
                first = np.searchsorted(a, a)
                best = np.arange(len(a)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(a[best]), pa.array(b[best]), pa.array(s[best])], names=["a", "b", "sim"])

    for number in range(rounds):
        both = edges.select("a", "b", "fresh").union(edges.select("b", "a", "fresh"))
        draw = F.xxhash64("a", "b", F.lit(number))
        once = both.groupBy("a", "b").agg(F.max("fresh").alias("fresh")).withColumn("draw", draw)
        picked = once.selectExpr("*", "row_number() OVER (PARTITION BY a, fresh ORDER BY draw) AS r").where(f"r <= {sample}").select("a", "b", "fresh")
        picked = settled(picked)
        worst = edges.groupBy("a").agg(F.when(F.count("*") == k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst")).withColumnRenamed("a", "b")
        # nodes without a fresh neighbour have nothing to compare
        active = picked.groupBy("a").agg(F.max("fresh").alias("any")).where("any").select("a")
        met = picked.join(active, "a", "left_semi").join(half.join(worst, "b"), "b")
        groups = met.groupBy("a").agg(F.collect_list(F.struct("b", "fresh", "worst", "unit")).alias("group")).select("group")
        found = groups.mapInArrow(local_join, "a bigint, b bigint, sim float").withColumn("fresh", F.lit(True))
        # edges that took part are no longer fresh
        used = picked.where("fresh").select("a", "b", F.lit(True).alias("was_used"))
        aged = edges.join(used, ["a", "b"], "left").select("a", "b", "sim", (F.col("fresh") & F.col("was_used").isNull()).alias("fresh"))
        changes = Observation()
        merged = _top(aged.union(found.select("a", "b", "sim", "fresh")), k)
        before, edges = edges, settled(merged.observe(changes, F.count_if("fresh").alias("fresh"), F.count("*").alias("n")))
        forget(before), forget(picked)
        if changes.get["fresh"] < 0.01 * changes.get["n"]:
            break
    return edges.select("a", "b", "sim")


def graph(nodes: DataFrame, k: int = 20, trees: int = 6, bits: int = 6, block: int = 1024, sample: int = 10, rounds: int = 12, backward: int = 20) -> DataFrame:
    """(node, near): each node's ``k`` neighbours and up to ``backward`` nodes that have it as theirs."""
    edges = settled(descent(nodes, projected(nodes, k, trees, bits, block), k, sample, rounds))
    back = edges.selectExpr("b AS a", "a AS b", "row_number() OVER (PARTITION BY b ORDER BY sim DESC, a) AS r").where(f"r <= {backward}").select("a", "b")
    return settled(edges.select("a", "b").union(back).groupBy("a").agg(F.collect_set("b").alias("near")).withColumnRenamed("a", "node"))


#: a search keeps so many of the best nodes it measured, if its beam is not wider: a beam made wider takes them up
POOL = 2048
NO_IDS = "CAST(array() AS array<bigint>)"
#: states that are read at once: each holds all nodes that its query has measured
ROWS = 64
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
STATE = "query bigint, unit binary, pool array<struct<sim: double, node: bigint, done: boolean>>, dropped array<bigint>, todo array<bigint>"


def _lists(column: pa.Array) -> tuple:
    """Values of all lists, one behind the other (numbers as numpy), and where each list begins and the last one ends."""
    values = column.values
    return (values if pa.types.is_nested(values.type) else values.to_numpy(zero_copy_only=False)), column.offsets.to_numpy()


def _listed(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    values = np.concatenate([np.zeros(0, kind), *parts])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(values))


def _place(nodes: np.ndarray, n_blocks: int) -> np.ndarray:
    """The block of each node, by a mix of all bits of its id."""
    x = nodes.astype(np.uint64)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(n_blocks)).astype(np.int64)


def begun(queries: DataFrame) -> DataFrame:
    """The state of searches that have measured nothing: each starts at its query's own ``node``.

    State: (query, unit, pool, dropped). The pool holds the best nodes measured as (sim, node, done), best first, done
    if expanded; dropped are the nodes measured that did not stay in it. A sim below -2.5 is not measured.
    """
    pool = F.array(F.struct(F.lit(-3.0).alias("sim"), "node", F.lit(False).alias("done")))
    return queries.select("query", "unit", pool.alias("pool"), F.expr(NO_IDS).alias("dropped"))


def search(nodes: DataFrame, near: DataFrame, state: DataFrame, beam: int = 64, expand: int = 32, block: int = 4096, rounds: int = 40) -> DataFrame:
    """The state after greedy search with this ``beam`` from ``state`` on, which may be that of a narrower search.

    The beam is the best ``beam`` nodes of the pool. Each round expands the best ``expand`` nodes of each query's
    beam that are not expanded yet; it ends when no beam has any, or after ``rounds``. A node is measured once for a query.
    """
    n_blocks = max(1, -(-nodes.count() // block))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(batch.column(0).to_numpy(), n_blocks)), *batch.columns], names=["block", "node", "unit"])

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block that holds nodes a query has reached and not measured."""
        for batch in batches:
            query, unit = batch.column(0).to_numpy(), batch.column(1)
            (reached, r), (pool, p), (dropped, d) = (_lists(batch.column(i)) for i in (2, 3, 4))
            rows, blocks, parts = [], [], []
            for i in range(len(query)):
                new = np.setdiff1d(reached[r[i] : r[i + 1]], np.concatenate([pool[p[i] : p[i + 1]], dropped[d[i] : d[i + 1]]]))
                at = _place(new, n_blocks)
                order = np.argsort(at, kind="stable")
                own, starts = np.unique(at[order], return_index=True)
                rows += [i] * len(own)
                blocks.append(own)
                parts += np.split(new[order], starts[1:]) if len(own) else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks)), pa.array(query[rows]), unit.take(pa.array(rows)), _listed(parts)], names=["block", "query", "unit", "nodes"])

    def measure(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("node").to_numpy()
        order = np.argsort(ids)
        x = _matrix(left.column("unit"), dtype=np.float64)[order] if len(ids) else None
        ids = ids[order]
        nodes_, sims = [], []
        wanted, at = _lists(right.column("nodes").combine_chunks()) if right.num_rows else (None, [])
        for i, unit in enumerate(right.column("unit").to_pylist()):
            nodes_.append(wanted[at[i] : at[i + 1]])
            sims.append(x[np.searchsorted(ids, nodes_[-1])] @ np.frombuffer(unit, np.float64))
        return pa.table({"query": right.column("query"), "nodes": _listed(nodes_), "sims": _listed(sims, np.float64)})

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state with what was measured: the best stay in the pool, the rest is dropped."""
        for batch in batches:
            pools, p = _lists(batch.column(2))
            pool_sim, pool_node, pool_done = (pools.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            (dropped, d), (todo, t), (groups, g) = (_lists(batch.column(i)) for i in (3, 4, 5))
            (got_node, n), (got_sim, _) = (_lists(groups.field(i)) for i in range(2))
            sims, nodes_, dones, rests, todos = [], [], [], [], []
            for i in range(batch.num_rows):
                old, new = slice(p[i], p[i + 1]), slice(n[g[i]], n[g[i + 1]])  # a query's lists lie one behind the other
                node = np.concatenate([pool_node[old], got_node[new]])
                sim = np.concatenate([pool_sim[old], got_sim[new]])
                done = np.zeros(len(node), bool)
                done[: p[i + 1] - p[i]] = pool_done[old] | np.isin(pool_node[old], todo[t[i] : t[i + 1]])
                order = np.lexsort((done, node, sim))[::-1]
                stay = order[:kept]
                sims.append(sim[stay]), nodes_.append(node[stay]), dones.append(done[stay])
                rests.append(np.concatenate([dropped[d[i] : d[i + 1]], node[order[kept:]]]))
                todos.append(node[stay][:beam][~done[stay][:beam]][:expand])
            if batch.num_rows:
                offsets = pa.array(np.cumsum([0, *map(len, nodes_)]), pa.int32())
                pool = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (sims, nodes_, dones)], names=["sim", "node", "done"]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pool, _listed(rests), _listed(todos)], names=["query", "unit", "pool", "dropped", "todo"])

    kept = max(POOL, beam)
    names = lambda found: F.transform(found, lambda p: p["node"])
    vectors = settled(nodes.select("node", "unit").mapInArrow(placed, "block bigint, node bigint, unit binary"))
    todo = names(F.slice(F.filter(F.slice("pool", 1, beam), lambda p: ~p["done"]), 1, expand)).alias("todo")
    state = settled(state.select("query", "unit", "pool", "dropped", todo))
    conf = nodes.sparkSession.conf
    usual = conf.get(BATCH)
    conf.set(BATCH, str(min(ROWS, int(usual)) if int(usual) > 0 else ROWS))
    try:
        for _ in range(rounds):
            front = state.select("query", F.explode("todo").alias("node"))
            fresh = front.join(near, "node").groupBy("query").agg(F.flatten(F.collect_list("near")).alias("reached"))
            known = state.select("query", "unit", names("pool").alias("pool"), "dropped")
            asked = fresh.join(known, "query").select("query", "unit", "reached", "pool", "dropped").mapInArrow(unknown, "block bigint, query bigint, unit binary, nodes array<bigint>")
            met = vectors.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(measure, "query bigint, nodes array<bigint>, sims array<double>")
            got = met.groupBy("query").agg(F.collect_list(F.struct("nodes", "sims")).alias("got"))
            both = state.join(got, "query", "left").select("query", "unit", "pool", "dropped", "todo", F.coalesce("got", F.array().cast(got.schema["got"].dataType)).alias("got"))
            left = Observation()
            before, state = state, settled(both.mapInArrow(grown, STATE).observe(left, F.count_if(F.size("todo") > 0).alias("open")))
            forget(before)
            if not left.get["open"]:
                break
    finally:
        conf.set(BATCH, usual)
    forget(vectors)
    return state.drop("todo")


def true_nearest(nodes: DataFrame, queries: DataFrame, k: int, most: int = 128) -> dict[int, set[int]]:
    """The ``k`` nearest other nodes of up to ``most`` queries (query, node, unit), drawn by a hash: by comparing each with all nodes.

    Each task reads its nodes once and keeps the best ``k`` of each query, so that ``most`` times ``k``
    rows come back from it.
    """
    drawn = queries.orderBy(F.xxhash64("query"), "query").limit(most).collect()  # ``most`` rows
    asked = {r["query"]: (r["node"], np.frombuffer(r["unit"], np.float64)) for r in drawn}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {q: [] for q in asked}
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(raw[i] for i in mine), np.float64).reshape(len(mine), -1)
                for q, (own, unit) in asked.items():
                    if unit.nbytes == size:
                        s = x @ unit
                        few = np.argpartition(-s, min(k, len(s) - 1))[: k + 1]
                        found = best[q] + [(float(s[i]), int(ids[mine[i]])) for i in few if ids[mine[i]] != own]
                        best[q] = sorted(found, key=lambda f: (-f[0], f[1]))[:k]
        rows = [(q, n, s) for q, found in best.items() for s, n in found]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query", "node", "sim"])

    rows = nodes.select("node", "unit").mapInArrow(task, "query bigint, node bigint, sim double")
    top = rows.selectExpr("*", "row_number() OVER (PARTITION BY query ORDER BY sim DESC, node) AS r").where(f"r <= {k}")
    out: dict[int, set[int]] = {q: set() for q in asked}
    for r in top.select("query", "node").collect():  # ``most`` times ``k`` rows
        out[r["query"]].add(r["node"])
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", exact: int = 16, recall: float = 0.95, **options) -> DataFrame:
    """The ``k`` nearest vectors by cosine of each row of ``queries`` other than itself: query_id, rank, vec_id, score.

    ``queries`` are rows of ``vectors``. Scores are cosines of the original vectors in
    double precision, ties go to the smaller id. The best ``exact`` nodes of each
    search are scored again, with all ids their classes can contribute. Up to 128 queries are also
    compared with all vectors; beams are made four times as wide until ``recall`` of their true neighbours is found. Vectors that
    are null, empty, zero or hold null or non-finite components take no part; all
    others must have one length. Rows that repeat an id and vector count once. An
    empty table gives an empty result.
    """
    units = settled(unit_vectors(vectors, id_col, vector_col))
    table = settled(classes(units, k))
    forget(units)
    place = unit_vectors(queries, id_col, vector_col).select(F.col("vec").alias("query"), "unit").distinct()
    asked = settled(place.join(table.select("unit", "node"), "unit").select("query", "node", "unit"))
    build = {x: options[x] for x in ("trees", "bits", "block", "sample", "rounds", "backward") if x in options}
    near_ = graph(table, **build)
    truth = true_nearest(table, asked, k)
    beam = options.get("beam", 128)
    state = begun(asked)
    while True:
        state = search(table, near_, state, beam, max(32, beam // 2))
        found = state.select("query", F.transform(F.filter(F.slice("pool", 1, beam), lambda p: p["sim"] > -2.5), lambda p: p["node"]).alias("found"))
        hits = found.where(F.col("query").isin(list(truth))).select("query", F.slice("found", 1, exact).alias("nodes")).collect()
        total = sum(map(len, truth.values()))
        caught = sum(len(truth[r["query"]] & set(r["nodes"])) for r in hits)
        if caught >= recall * total or beam >= 1 << 14:
            break
        # wider, from where the search stands: what it measured is not measured again
        beam *= 4
        if beam > POOL:  # nodes that were dropped may be in this beam: all of the pool is expanded once more
            pool = F.transform("pool", lambda p: F.struct(p["sim"].alias("sim"), p["node"].alias("node"), F.lit(False).alias("done")))
            state = state.select("query", "unit", pool.alias("pool"), F.expr(NO_IDS).alias("dropped"))
    # the query's own class holds its exact copies
    near = found.select("query", F.explode(F.slice("found", 1, exact)).alias("node")).union(asked.select("query", "node")).distinct()
    ids = near.join(table.select("node", "members"), "node").select("query", F.explode("members").alias("vec")).where("query <> vec").distinct()
    raw = vectors.select(F.col(id_col).cast("bigint").alias("vec"), F.col(vector_col).cast("array<double>").alias("v")).where("vec IS NOT NULL").dropDuplicates(["vec"])
    own = queries.select(F.col(id_col).cast("bigint").alias("query"), F.col(vector_col).cast("array<double>").alias("q")).where("query IS NOT NULL").dropDuplicates(["query"])
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    cosine = total(F.zip_with("q", "v", lambda a, b: a * b)) / (F.sqrt(total(F.transform("q", lambda a: a * a))) * F.sqrt(total(F.transform("v", lambda a: a * a))))
    scored = ids.join(raw, "vec").join(own, "query").select(F.col("query").alias("query_id"), F.col("vec").alias("vec_id"), cosine.alias("score"))
    return scored.selectExpr("query_id", "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank", "vec_id", "score").where(f"rank <= {k}")
