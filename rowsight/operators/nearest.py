"""Exact nearest vectors for many requests, over an index of coarse cells.

``cell_index`` gives each item the nearest of some centres and keeps each cell's radius
and number of items; cells are packed into blocks of bounded bytes. A request first
visits its nearest cells until these hold ``n`` items, which bounds the distance of its
n-th nearest. By the triangle inequality no item of a cell is nearer than the
distance to the centre less the radius, so only cells below the bound are visited after
that. Requests are dealt to slices by the cell they lie in; a slice and a block are one
group, so that work spreads however few blocks there are. A request is sent once to each
block with a cell it visits, an item once to each slice, and a group emits its best
``n`` per request only, none beyond the bound.

Where vectors have no clusters, no cell can be left out: the work then is that of all
pairs, at some nanoseconds each, and what moves grows with vectors times blocks.

What is collected is bounded: the centres and one row of figures for each cell.
Building an index runs two jobs, a search one before its own; an index can be written
once and read by many searches.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

# tasks get the code of this module with the closure, no install on executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: vector bytes of a block, as doubles
BLOCK_BYTES = 32 << 20
CHUNK_CELLS = 8_000_000
#: items that are compared at once
CHUNK_ITEMS = 8192
#: cells of an index, at most; fewer for small tables
MOST_CELLS = 1024
#: blocks for vectors of lengths that no centre has
OTHER_BLOCKS = 64
#: requests compared at once with all cells that one of them needs
TOGETHER = 512
#: pairs of a block of items and a slice of requests that a search is made of, if there are requests enough
LEAST_UNITS = 64
LEAST_REQUESTS = 1024
#: partitions that these pairs are dealt to
MOST_PARTITIONS = 4096


def _matrix(vectors) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.float64) for v in vectors]
    return np.stack(rows) if rows else np.zeros((0, 0))


def _bounds(found: np.ndarray, values: np.ndarray, rows: int, n: int) -> np.ndarray:
    """The n-th smallest value found for each row, infinite where there are fewer; ``found`` is sorted."""
    out = np.full(rows, np.inf, dtype=values.dtype)
    order = np.lexsort((values, found))
    start = np.searchsorted(found, np.arange(rows + 1))
    full = np.flatnonzero(np.diff(start) >= n)
    out[full] = values[order[start[full] + n - 1]]
    return out


def _set(mask: np.ndarray) -> np.ndarray:
    """Flat positions of the true values of which there are few: looks at eight at once."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    near = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return near[flat[near]]


def best(requests: np.ndarray, items: np.ndarray, item_keys: np.ndarray, n: int, metric: str, bound: np.ndarray | None = None):
    """Per request the n nearest items, equal distances by key, and none beyond its ``bound``:
    (request position, item position, distance).

    Single precision finds all items that may be among the nearest, with slack for its
    rounding; exact distances decide among these.
    """
    empty = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    if not len(requests) or not len(items):
        return empty
    half = 2.0 if metric == "cosine" else 1.0
    if metric == "cosine":
        requests = requests / np.maximum(np.linalg.norm(requests, axis=1, keepdims=True), 1e-300)
        items = items / np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-300)
    sizes, own = (items * items).sum(axis=1), (requests * requests).sum(axis=1)
    top = float(np.sqrt(max(sizes.max(), own.max())))
    kind = np.float32 if 1e-12 < top < 1e12 else np.float64
    # |y|^2 - 2xy in one product; its rounding error is some eps of (|x| + |y|)^2
    left = np.concatenate([requests * -2.0, np.ones((len(requests), 1))], axis=1).astype(kind)
    right = np.concatenate([items, sizes[:, None]], axis=1).astype(kind)
    slack = 4.0 * (items.shape[1] + 16) * float(np.finfo(kind).eps) * (np.sqrt(own) + np.sqrt(sizes.max())) ** 2
    limits = np.full(len(requests), np.inf) if bound is None else bound * half * (1 + 1e-9) - own + slack
    out_r, out_i, out_d = [], [], []
    for start in range(0, len(requests), TOGETHER):
        rows = slice(start, min(start + TOGETHER, len(requests)))
        limit, count = limits[rows].copy(), rows.stop - start
        held_r, held_i, held_v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        for at in range(0, len(items), CHUNK_ITEMS):
            rough = left[rows] @ right[at : at + CHUNK_ITEMS].T
            width = rough.shape[1]
            if at == 0 and width > n:
                limit = np.minimum(limit, np.partition(rough, n - 1, axis=1)[:, n - 1] + 2 * slack[rows])
            flat = _set(~(rough > limit[:, None].astype(kind)))
            if not len(flat):
                continue
            r = flat // width
            held_r, held_i, held_v = np.concatenate([held_r, r]), np.concatenate([held_i, flat - r * width + at]), np.concatenate([held_v, rough.ravel()[flat]])
            order = np.argsort(held_r, kind="stable")
            held_r, held_i, held_v = held_r[order], held_i[order], held_v[order]
            limit = np.minimum(limit, _bounds(held_r, held_v, count, n) + 2 * slack[rows])
            kept = ~(held_v > limit[held_r].astype(kind))
            held_r, held_i, held_v = held_r[kept], held_i[kept], held_v[kept]
        exact = np.concatenate([((items[held_i[a : a + CHUNK_ITEMS]] - requests[held_r[a : a + CHUNK_ITEMS] + start]) ** 2).sum(axis=1) for a in range(0, len(held_i), CHUNK_ITEMS)] or [np.zeros(0)])
        order = np.lexsort((item_keys[held_i], exact, held_r))
        r, i, d = held_r[order], held_i[order], exact[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < n
        if bound is not None:
            first &= d <= (bound[rows] * half * (1 + 1e-9))[r]
        out_r.append(r[first] + start), out_i.append(i[first]), out_d.append(d[first] / half)
    return np.concatenate(out_r), np.concatenate(out_i), np.concatenate(out_d)


def _distinct(matrix: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Positions of the items that can be among n nearest ones: of equal vectors the n first by key."""
    rows = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.shape[1] * matrix.itemsize))).ravel()
    _, same = np.unique(rows, return_inverse=True)
    order = np.lexsort((place, same))
    return np.sort(order[np.arange(len(order)) - np.searchsorted(same[order], same[order]) < n])


def _ranked(found: DataFrame, request: str, item: str, n: int) -> DataFrame:
    order = Window.partitionBy(request).orderBy("distance", item)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


@dataclass
class Cells:
    """An index of items: rows (item, vector, __cell, __block), and for each cell its
    centre, radius, number of items, first block and number of blocks."""

    frame: DataFrame
    item: str
    vector: str
    metric: str
    centres: list[np.ndarray]
    radius: np.ndarray
    count: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    block_bytes: int = BLOCK_BYTES
    #: vectors of each length, with their numbers
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)

    def __post_init__(self):
        numbers: dict[int, list[int]] = {}
        for k, c in enumerate(self.centres):
            numbers.setdefault(len(c), []).append(k)
        self.by_width = {w: (np.array(ks), np.stack([self.centres[k] for k in ks])) for w, ks in numbers.items()}


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows to centres, computed without cancellation for near ones."""
    out = np.empty((len(x), len(centres)))
    step = max(1, CHUNK_CELLS // max(1, centres.size))
    for a in range(0, len(x), step):
        rough = (x[a : a + step] ** 2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2.0 * (x[a : a + step] @ centres.T)
        out[a : a + step] = np.sqrt(np.maximum(rough, 0.0))
    return out


def _scaled(v, metric: str) -> np.ndarray:
    x = np.asarray(v, dtype=np.float64)
    return x / max(np.linalg.norm(x), 1e-300) if metric == "cosine" else x


def _dealt(centres: list[np.ndarray], size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of each cell: cells that lie near each other share a part of
    at most ``most`` bytes, a larger cell has parts of its own."""
    first, parts = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
    part, filled = 0, 0
    for k in sorted(range(len(centres)), key=lambda k: (len(centres[k]), centres[k][0])):
        if size[k] > most:
            parts[k] = -(-size[k] // most)
            first[k] = part + (filled > 0)
            part, filled = first[k] + parts[k], 0
        else:
            if filled + size[k] > most:
                part, filled = part + 1, 0
            first[k], filled = part, filled + size[k]
    return first, parts


def _part(first: np.ndarray, parts: np.ndarray, cell: Column, key: str) -> Column:
    """The part of a row of a cell, by a hash of its key where a cell has several."""
    firsts, many = (F.array(*[F.lit(int(x)) for x in xs]) if len(xs) else F.array(F.lit(0)) for xs in (first, parts))
    at = cell.cast("int") + 1
    return F.pmod(F.xxhash64(key), F.element_at(many, at)) + F.element_at(firsts, at)


def cell_index(
    items: DataFrame, item: str = "item_id", vector: str = "embedding", metric: str = "sqeuclidean", block_bytes: int = BLOCK_BYTES,
    cells: int | None = None, path: str | None = None,
) -> Cells:
    """Index of all usable items; ``path``: keep its rows there as Parquet, by block.

    Centres are items, chosen by a hash of their keys: about the square root of the
    number of items, MOST_CELLS at most. Keys must be unique.
    """
    usable = _usable(items, item, vector)
    total = usable.count()
    wanted = max(1, min(cells or MOST_CELLS, round(total**0.5)))
    picked = usable.orderBy(F.xxhash64(item), item).limit(wanted).select(vector).collect()  # bounded by MOST_CELLS
    centres = [_scaled(r[0], metric) for r in picked]
    shell = Cells(usable, item, vector, metric, centres, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0))
    by_width = shell.by_width
    itype, vtype = usable.schema[item].dataType.simpleString(), usable.schema[vector].dataType.simpleString()

    def place(batches):
        for pdf in batches:
            cell, away = np.full(len(pdf), -1), np.zeros(len(pdf))
            widths = pdf[vector].map(len).to_numpy() if len(pdf) else np.zeros(0, int)
            for w in np.unique(widths):
                if w in by_width:
                    mine = np.flatnonzero(widths == w)
                    numbers, matrix = by_width[w]
                    d = _distances(np.stack([_scaled(v, metric) for v in pdf[vector].to_numpy()[mine]]), matrix)
                    cell[mine], away[mine] = numbers[d.argmin(axis=1)], d.min(axis=1)
            yield pdf.assign(__cell=cell, __away=away)

    placed = usable.mapInPandas(place, f"`{item}` {itype}, `{vector}` {vtype}, __cell bigint, __away double")
    figures = placed.groupBy("__cell").agg(F.count("*").alias("n"), F.max("__away").alias("radius"), F.sum(F.size(vector).cast("bigint") * 8).alias("bytes")).collect()
    radius, count, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
    for r in figures:  # a row per cell
        if r["__cell"] >= 0:
            radius[r["__cell"]], count[r["__cell"]], size[r["__cell"]] = r["radius"], r["n"], r["bytes"]
    first, parts = _dealt(centres, size, block_bytes)
    own = _part(first, parts, F.col("__cell"), item)
    other = -1 - F.pmod(F.size(vector), F.lit(OTHER_BLOCKS))
    frame = placed.withColumn("__block", F.when(F.col("__cell") >= 0, own).otherwise(other)).drop("__away")
    if path:
        frame.repartition("__block").write.mode("overwrite").partitionBy("__block").parquet(path)
        frame = frame.sparkSession.read.schema(frame.schema).parquet(path)
    return Cells(frame, item, vector, metric, centres, radius, count, first, parts, block_bytes)


def search(requests: DataFrame, index: Cells, n: int, request: str = "request_id", vector: str = "embedding") -> DataFrame:
    """(request, item, distance, rank): the n nearest items of each request, exactly."""
    item, ivector, metric = index.item, index.vector, index.metric
    asked = _usable(requests, request, vector)
    rtype, vtype = (asked.schema[c].dataType.simpleString() for c in (request, vector))
    itype = index.frame.schema[item].dataType.simpleString()
    by_width, radius, count, first, parts = index.by_width, index.radius, index.count, index.first, index.parts
    half = 2.0 if metric == "cosine" else 1.0
    blocks = int((first + parts).max()) if len(first) else 1

    def batches_by_width(batches):
        """(rows, vectors, distances to centres and their numbers) of few rows of one length; without distances where no centre has it."""
        for pdf in batches:
            widths = pdf[vector].map(len).to_numpy() if len(pdf) else np.zeros(0, int)
            for w in np.unique(widths):
                mine = np.flatnonzero(widths == w)
                for start in range(0, len(mine), 1024):
                    few = pdf.iloc[mine[start : start + 1024]]
                    if w in by_width:
                        numbers, matrix = by_width[w]
                        yield few, numbers, _distances(np.stack([_scaled(v, metric) for v in few[vector]]), matrix)
                    else:
                        yield few, None, None

    def home(batches):
        for few, numbers, d in batches_by_width(batches):
            yield few.assign(__home=-1 if d is None else numbers[d.argmin(axis=1)])

    # requests are dealt to slices by the cell they are in, as items to blocks
    homed = asked.mapInPandas(home, f"`{request}` {rtype}, `{vector}` {vtype}, __home bigint")
    figures = homed.groupBy("__home").agg(F.count("*").alias("n"), F.sum(F.size(vector).cast("bigint") * 8).alias("bytes")).collect()  # a row per cell
    size = np.zeros(len(index.centres), np.int64)
    for r in figures:
        if r["__home"] >= 0:
            size[r["__home"]] = r["bytes"]
    number, total = sum(r["n"] for r in figures), sum(r["bytes"] for r in figures)
    wanted = min(-(-LEAST_UNITS // blocks), -(-number // LEAST_REQUESTS))
    slice_first, slice_parts = _dealt(index.centres, size, max(1, min(index.block_bytes, -(-total // max(wanted, 1)))))
    slices = int((slice_first + slice_parts).max()) if len(slice_first) else 1
    units = min(blocks * slices, MOST_PARTITIONS)
    own = F.when(F.col("__home") >= 0, _part(slice_first, slice_parts, F.col("__home"), request)).otherwise(F.pmod(F.xxhash64(request), F.lit(slices)))
    sliced = homed.withColumn("__slice", own.cast("bigint"))
    visit = f"`{request}` {rtype}, `{vector}` {vtype}, __home bigint, __slice bigint, __bound double, __reach double, __block bigint"

    held = {w: np.zeros((len(numbers), blocks), np.float32) for w, (numbers, _) in by_width.items()}  # which blocks hold a cell
    for w, (numbers, _) in by_width.items():
        for at, k in enumerate(numbers):
            held[w][at, first[k] : first[k] + parts[k]] = 1.0

    def visits(batches, bounded: bool):
        """A row for each block that a request visits: those of the few nearest cells that hold n items, or all with a cell that may hold something within the bound."""
        for few, numbers, d in batches_by_width(batches):
            if d is None:
                yield few.assign(__reach=np.nan, __block=[-1 - _other(len(v)) for v in few[vector]])[columns]
                continue
            if bounded:  # distances here are squared, or half of the squared ones
                reach = np.sqrt(few["__bound"].fillna(np.inf).to_numpy(float) * half)
            else:
                order = np.argsort(d, axis=1)
                enough = (np.cumsum(count[numbers][order], axis=1) < n).sum(axis=1).clip(max=len(numbers) - 1)
                reach = d[np.arange(len(d)), order[np.arange(len(d)), enough]]
            chosen = _needed(d, radius[numbers], reach, bounded)
            r, b = np.nonzero(chosen.astype(np.float32) @ held[len(few[vector].iloc[0])])
            yield few.assign(__reach=reach).iloc[r].assign(__block=b)[columns]

    columns = [request, vector, "__home", "__slice", "__bound", "__reach", "__block"]

    def meet(bounded: bool):
        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            # objects become any type; an empty column of floats does not become one array of texts
            out = [pd.DataFrame({request: [], item: [], "distance": []}, dtype=object)]
            if len(a) and len(b):
                keys, cell = b[item].to_numpy(), b["__cell"].to_numpy()
                place = np.empty(len(b), np.int64)
                place[np.argsort(pd.Categorical(keys, ordered=True).codes if keys.dtype == object else keys, kind="stable")] = np.arange(len(b))
                widths, asked_widths = b[ivector].map(len).to_numpy(), a[vector].map(len).to_numpy()
                for width in np.intersect1d(asked_widths, widths):
                    mine = np.flatnonzero(widths == width)
                    mine = mine[np.argsort(cell[mine], kind="stable")]
                    matrix = _matrix(b[ivector].iloc[mine])
                    some = _distinct(matrix, place[mine], n)
                    mine, matrix = mine[some], matrix[some]
                    cells, starts = np.unique(cell[mine], return_index=True)
                    ends = np.append(starts[1:], len(mine))
                    # requests of a cell are near each other and need much the same items
                    rows = np.flatnonzero(asked_widths == width)
                    rows = rows[np.argsort(a["__home"].to_numpy()[rows], kind="stable")]
                    vectors = _matrix(a[vector].iloc[rows])
                    bound = a["__bound"].fillna(np.inf).to_numpy(float)[rows] if bounded else None
                    reach = a["__reach"].to_numpy(float)[rows]
                    for start in range(0, len(rows), TOGETHER):
                        few = slice(start, start + TOGETHER)
                        if cells[0] < 0:
                            need = np.ones(len(cells), bool)
                        else:
                            scaled = np.stack([_scaled(v, metric) for v in vectors[few]])
                            d = _distances(scaled, np.stack([index_centres[c] for c in cells]))
                            need = _needed(d, radius[cells], reach[few], bounded).any(axis=0)
                        if not need.any():
                            continue
                        sub = slice(None) if need.all() else np.concatenate([np.arange(x, y) for x, y in zip(starts[need], ends[need])])
                        r, i, d = best(vectors[few], matrix[sub], place[mine][sub], n, metric, None if bound is None else bound[few])
                        out.append(pd.DataFrame({request: a[request].to_numpy()[rows[few][r]], item: keys[mine[sub][i]], "distance": d}))
            return pd.concat(out[1:] or out)

        return run

    index_centres = index.centres
    out = f"`{request}` {rtype}, `{item}` {itype}, distance double"
    # each slice of requests meets each block of items that one of them visits in one group, however many there are of either
    spread = index.frame.withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))

    def found(rows: DataFrame, bounded: bool) -> DataFrame:
        sent = rows.mapInPandas(lambda batches: visits(batches, bounded), visit)
        left, right = (x.repartition(units, "__block", "__slice").groupBy("__block", "__slice") for x in (sent, spread))
        return left.cogroup(right).applyInPandas(meet(bounded), out)

    near = found(sliced.withColumn("__bound", F.lit(None).cast("double")), False)
    # these cells are as few as hold n items, so this is a list of n values for each of few blocks
    nth = near.groupBy(request).agg(F.get(F.array_sort(F.collect_list("distance")), F.lit(n - 1)).alias("__bound"))
    return _ranked(found(sliced.join(nth, request, "left"), True), request, item, n)


def _needed(d: np.ndarray, radius: np.ndarray, reach: np.ndarray, bounded: bool) -> np.ndarray:
    """Which cells each request needs, with slack for the rounding of distances."""
    inner = d - radius[None, :] if bounded else d
    return ~(inner > reach[:, None] + 1e-6 * (1.0 + d))


def _other(width: int) -> int:
    """The block for vectors of a length that no centre has."""
    return width % OTHER_BLOCKS


def nearest(
    requests: DataFrame, items: DataFrame, n: int, request: str = "request_id", item: str = "item_id",
    vector: str = "embedding", metric: str = "sqeuclidean", block_bytes: int = BLOCK_BYTES, cells: int | None = None,
) -> DataFrame:
    """(request, item, distance, rank): the n nearest items of each request.

    ``metric`` is squared Euclidean or cosine distance. Request and item keys
    must be unique. Vectors are compared with vectors of their length only; null
    and empty ones, and those with null or non-finite values, take no part.
    """
    if metric not in ("sqeuclidean", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    return search(requests, cell_index(items, item, vector, metric, block_bytes, cells), n, request, vector)


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf")))
    return df.select(key, vector).where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)
