"""Packing documents' tokens into as few sequences of fixed length as possible.

Pieces of equal length are interchangeable, so the packing is planned on the number
of pieces of each length: one row per length, ``capacity`` rows at most, whatever
the number of documents. The plan first applies Martello and Toth's dominance
reduction: for a length, it looks for a set of pieces that dominates every other set
which could share a sequence with it, and fixes as many such sequences as the counts
allow. What no rule decides is packed best-fit, longest first. Steps of the plan are
runs of equal sequences; each piece finds its run by its number among the pieces of
its length. Numbers come from counts per partition and length, so nothing is sorted
or collected by length and pieces of a frequent length spread over all tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from rowsight.llm.shared import bounded_batches, settled
from rowsight.llm.tokens import Encoder
from rowsight.llm.words import slices

#: columns of a run: length, number of its first piece, pieces, first sequence, pieces per sequence, offset of the first
RUN = ("length", "first", "pieces", "sequence", "each", "offset")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a shorter first one if need be."""
    head = length % capacity
    starts = list(range(head, length, capacity))
    return ([(0, head)] if head else []) + [(s, capacity) for s in starts]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, separator: int = 0) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32) of all documents' tokens, a separator after each document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, 1):
            encoder = encoder or Encoder()
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.array(text, separator).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append(i)
                    out.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(columns[0].astype(np.int32)), *[pa.array(c) for c in columns[1:]]],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(task, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Plan:
    """Runs of sequences for counts of piece lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)  # pieces not packed yet, by length
        for length, n in counts.items():
            self.left[length] = n
        self.taken: dict[int, int] = defaultdict(int)
        self.sequences = 0
        self.runs: list[tuple[int, ...]] = []
        self.fixed = 0

    def run(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], n, sequence, each, offset))
        self.taken[length] += n
        self.left[length] -= n

    def fix(self, members: list[int]) -> None:
        """Close as many sequences of these lengths as there are pieces for."""
        need = defaultdict(int)
        for m in members:
            need[m] += 1
        n = min(int(self.left[m]) // k for m, k in need.items())
        offset = 0
        for m, k in need.items():
            self.run(m, n * k, self.sequences, k, offset)
            offset += m * k
        self.sequences += n
        self.fixed += n

    def reduce(self) -> None:
        """Martello and Toth: fix dominating sets until none is found."""
        changed = True
        while changed:
            changed = False
            for j in range(self.capacity, 0, -1):
                while self.left[j] and (found := self.dominating(j)) is not None:
                    self.fix(found)
                    changed = True

    def dominating(self, j: int) -> list[int] | None:
        """Lengths that, with one piece of length ``j``, dominate all feasible sets with it; None if no rule tells."""
        room = self.capacity - j
        self.left[j] -= 1
        try:
            there = np.flatnonzero(self.left[: room + 1])  # lengths that fit, ascending
            if not len(there):
                return [j]
            if there[-1] == room:  # one piece fills the room: it stands for any set in it
                return [j, int(room)]
            small = [int(x) for x in there[:3] for _ in range(min(3, int(self.left[x])))][:3]
            best = int(there[-1])
            if len(small) < 2 or small[0] + small[1] > room:  # one more piece at most: the largest
                return [j, best]
            if len(small) == 3 and sum(small) <= room:
                return None
            # two more pieces at most: {best, second} dominates if each feasible pair maps into it
            self.left[best] -= 1
            rest = there[: bisect.bisect_right(there, room - best)]
            rest = rest[self.left[rest] > 0]
            self.left[best] += 1
            second = int(rest[-1]) if len(rest) else 0
            low, high = bisect.bisect_right(there, second), len(there) - 1
            while low <= high:
                x, y = int(there[high]), int(there[low])
                if x + y > room or (low == high and self.left[x] < 2):
                    high -= 1
                elif x + y > best:
                    return None
                else:
                    low += 1
            return [j, best, second] if second else [j, best]
        finally:
            self.left[j] += 1

    def best_fit(self) -> None:
        """Longest first, each piece into the fullest open sequence with room, in runs of equal sequences."""
        rooms: list[int] = []  # ascending
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, sequences)

        def put(room: int, sequence: int, n: int) -> None:
            if room and n:
                if not open_[room]:
                    bisect.insort(rooms, room)
                open_[room].append((sequence, n))

        for s in range(self.capacity, 0, -1):
            while n := int(self.left[s]):
                at = bisect.bisect_left(rooms, s)
                if at == len(rooms):
                    room, each = self.capacity, self.capacity // s
                    sequence, m = self.sequences, -(-n // each)
                    self.sequences += m
                else:
                    room = rooms[at]
                    sequence, m = open_[room].pop()
                    if not open_[room]:
                        rooms.pop(at)
                    each = room // s
                full = min(m, n // each)
                if full:
                    self.run(s, full * each, sequence, each, self.capacity - room)
                    put(room - full_room if (full_room := each * s) else room, sequence, full)
                if full < m:
                    part = min(n - full * each, each)
                    if part:
                        self.run(s, part, sequence + full, part, self.capacity - room)
                        put(room - part * s, sequence + full, 1)
                    put(room, sequence + full + bool(part), m - full - bool(part))


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (see RUN) for counts of piece lengths, sorted by length and first piece."""
    made = Plan(counts, capacity)
    made.reduce()
    made.best_fit()
    runs = np.array(made.runs, np.int64).reshape(-1, len(RUN))
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def _and(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in more.items())])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Where each piece of each document goes: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text (null: none) and the separator; only
    documents longer than ``capacity`` are cut. Each row of ``docs`` is a document
    of its own, whatever its id. An empty table gives an empty result.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            first = np.searchsorted(ordered, ordered)
            own = np.empty(len(lengths), np.int64)
            own[order] = np.arange(len(lengths)) - first + seen[ordered]
            seen += np.bincount(lengths, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(own)], names=[*batch.schema.names, "part", "own"])

    bounded_batches(docs.sparkSession)
    cut_up = pieces(docs, id_col, text_col, capacity, separator)
    numbered = settled(cut_up.mapInArrow(number, _and(cut_up, part=T.IntegerType(), own=T.LongType())))
    per_part = numbered.groupBy("part", "length").agg(F.count("*").alias("n"))
    starts = settled(per_part.selectExpr("part", "length", "n", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS before"))
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``capacity`` rows at most
    runs = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        keys = (table[:, 0] << 48) | table[:, 1]
        for batch in batches:
            length, n = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            run = table[np.searchsorted(keys, (length << 48) | n, side="right") - 1]
            at = n - run[:, 1]
            sequence, offset = run[:, 3] + at // run[:, 4], run[:, 5] + at % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    placed = numbered.join(starts.select("part", "length", "before"), ["part", "length"]).select(*cut_up.columns, (F.col("own") + F.col("before")).alias("number"))
    return placed.mapInArrow(place, _and(cut_up, sequence_id=T.LongType(), offset=T.LongType()))
