"""Near-duplicate documents through HyperMinHash registers.

Each set of word shingles is hashed once per shingle. The hash's first bits name
one of 128 registers; a register keeps the smallest rest, compressed to its count
of leading zeros (6 bits) and the next bits after the leading one (10 bits).
Registers without a shingle borrow from others in a fixed random order, so that
small sets band as well as large ones. 32 bands of 4 registers name candidates, the
collision-corrected estimate of Jaccard's measure drops false ones, and all others
are confirmed on the full sets.

Equal sets form one class before anything else, so that thousands of copies cost
one row. Within a band's bucket no list of all pairs is made: all members meet its
smallest one first. Only in buckets that then hold several components do members of
different components meet, in cells of bounded size that compare registers and pass
on lists, and in blocks of bounded size that confirm them on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from rowsight.functions.scalars import col, has_type
from rowsight.llm.components import components
from rowsight.llm.shared import bounded_batches, free_name, settled
from rowsight.llm.words import STEP, WordHashes, mixed, slices, windows

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
#: expected chance collisions of two registers are about this, times 2 ** -MANTISSA
COLLISION = 0.169919487159739
#: candidates are kept this many standard deviations below the threshold
DEVIATIONS = 5.0
#: documents of a side of a cell or block in which leftover candidates meet
CELL = 1024
#: shingles of a document beyond which blocks hold fewer documents
LONG = 4096

_ORDER = np.stack([np.random.default_rng(1000 + i).permutation(REGISTERS) for i in range(REGISTERS)])


def shingles(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word runs of one text; all of a shorter text is one run."""
    words = hashes.of(text.lower().split()) if text else np.empty(0, np.uint64)
    if 0 < len(words) < width:
        return windows(np.append(words, np.uint64(len(words))), len(words) + 1)
    return np.unique(windows(words, width))


def registers(values: np.ndarray) -> np.ndarray:
    """128 registers of a set of hashes; 0xFFFF where no hash falls."""
    values = mixed(values * STEP)
    slot = (values >> np.uint64(57)).astype(np.int64)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, slot, values << np.uint64(7))
    out = np.full(REGISTERS, 0xFFFF, np.uint16)
    full = np.zeros(REGISTERS, bool)
    full[slot] = True
    rest = np.maximum(least[full], np.uint64(1 << 7))
    zeros = 63 - np.log2((rest >> np.uint64(11)).astype(np.float64) + 0.5).astype(np.int64) - 11
    zeros = np.clip(zeros, 0, 52)
    after = (rest << (zeros.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[full] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | after.astype(np.uint16)
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, after empty registers have borrowed."""
    full = regs != 0xFFFF
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _ORDER[empty]
        regs = regs.copy()
        regs[empty] = regs[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    packed = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        packed = (packed << np.uint64(16)) | regs[i::ROWS].astype(np.uint64)
    return mixed(packed + STEP * np.arange(1, BANDS + 1, dtype=np.uint64))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc, n_shingles, digest, regs, keys) for each row; digest and what follows null for the empty set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 1):
            n, digest, regs, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width, hashes)
                n.append(len(found))
                if len(found):
                    r = registers(found)
                    digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                    regs.append(r.tobytes())
                    keys.append(bands(r).view(np.int64))
                else:
                    digest.append(None), regs.append(None), keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc", "n_shingles", "digest", "regs", "keys"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(task, "doc bigint, n_shingles bigint, digest binary, regs binary, keys array<bigint>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc, shingles) for each distinct row of ``docs``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 1):
            found = [shingles(t, width, hashes) for t in batch.column(1).to_pylist()]
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary())
            arrays = pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, arrays], names=["doc", "digest", "shingles"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(task, "doc bigint, digest binary, shingles array<bigint>").dropDuplicates(["doc", "digest"]).drop("digest")


def estimates(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ra, rb) that the registers don't rule out, with ``estimate``; registers dropped."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            value, floor = estimated(a, b, percent)
            keep = pa.array(value >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], names=["a", "b", "estimate"]).filter(keep)

    return pairs.select("a", "b", "ra", "rb").mapInArrow(task, "a bigint, b bigint, estimate double")


def estimated(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and the least estimate that stays a candidate."""
    used = ((a != 0xFFFF) | (b != 0xFFFF)).sum(axis=1)
    same = ((a == b) & (a != 0xFFFF)).sum(axis=1)
    chance = COLLISION * 2.0**-MANTISSA * used
    p = percent / 100
    return (same - chance) / np.maximum(used - chance, 1e-9), p - DEVIATIONS * np.sqrt(p * (1 - p) / np.maximum(used, 1))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) and whether their full sets reach the threshold (``link``)."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - both
    # sizes alone decide many pairs: no intersection is taken for them
    fits = 100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", F.when(fits, 100 * both >= percent * either).otherwise(F.lit(False)).alias("link"))


def open_pairs(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(x, ys): candidates y < x that share a bucket with x but not its component.

    ``members``: (key, doc, c, n), n the bucket's members. A bucket is cut into a grid
    of cells of about CELL members a side; a cell compares registers and passes lists
    on, so no row stands for a pair. A pair is passed in the first band that both share.
    """
    side = F.ceil(F.col("n") / CELL).cast("int")
    block = F.pmod(F.xxhash64("doc"), side).cast("int")
    rows = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), side - 1)))
    rows = rows.join(reps, "doc").select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("doc", "c", "block", "regs", "keys").alias("m"))
    cells = rows.groupBy("key", "i", "j").agg(F.collect_list("m").alias("ms"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            starts = batch.column(3).offsets.to_numpy()
            flat = batch.column(3).values
            doc, c, part = (flat.field(i).to_numpy() for i in range(3))
            regs, bands_ = flat.field(3), flat.field(4)
            for g, (key, i, j) in enumerate(zip(*(batch.column(n).to_pylist() for n in range(3)))):
                a, b = int(starts[g]), int(starts[g + 1])
                order = np.argsort(doc[a:b], kind="stable")
                d, comp, blk = doc[a:b][order], c[a:b][order], part[a:b][order]
                r = np.frombuffer(b"".join(regs[a:b].to_pylist()), np.uint16).reshape(-1, REGISTERS)[order]
                k = np.array(bands_[a:b].to_pylist(), np.int64).reshape(-1, BANDS)[order]
                mine = int(np.flatnonzero((k == key).all(axis=0))[0])
                for x in range(1, len(d)):  # against all smaller documents
                    ok = (comp[:x] != comp[x]) & (d[:x] != d[x])
                    if i != j:
                        ok &= blk[:x] != blk[x]
                    if not ok.any():
                        continue
                    ok &= ~(k[:x, :mine] == k[x, :mine]).any(axis=1)
                    at = np.flatnonzero(ok)
                    if len(at):
                        value, floor = estimated(r[at], r[x][None, :], percent)
                        at = at[value >= floor]
                        if len(at):
                            xs.append(d[x]), ys.append(d[at])
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.list_(pa.int64()))], names=["x", "ys"])

    return cells.mapInArrow(task, "x bigint, ys array<bigint>")


def confirmed_lists(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): enough of the links among the pairs of ``lists`` to connect all that they connect.

    Documents are dealt to blocks by a hash of their id; the blocks hold about CELL
    documents and CELL * LONG shingles on average. A pair is looked at in the cell of its
    two blocks, which gets the sets of the documents its pairs name and no others. A cell
    keeps a link only if the links it has seen don't connect the two already.
    """
    size = Observation()
    sets = settled(sets.observe(size, F.count("*").alias("n"), F.coalesce(F.sum(F.size("shingles").cast("bigint")), F.lit(0)).alias("shingles")))
    n = max(1, size.get["n"] // CELL, size.get["shingles"] // (CELL * LONG))

    def home(doc: Column) -> Column:
        return F.pmod(F.xxhash64(doc), F.lit(n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, row, ys = [], [], []
            for r, (wanted, homes) in enumerate(zip(batch.column(2), batch.column(3))):
                wanted, homes = wanted.values.to_numpy(), homes.values.to_numpy()
                for b in np.unique(homes).tolist():
                    block.append(b), row.append(r), ys.append(wanted[homes == b])
            row = pa.array(row, pa.int64())
            columns = [batch.column(0).take(row), pa.array(block, pa.int64()), batch.column(1).take(row), pa.array(ys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "x", "ys"])

    asked = lists.select(home(F.col("x")).alias("i"), "x", "ys", F.transform("ys", home).alias("homes"))
    cells = settled(asked.mapInArrow(deal, "i bigint, j bigint, x bigint, ys array<bigint>"))
    named = cells.groupBy("i", "j").agg(F.array_union(F.collect_set("x"), F.array_distinct(F.flatten(F.collect_list("ys")))).alias("docs"))
    needed = named.select("i", "j", F.explode("docs").alias("doc")).join(sets, "doc").select(F.col("i").alias("k"), F.col("j").alias("l"), "doc", "shingles")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        held = left.column("shingles").combine_chunks()
        homes: dict = {}  # rows that repeat an id may have several sets
        for row, doc in enumerate(left.column("doc").to_pylist()):
            homes.setdefault(doc, []).append(row)
        sets_: dict = {}
        root: dict = {}

        def top(v):
            while root.get(v, v) != v:
                root[v] = v = root.get(root[v], root[v])
            return v

        def of(doc):
            if doc not in sets_:
                sets_[doc] = [np.sort(held[row].values.to_numpy()) for row in homes[doc]]
            return sets_[doc]

        def near(small, large):
            if len(small) > len(large):
                small, large = large, small
            if 100 * len(small) < percent * len(large):
                return False
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            return 100 * both >= percent * (len(small) + len(large) - both)

        a, b = [], []
        for x, ys in zip(right.column("x").to_pylist(), right.column("ys").to_pylist()):
            for y in ys:
                if top(x) != top(y) and any(near(sx, sy) for sx in of(x) for sy in of(y)):
                    root[top(x)] = top(y)
                    a.append(x), b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return needed.groupBy("k", "l").cogroup(cells.groupBy("i", "j")).applyInArrow(check, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Class of near copies of each document: id_col, n_shingles, component_id, kept.

    Two documents are linked if 100 * (shared shingles) >= percent * (shingles of
    either); a class is what links reach, its id the smallest document id in it.
    Words are lower-cased in A-Z. Texts are read whole; fewer than ``width`` words
    are one shingle; null and blank texts have the empty set and stay alone. Rows
    that repeat an id are copies like others and carry the same id; rows with a null
    id are left out. The pair of documents of a missed link would have had to miss
    all 32 bands: less than 1 in 10 million at the threshold.
    """
    bounded_batches(docs.sparkSession)
    sketch = settled(sketches(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width))
    full = sketch.where("digest IS NOT NULL")
    # one row for each distinct set; equal sets have equal registers and keys
    classes = settled(full.groupBy("digest").agg(F.min("doc").alias("rep"), F.first("regs").alias("regs"), F.first("keys").alias("keys")))
    reps = classes.select(F.col("rep").alias("doc"), "regs", "keys")
    keyed = reps.select("doc", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key", "first")
    members = settled(keyed.join(buckets, "key"))  # buckets with two or more sets
    regs = reps.select("doc", "regs")
    ids = members.select("doc").distinct()

    def candidates(pairs: DataFrame) -> DataFrame:
        left, right = regs.select(F.col("doc").alias("a"), F.col("regs").alias("ra")), regs.select(F.col("doc").alias("b"), F.col("regs").alias("rb"))
        return estimates(pairs.join(left, "a").join(right, "b"), percent)

    stars = settled(candidates(members.where("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b")).distinct()))
    wanted = stars.select(F.col("a").alias("doc")).union(stars.select(F.col("b").alias("doc"))).union(ids).distinct()
    sets = settled(shingle_sets(docs.join(wanted, docs[id_col].cast("bigint") == wanted["doc"], "left_semi"), id_col, text_col, width))
    links = settled(confirmed(stars, sets, percent).where("link").select("a", "b"))
    found = components(links)
    named = members.join(found, members["doc"] == found["node"], "left").select("key", "doc", F.coalesce("component", "doc").alias("c"))
    apart = Observation()
    mixed_buckets = named.groupBy("key").agg(F.count("*").alias("n"), (F.min("c") < F.max("c")).alias("open")).where("open").select("key", "n")
    mixed_buckets = settled(mixed_buckets.observe(apart, F.count("*").alias("n")))
    if apart.get["n"]:
        lists = open_pairs(named.join(mixed_buckets, "key"), reps, percent)
        found = components(links.union(confirmed_lists(lists, sets, percent)))
    by_class = classes.join(found, classes["rep"] == found["node"], "left").select("digest", F.coalesce("component", "rep").alias("of_class"))
    out = full.select("doc", "n_shingles", "digest").join(by_class, "digest").select("doc", "n_shingles", "of_class")
    out = out.union(sketch.where("digest IS NULL").select("doc", "n_shingles", "doc"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", F.col("of_class").alias("component_id")).withColumn("kept", F.col(id_col) == F.col("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class of near copies: all columns of ``docs``.

    Rows that repeat an id are one document to begin with: the one whose values
    have the smallest hash stays (maps apart). Rows without an id stay.
    """
    ids = near_duplicates(docs, id_col, text_col, width, percent).where("kept").select(id_col).distinct()
    place, mark = free_name(docs, "__place"), F.xxhash64(*[col(f.name) for f in docs.schema.fields if not has_type(f.dataType, (T.MapType, T.VariantType))])
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(mark))
    chosen = docs.join(ids, id_col, "left_semi").withColumn(place, first).where(F.col(place) == 1).select(*[col(c) for c in docs.columns])
    return chosen.unionByName(docs.where(F.col(id_col).isNull()))
