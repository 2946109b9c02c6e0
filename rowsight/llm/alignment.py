"""Alignment of two tokenizers over the same texts.

The first tokenizer is a byte-level BPE that reads a space and the text, the second a
piece model that adds the space itself; both must give back the bytes of space and
text. Texts are shuffled whole and each distinct one is read once, however many
documents hold it; its multiplicity weights what it adds to corpus counts, and its
measures are joined back to the documents by digest.

Within a text the ends of all tokens of both sides cut the bytes into intervals. Each
interval lies in one token of either side, and two tokens that overlap share exactly
one interval, so the intervals are the links. Where both sides end, a group closes.

A task keeps a chunk of texts together: the chunk's distinct id pairs once, sorted, and
for each text the places of its pairs among them. Corpus counts are folded per chunk
before they are shuffled, and come back to a chunk once for each of its distinct pairs,
not for each link; nothing is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rowsight.functions.scalars import col
from rowsight.llm.shared import bounded_batches, free_name, settled
from rowsight.llm.tokens import Encoder
from rowsight.llm.words import slices

PIECES = "piece_bpe_32k.model"
#: bytes of text of a chunk
CHUNK = 8 << 20

_CHUNKS = """chunk bigint, pairs array<bigint>, held array<bigint>, digests array<binary>, n_a array<bigint>, n_b array<bigint>,
n_groups array<bigint>, n_links array<bigint>, shas array<string>, groups array<string>, sizes array<int>, places array<int>, times array<int>"""
_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_level() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, back to the byte:
    printable Latin-1 stands for itself, the others for characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Sides:
    """Both tokenizers with the bytes of their tokens and the texts of their ids."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None, pieces: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.first = Encoder(special=False, vocabulary=vocabulary, ranks=ranks)
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path(PIECES))
        back, table = byte_level(), self.first.exact.get_vocab()
        a: list[bytes] = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        b = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            b.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes_a, self.bytes_b = a, b
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
        # ids with what follows them: "," inside a group, "|" after its first side, ";" after its second
        self.signs = [f"{i}{end}" for count, ends in ((len(a), ",|"), (len(b), ",;")) for end in ends for i in range(count)]
        n, m = len(a), len(b)
        self.starts = np.array([[0, n], [2 * n, 2 * n + m]], np.int64)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None where a side's bytes are not those of space and text."""
        body = (" " + text).encode()
        a, b = self.first(" " + text), self.second.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != body or b"".join(map(self.bytes_b.__getitem__, b)) != body:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token numbers of each link, and the group of each token of either side."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(ends_a, ends_b)
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)

    def written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: ids of both sides, group by group."""
        codes = np.concatenate([
            a + self.starts[0][np.append(np.diff(group_a), 1)],
            b + self.starts[1][np.append(np.diff(group_b), 1)],
        ])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        return "".join(map(self.signs.__getitem__, codes[order].tolist()))[:-1]


def chunks(texts: DataFrame, with_groups: bool) -> DataFrame:
    """Distinct texts (text, n) read and aligned, a row for each chunk of them."""

    def chunk(sides: Sides, number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        measures, shas, written = np.zeros((4, n), np.int64), [""] * n, [""] * n
        keys, owners = [], []
        texts_ = batch.column(0).to_pylist()
        for i, text in enumerate(texts_):
            found = sides(text)
            if found is None:
                continue
            a, b = found
            at_a, at_b, group_a, group_b = sides.align(a, b)
            groups = sides.written(a, b, group_a, group_b)
            measures[:, i] = len(a), len(b), group_a[-1] + 1, len(at_a)
            shas[i] = hashlib.sha256(groups.encode()).hexdigest()
            if with_groups:
                written[i] = groups
            keys.append((a[at_a] << 32) | b[at_b])
            owners.append(np.full(len(at_a), i, np.int64))
        links, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, owners))
        pairs, place = np.unique(links, return_inverse=True)
        own, times = np.unique(owner * max(1, len(pairs)) + place, return_counts=True)
        owner, place = own // max(1, len(pairs)), own % max(1, len(pairs))
        many = batch.column(1).to_numpy()
        held = np.zeros(len(pairs), np.int64)
        np.add.at(held, place, many[owner])
        digests = [hashlib.sha256(t.encode()).digest() for t in texts_]
        columns = [
            number, pairs, held, digests, *measures, shas, written if with_groups else None,
            np.bincount(owner, minlength=n).astype(np.int32), place.astype(np.int32), times.astype(np.int32),
        ]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, out)], schema=out)

    list_ = pa.list_
    out = pa.schema([
        ("chunk", pa.int64()), ("pairs", list_(pa.int64())), ("held", list_(pa.int64())), ("digests", list_(pa.binary())),
        *((x, list_(pa.int64())) for x in _MEASURES[:4]), ("shas", list_(pa.string())), ("groups", list_(pa.string())),
        ("sizes", list_(pa.int32())), ("places", list_(pa.int32())), ("times", list_(pa.int32())),
    ])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, part, held, size, number = None, TaskContext.get().partitionId(), [], 0, 0
        for batch in slices(batches, 0, CHUNK):
            sides = sides or Sides()
            bytes_ = batch.column(0).nbytes
            if held and size + bytes_ > CHUNK:
                yield chunk(sides, part << 32 | number, pa.concat_batches(held))
                held, size, number = [], 0, number + 1
            held.append(batch)
            size += bytes_
        if held:
            yield chunk(sides, part << 32 | number, pa.concat_batches(held))

    return texts.mapInArrow(task, _CHUNKS)


def pair_counts(cut: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each id pair linked, and whether no pair of its first id has more.

    A pair is the first side's id in the high 32 bits and the second's in the low ones.
    """
    found = cut.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))
    # an id has at most as many partners as the other vocabulary has pieces
    return found.selectExpr("pair", "n", "n = max(n) OVER (PARTITION BY shiftright(pair, 32)) AS best")


def measured(cut: DataFrame, counts: DataFrame) -> DataFrame:
    """(digest, measures, groups_sha256, groups): a row for each distinct text."""
    asked = cut.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(counts, "pair").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("told"))
    told = told.select("chunk", F.col("told.n").alias("counts"), F.col("told.best").alias("bests"))

    def values(column: pa.Array) -> np.ndarray:
        return column.values.slice(column.offsets[0].as_py(), column.offsets[1].as_py() - column.offsets[0].as_py()).to_numpy(zero_copy_only=False)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name).slice(i, 1) for name in batch.schema.names}
                n_texts = len(values(row["sizes"]))
                best_sum = sums = np.zeros(n_texts, np.int64)
                if row["counts"][0].is_valid:
                    place, times = values(row["places"]), values(row["times"]).astype(np.int64)
                    owner = np.repeat(np.arange(n_texts), values(row["sizes"]))
                    best_sum, sums = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
                    np.add.at(best_sum, owner, times * values(row["bests"])[place])
                    np.add.at(sums, owner, times * values(row["counts"])[place])
                groups = row["groups"].flatten() if row["groups"][0].is_valid else pa.nulls(n_texts, pa.string())
                columns = [row["digests"].flatten(), *(row[x].flatten() for x in _MEASURES[:4]), pa.array(best_sum), pa.array(sums), row["shas"].flatten(), groups]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", *_MEASURES, "groups_sha256", "groups"])

    rows = cut.drop("pairs", "held").join(told, "chunk", "left")
    return rows.mapInArrow(task, "digest binary, " + "".join(f"{x} bigint, " for x in _MEASURES) + "groups_sha256 string, groups string")


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns ``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs``.

    n_best: links whose pair no other pair of its first id exceeds in documents;
    count_sum: documents of each link's pair, added up. ``with_groups`` adds the groups
    themselves as ``groups``. Texts that are null, empty, or not given back byte by byte by
    both tokenizers have zeros and ''. Rows that repeat an id or a text are documents of
    their own. An empty table gives an empty result. A kept column named like a result
    stays, and the result's name gets underscores.
    """
    bounded_batches(docs.sparkSession)
    text = col(text_col).cast("string")
    texts = docs.select(text.alias("text")).where(F.col("text") != "").groupBy("text").agg(F.count("*").alias("n"))
    cut = settled(chunks(texts, with_groups))
    found = measured(cut, settled(pair_counts(cut)))
    kept = docs.select(col(id_col), *map(col, keep))
    key = free_name(kept, "__digest")
    rows = docs.select(col(id_col), *map(col, keep), F.unhex(F.sha2(text, 256)).alias(key))
    # one row for each digest; adaptive execution splits the documents of a hot one
    names = [*_MEASURES, "groups_sha256", *(["groups"] if with_groups else [])]
    met = rows.join(found.select(F.col("digest").alias(key), F.struct(*names).alias(free_name(kept, "__found"))), key, "left")
    values = [F.coalesce(F.col(free_name(kept, "__found"))[x], F.lit(0).cast("bigint") if x in _MEASURES else F.lit("")).alias(free_name(kept, x)) for x in names]
    return met.select(col(id_col), *map(col, keep), *values)
