"""Quality rules with n-gram perplexity bands.

The language model is an interpolated modified Kneser-Ney model over pairs of words,
one for each language. Texts are read once: each task turns its documents into chunks
of one language, in which a word is a number, and these are written to the shared
folder. Everything that follows works on the chunks:

1. A chunk's distinct pairs go to the hash partitions of their 64-bit keys, as sorted
   arrays of keys alone. A partition adds up what its chunks send (a pair comes once
   from each chunk, however often it occurs) and answers each chunk with the counts of
   its pairs; one of the chunks that have a pair is told to speak for it.
2. A chunk says about its words what the pairs tell that it speaks for. The words' own
   hash partitions add that up (continuations, followers by count) and answer likewise.
3. A chunk with all its answers gives the probabilities of its pairs, and these the
   perplexities of its documents.

Nothing is folded, broadcast or collected: the arrays grow with the corpus and so does
the number of partitions, which follows from the number of words. A pair or word gives
an entry of its own only if it stands in two different texts and after two different
words, so that neither a document nor its copies vouch for what only they say; all
else backs off.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from rowsight.llm.shared import bounded_batches, forget, settled
from rowsight.llm.words import STEP, mixed, slices, windows

#: words of a chunk, and entries of a hash partition (all that chunks send), about
WORDS_PER_CHUNK = 1 << 21
ENTRIES_PER_PART = 1 << 21
#: pairs are counted in so many rounds, each with the pairs of its share of the left words, so
#: that no more than that share of them lies in shuffle files or in a task's memory at a time
ROUNDS = 4
#: chunks meet their answers, and words their sums, in so many turns, for the same reason
TURNS = 4
#: the word before a text's first
START = np.uint64(1)
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
REPEAT_WIDTH = 8
#: log-perplexities are binned to thousandths for medians
BIN = 1000
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside a window of 8 words that occurs twice or more."""
    w = windows(hashes, REPEAT_WIDTH)
    if len(w) < 2:
        return 0
    _, at, n = np.unique(w, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    if not twice.any():
        return 0
    steps = np.zeros(len(hashes) + 1, np.int64)
    steps[:-REPEAT_WIDTH] += twice
    steps[REPEAT_WIDTH:] -= twice
    return int((np.cumsum(steps)[:-1] > 0).sum())


def repeated_lines(body: bytes) -> int:
    lines = [x for x in body.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _blob(values: np.ndarray | bytes) -> bytes:
    """Arrays travel and lie on disk compressed, bytes of equal weight side by side: the upper ones shrink to nothing."""
    if isinstance(values, np.ndarray):
        values = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return zstandard.compress(values, 1)


def _array(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Keys as differences, which are small where keys are sorted."""
    return _blob(np.diff(keys, prepend=np.uint64(0)))


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_array(blob, np.uint64), dtype=np.uint64)


class Chunk(dict):
    """Documents of one language: word -> number, the documents' numbers in order, and their features."""

    def __init__(self):
        super().__init__()
        self.rows, self.seqs, self.size = [], [], 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def add(self, doc: pa.Scalar, text: str | None) -> None:
        body = (text or "").encode()
        words = body.split()
        seq = np.fromiter(map(self.__getitem__, words), np.uint32, len(words))
        if text:
            counts = (len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated_lines(body), repeated_words(mixed(seq.astype(np.uint64) + START)))
        else:
            counts = (0, 0, 0, 0)
        self.rows.append((doc, len(words), *counts, xxhash.xxh3_64_intdigest(body) >> 48))
        self.seqs.append(seq)
        self.size += len(words)

    def batch(self, tongue: int, lang: str | None, kind: pa.DataType) -> pa.RecordBatch:
        doc, *counts, own = zip(*self.rows)
        features = pa.RecordBatch.from_arrays([pa.array(doc, kind), *[pa.array(c, pa.int64()) for c in counts]], names=["doc", *FEATURES])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, features.schema) as out:
            out.write_batch(features)
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, self), np.uint64, len(self))
        seq = np.concatenate(self.seqs)
        # frequent words get small numbers, equally frequent ones go by hash: both shrink
        order = np.lexsort((words, -np.bincount(seq, minlength=len(words))))
        number = np.empty(len(words), np.uint32)
        number[order] = np.arange(len(words), dtype=np.uint32)
        blobs = [_blob(sink.getvalue().to_pybytes()), _steps(words[order]), _blob(number[seq]), _blob(np.array(counts[0], np.int64)), _blob(np.array(own, np.uint16))]
        # a chunk's number is drawn once and stays, since chunks are written before they are used
        number = int.from_bytes(os.urandom(8), "little", signed=True)
        arrays = [pa.array([tongue], pa.int64()), pa.array([lang], pa.string()), pa.array([number], pa.int64()), pa.array([self.size], pa.int64())]
        return pa.RecordBatch.from_arrays([*arrays, *[pa.array([b], pa.binary()) for b in blobs]], names=CHUNK)


CHUNK = ["tongue", "lang", "chunk", "size", "features", "words", "seq", "sizes", "own"]
CHUNK_SCHEMA = "tongue bigint, lang string, chunk bigint, size bigint, features binary, words binary, seq binary, sizes binary, own binary"


def chunks(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One row for each chunk: its language, its distinct words' hashes and its documents as numbers of words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in slices(batches, 3):
            kind = batch.schema.field(0).type
            for doc, tongue, lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                chunk = held.setdefault(tongue, (Chunk(), lang))[0]
                chunk.add(doc, text)
                if chunk.size > WORDS_PER_CHUNK or len(chunk.rows) >= 100_000:
                    del held[tongue]
                    yield chunk.batch(tongue, lang, kind)
            if sum(c.size for c, _ in held.values()) > 2 * WORDS_PER_CHUNK:
                for tongue, (chunk, lang) in held.items():
                    yield chunk.batch(tongue, lang, kind)
                held = {}
        for tongue, (chunk, lang) in held.items():
            yield chunk.batch(tongue, lang, kind)

    lang = F.col(lang_col).cast("string")
    # an id that is a struct loses its fields' not-null marks, which the result's schema can't state
    doc = F.col(id_col).cast(docs.select(id_col).schema[0].dataType.simpleString()).alias("doc")
    rows = docs.select(doc, F.xxhash64(lang).alias("tongue"), lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, CHUNK_SCHEMA)


def _pairs(row: dict, turn: int, rounds: int):
    """Distinct pairs of a chunk whose left words have this turn: numbers of left and right word (the
    start has the number after the last), occurrences, least and greatest hash of a text that has it
    and of the word before it (of 16 bits: two that differ pass for one in 1 of 65,536 cases), the
    places of their occurrences, and the pair of each. None if there are none."""
    seq, sizes = row["seq"], row["sizes"]
    hashes = np.append(row["words"], START)
    start = len(hashes) - 1
    left = np.empty(len(seq), np.uint32)
    left[1:] = seq[:-1]
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    left[first] = start
    mine = np.flatnonzero((hashes % np.uint64(rounds) == turn)[left])
    if not len(mine):
        return None
    texts = np.repeat(row["own"], sizes)
    before = np.empty(len(seq), np.uint16)
    before[1:] = (hashes >> np.uint64(48)).astype(np.uint16)[left[:-1]]
    before[first] = texts[first]  # before a text's start stands the text itself
    code = left[mine] * np.uint64(len(hashes)) + seq[mine]
    order = np.argsort(code)
    code = code[order]
    fresh = np.concatenate([[True], code[1:] != code[:-1]])
    starts = np.flatnonzero(fresh)
    at = np.empty(len(mine), np.uint32)
    at[order] = np.cumsum(fresh, dtype=np.uint32) - np.uint32(1)
    codes, places = code[starts], mine[order]
    ends = [f.reduceat(x[places], starts) for x in (texts, before) for f in (np.minimum, np.maximum)]
    left, right = np.divmod(codes, np.uint64(len(hashes)))
    return left.astype(np.int64), right.astype(np.int64), np.diff(np.append(starts, len(mine))).astype(np.uint32), ends, mine, at


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(left + STEP) * STEP + right)


def _dealt(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its keys, smallest first) for each of ``parts`` ranges of keys that gets any."""
    order = np.argsort(keys)
    part = ((keys[order] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for first, places in zip(part[np.append(0, cuts)], np.split(order, cuts)):
        yield int(first), places


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            row["words"] = _keys(row["words"])
            for name, kind in (("seq", np.uint32), ("sizes", np.int64), ("own", np.uint16)):
                row[name] = _array(row[name], kind)
            yield row


def _merged(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, where each distinct one starts in it, and the number of each key among the distinct."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(fresh) - 1
    return order, np.flatnonzero(fresh), at


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[_array(x.as_py(), kind) for x in table.column(name) if x.is_valid]])


#: what partitions give: answers to chunks, counts of counts
ANSWERS = pa.schema([("tongue", pa.int64()), ("chunk", pa.int64()), ("part", pa.int64()), ("values", pa.binary()), ("counts", pa.list_(pa.int64()))])
ANSWER_SQL = "tongue bigint, chunk bigint, part bigint, values binary, counts array<bigint>"
#: a pair's key, occurrences, and hashes of texts and of words before it
PAIRS = ["keys", "n", "low", "high", "least", "most"]
#: what a chunk says about its words: followers in all, with one, two and more occurrences; continuations; least and greatest text hash
SAID = pa.schema([("tongue", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("sums", pa.binary())])
#: how each of these is folded
FOLDS = [np.add] * 5 + [np.minimum, np.maximum]
SUMS = len(FOLDS)


def sent_pairs(row: dict, turn: int, rounds: int, parts: int) -> Iterator[pa.RecordBatch]:
    """What a chunk sends to the ``parts`` partitions of one round."""
    found = _pairs(row, turn, rounds)
    if found is None:
        return
    hashes = np.append(row["words"], START)
    left, right, n, (low, high, least, most), _, _ = found
    keys = _pair_keys(hashes[left], hashes[right])
    for part, p in _dealt(keys, parts):
        # greatest hashes as differences from the least, which are mostly 0, so that they compress
        columns = [_steps(keys[p]), *[_blob(c) for c in (n[p], low[p], (high - low)[p], least[p], (most - least)[p])]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int64()) for v in (row["tongue"], turn * parts + part, row["chunk"])] + [pa.array([c], pa.binary()) for c in columns],
            names=["tongue", "part", "chunk", *PAIRS],
        )


def count_pairs(parted: DataFrame, turn: int, rounds: int, parts: int) -> DataFrame:
    """Pairs of one round counted: answers (chunk, part, values) and counts of counts.

    A value holds 4 times a pair's occurrences in the language, 2 if it gives an entry, and 1 for
    the one chunk that speaks for it; to the others a pair without an entry is 0.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _of_chunks(batches):
            yield from sent_pairs(row, turn, rounds, parts)

    def merge(table: pa.Table) -> pa.Table:
        tongue = table.column("tongue")[0].as_py()
        keys = [_keys(x.as_py()) for x in table.column("keys")]
        ends = np.cumsum([len(x) for x in keys])
        order, starts, at = _merged(np.concatenate(keys))
        del keys
        n = np.add.reduceat(_joined(table, "n", np.uint32)[order].astype(np.int64), starts)
        low, least = (_joined(table, x, np.uint16) for x in ("low", "least"))
        high, most = low + _joined(table, "high", np.uint16), least + _joined(table, "most", np.uint16)
        entry = np.ones(len(n), bool)
        for a, b in ((low, high), (least, most)):
            entry &= np.minimum.reduceat(a[order], starts) < np.maximum.reduceat(b[order], starts)
        values = np.where(entry, 4 * n + 2, 0)[at]
        values[order[starts]] = 4 * n + 2 * entry + 1
        rows = [{"tongue": tongue, "counts": [int((n == i).sum()) for i in range(1, 5)]}]
        for chunk, part, mine in zip(table.column("chunk").to_pylist(), table.column("part").to_pylist(), np.split(values, ends[:-1])):
            rows.append({"tongue": tongue, "chunk": chunk, "part": part, "values": _blob(mine)})
        return pa.Table.from_batches([_rows(rows, ANSWERS)])

    sent = parted.mapInArrow(send, "tongue bigint, part bigint, chunk bigint, " + ", ".join(f"{c} binary" for c in PAIRS))
    return sent.groupBy("tongue", "part").applyInArrow(merge, ANSWER_SQL)


def _answered(row: dict, values: dict[int, bytes], rounds: int, parts: int):
    """Left and right words, values, places of occurrences and pair of each, for the pairs of each round in turn."""
    hashes = np.append(row["words"], START)
    for turn in range(rounds):
        found = _pairs(row, turn, rounds)
        if found is not None:
            left, right, _, _, mine, at = found
            out = np.empty(len(left), np.int64)
            for part, p in _dealt(_pair_keys(hashes[left], hashes[right]), parts):
                out[p] = _array(values[turn * parts + part], np.int64)
            yield left, right, out, mine, at


def say_words(chunks: DataFrame, counted: DataFrame, rounds: int, parts: int) -> DataFrame:
    """(tongue, part, chunk, words, sums): what the pairs that a chunk speaks for, and its texts, say about its words."""

    def say(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = next(_of_chunks(chunk.combine_chunks().to_batches()))
        hashes = np.append(row["words"], START)
        size = len(hashes)
        sums = np.zeros((SUMS, size), np.int64)
        for left, right, values, _, _ in _answered(row, dict(zip(answers.column("part").to_pylist(), answers.column("values").to_pylist())), rounds, parts):
            mine = values & 1 == 1
            n, left = values[mine] >> 2, left[mine]
            sums[0] += np.bincount(left, n, size).astype(np.int64)
            for i, some in enumerate((n == 1, n == 2, n > 2), 1):
                sums[i] += np.bincount(left[some], minlength=size)
            sums[4] += np.bincount(right[mine], minlength=size)
        texts = np.repeat(row["own"], row["sizes"])
        low, high = np.full(size, 0xFFFF, np.uint16), np.zeros(size, np.uint16)
        np.minimum.at(low, row["seq"], texts), np.maximum.at(high, row["seq"], texts)
        # two texts are enough: which ones they are need not travel
        sums[5], sums[6] = np.where(low < high, 0, low), np.where(low < high, 1, high)
        # nearly all differences are 0, so that they compress
        sums[0] -= sums[1]
        sums[6] -= sums[5]
        rows = [{"tongue": row["tongue"], "part": part, "chunk": row["chunk"], "words": _steps(hashes[p]), "sums": _blob(sums[:, p])} for part, p in _dealt(hashes, rounds * parts)]
        return pa.Table.from_batches([_rows(rows, SAID)])

    answers = counted.where("chunk IS NOT NULL").select("chunk", "part", "values")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(say, "tongue bigint, part bigint, chunk bigint, words binary, sums binary")


def count_words(said: DataFrame) -> DataFrame:
    """Sums of all words, as answers to chunks, and per language: counts of continuation counts, continuations, words."""

    def answer(table: pa.Table) -> pa.Table:
        tongue = table.column("tongue")[0].as_py()
        words = [_keys(x.as_py()) for x in table.column("words")]
        ends = np.cumsum([len(x) for x in words])
        order, starts, at = _merged(np.concatenate(words))
        sums = np.concatenate([_array(x.as_py(), np.int64).reshape(SUMS, -1) for x in table.column("sums")], axis=1)
        sums[0] += sums[1]
        sums[6] += sums[5]
        found = np.array([fold.reduceat(x[order], starts) for fold, x in zip(FOLDS, sums)])
        n = found[4]
        rows = [{"tongue": tongue, "counts": [*[int((n == i).sum()) for i in range(1, 5)], int((n > 2).sum()), int(n.sum()), int((n > 0).sum())]}]
        found = np.concatenate([found[:5], [(found[5] < found[6]) & (n > 1)]])
        for chunk, part, mine in zip(table.column("chunk").to_pylist(), table.column("part").to_pylist(), np.split(at, ends[:-1])):
            rows.append({"tongue": tongue, "chunk": chunk, "part": -1 - part, "values": _blob(found[:, mine])})
        return pa.Table.from_batches([_rows(rows, ANSWERS)])

    return said.groupBy("tongue", "part").applyInArrow(answer, ANSWER_SQL)


def discounts(counts: list[int]) -> list[float]:
    """Those of Chen and Goodman from the numbers of entries met one to four times; 0.5, 1 and 1.5 where one is 0."""
    if min(counts[:4]) == 0:
        return [0.5, 1.0, 1.5]
    y = counts[0] / (counts[0] + 2 * counts[1])
    return [max(0.05, min(i * 0.95, i - (i + 1) * y * counts[i] / counts[i - 1])) for i in (1, 2, 3)]


def log_probabilities(n: np.ndarray, left: np.ndarray, right: np.ndarray, pairs: list[int], words: list[int]) -> np.ndarray:
    """ln p of pairs seen ``n`` times (0: no entry of its own), from the sums of their words and their language's counts."""
    d = np.array([0.0, *discounts(words)])
    total, types = words[5], words[6]
    freed = d[1] * words[0] + d[2] * words[1] + d[3] * words[4]
    held = np.where(right[5] > 0, right[4] - d[np.minimum(right[4], 3)], 0)
    lower = (held + freed / types) / total
    d = np.array([0.0, *discounts(pairs)])
    return np.log((n - d[np.minimum(n, 3)] + (d[1] * left[1] + d[2] * left[2] + d[3] * left[3]) * lower) / left[0])


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(doc, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_perplexity).

    log_perplexity is the mean over words of -ln p; null without words.
    """
    kind = docs.select(F.col(id_col).alias("doc")).schema["doc"].dataType.simpleString()
    parted = settled(chunks(docs, id_col, text_col, lang_col))
    parts = max(1, -(-(parted.agg(F.sum("size")).first()[0] or 0) // ENTRIES_PER_PART))
    rounds = min(ROUNDS, parts)
    parts = -(-parts // rounds)
    counts = [settled(count_pairs(parted, turn, rounds, parts)) for turn in range(rounds)]
    counted = reduce(DataFrame.union, counts)
    in_turn = lambda rows, turn: rows.where(F.pmod("chunk", F.lit(TURNS)) == turn)
    said = [settled(say_words(in_turn(parted, turn).where("size > 0"), in_turn(counted, turn), rounds, parts)) for turn in range(TURNS)]
    words = [settled(count_words(reduce(DataFrame.union, said).where(F.col("part") % TURNS == turn))) for turn in range(TURNS)]
    worded = reduce(DataFrame.union, words)
    for table in said:
        forget(table)

    def constants(rows: DataFrame, width: int, name: str) -> DataFrame:
        return rows.where("counts IS NOT NULL").groupBy("tongue").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(width)]).alias(name))

    # a chunk without words finds neither; one row for each language
    known = parted.join(constants(counted, 4, "pairs"), "tongue", "left").join(constants(worded, 7, "terms"), "tongue", "left")
    answers = counted.union(worded).where("chunk IS NOT NULL").select("chunk", "part", "values")

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = next(_of_chunks(chunk.combine_chunks().to_batches()))
        out = pa.ipc.open_stream(zstandard.decompress(row["features"])).read_all()
        sizes = row["sizes"]
        logs = np.zeros(len(row["seq"]) + 1)
        if row["size"]:
            values = dict(zip(answers.column("part").to_pylist(), answers.column("values").to_pylist()))
            hashes = np.append(row["words"], START)
            sums = np.empty((6, len(hashes)), np.int64)
            for part, p in _dealt(hashes, rounds * parts):
                sums[:, p] = _array(values[-1 - part], np.int64).reshape(6, -1)
            for left, right, found, mine, at in _answered(row, values, rounds, parts):
                n = np.where(found & 2, found >> 2, 0)
                logs[1 + mine] = log_probabilities(n, sums[:, left], sums[:, right], row["pairs"], row["terms"])[at]
            np.cumsum(logs, out=logs)
        ends = np.cumsum(sizes)
        with np.errstate(invalid="ignore"):
            means = (logs[ends - sizes] - logs[ends]) / sizes
        lang = pa.array([row["lang"]] * len(sizes), pa.string())
        scored = pa.array(means, pa.float64(), mask=sizes == 0)
        return pa.table([out.column(0), lang, *out.columns[1:], scored], names=["doc", "lang", *FEATURES, "log_perplexity"])

    schema = f"doc {kind}, lang string, {', '.join(f + ' bigint' for f in FEATURES)}, log_perplexity double"
    scored = [settled(in_turn(known, turn).groupBy("chunk").cogroup(in_turn(answers, turn).groupBy("chunk")).applyInArrow(score, schema)) for turn in range(TURNS)]
    for table in (parted, *counts, *words):
        forget(table)
    return reduce(DataFrame.union, scored)


def bands(scored: DataFrame, below: float, above: float, floor: float) -> DataFrame:
    """(lang, lower, upper): the median log-perplexity of a language's documents that pass the
    base rules, less ``below`` and plus ``above`` times their median absolute deviation (``floor`` at least).

    Medians come from counts per thousandth, so they are exact on that grid, fold
    before the shuffle, and don't depend on how rows are dealt.
    """
    bins = settled(
        scored.where("NOT base_failed AND log_perplexity IS NOT NULL")
        .groupBy("lang", F.round(F.col("log_perplexity") * BIN).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    )

    def median(rows: DataFrame, x: str, name: str) -> DataFrame:
        ranked = rows.selectExpr("lang", x, f"sum(n) OVER (PARTITION BY lang ORDER BY {x}) AS up_to", "sum(n) OVER (PARTITION BY lang) AS total")
        return ranked.where("2 * up_to >= total").groupBy("lang").agg(F.min(x).alias(name))

    middle = median(bins, "bin", "middle")
    away = bins.alias("b").join(middle.alias("m"), F.col("b.lang").eqNullSafe(F.col("m.lang"))).selectExpr("b.lang", "abs(bin - middle) AS off", "n")
    spread = median(away.groupBy("lang", "off").agg(F.sum("n").alias("n")), "off", "spread")
    return middle.alias("m").join(spread.alias("s"), F.col("m.lang").eqNullSafe(F.col("s.lang"))).selectExpr(
        "m.lang",
        f"(middle - {below}D * greatest(spread, {floor * BIN}D)) / {BIN}D AS lower",
        f"(middle + {above}D * greatest(spread, {floor * BIN}D)) / {BIN}D AS upper",
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = 20.0, above: float = 10.0, floor: float = 0.1) -> DataFrame:
    """Counts, perplexity and verdict for each row of ``docs``.

    Words are runs without ASCII white space, of whole texts. base_failed: fewer than
    20 words, or over 30 % of the words inside repeated windows of 8. kept: not
    base_failed and inside the language's band, which is wider below than above: copies
    that were edited read more smoothly than other clean texts. Null texts have no words and fail. A
    null language is a language of its own. Rows that repeat an id are judged each.
    An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = features(docs, id_col, text_col, lang_col).withColumn("base_failed", failed)
    limits = bands(scored, below, above, floor)
    # one row for each language: adaptive execution broadcasts it, and splits a hot language if not
    out = scored.alias("d").join(limits.alias("l"), F.col("d.lang").eqNullSafe(F.col("l.lang")), "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.select(F.col("doc").alias(id_col), "d.lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "lower", "upper", "base_failed", (~F.col("base_failed") & inside).alias("kept"))
