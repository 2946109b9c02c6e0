"""Document lengths from flat token files by a scan for the end-of-document id.

A flat file is nothing but token ids one after another, without an index. It is read
in blocks, of a size that has nothing to do with documents. Each block is searched for
the separator in one vectorised comparison; boundaries that lie in different blocks
are stitched by a prefix scan over what the blocks report: how many separators each
has, and where its last one is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowsight.llm.shared import bounded_batches
from rowsight.llm.tokens import END_ID, Encoder
from rowsight.llm.words import slices

#: tokens of a block
BLOCK = 1 << 18


def flat_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ids_per_file: int = 4096, separator: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Blocks (file, block, data) of flat files of little-endian uint16 ids.

    A file holds the documents whose ids lie in one range of ``ids_per_file`` ids, in
    order of id and then text, each followed by the separator. Texts are encoded
    whole; an end-of-text string in a text is ordinary text there. Null texts have no
    tokens but the separator. Rows with a null id are in file null.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, 2):
            encoder = encoder or Encoder(special=False)
            data = [encoder.array(t, separator).astype("<u2").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["file", "doc", "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        file, number, held, size = none, 0, [], 0

        def blocks(rest: bool):
            nonlocal number, held, size
            data = b"".join(held)
            whole = len(data) // (2 * block) * 2 * block
            cuts = list(range(0, whole, 2 * block))
            parts = [data[a : a + 2 * block] for a in cuts] + ([data[whole:]] if rest and len(data) > whole else [])
            held, size = ([] if rest else [data[whole:]]), (0 if rest else len(data) - whole)
            out = [(file, number + i, p) for i, p in enumerate(parts)]
            number += len(parts)
            return out

        for batch in batches:
            out = []
            for f, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if f != file:
                    if file is not none:
                        out += blocks(True)
                    file, number = f, 0
                held.append(data)
                size += len(data)
                if size >= 2 * block:
                    out += blocks(False)
            if out:
                yield _rows(out)
        if file is not none and held:
            yield _rows(blocks(True))

    def _rows(out):
        f, n, d = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.binary())], names=["file", "block", "data"])

    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.floor(F.col(id_col) / ids_per_file).cast("bigint").alias("file"), F.col(id_col).cast("bigint").alias("doc"), text.alias("text"))
    encoded = rows.mapInArrow(encode, "file bigint, doc bigint, data binary")
    # all of a file in one task, files in some order: its documents are at most ``ids_per_file`` ids' worth
    dealt = encoded.repartition("file").sortWithinPartitions("file", "doc", "data").select("file", "data")
    return dealt.mapInArrow(write, "file bigint, block bigint, data binary")


def read_files(spark: SparkSession, path: str, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Blocks (file, block, data) of existing flat files, file being the path; each file up to 2 GB."""
    width = np.dtype(dtype).itemsize * block
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    number = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / width).cast("bigint")))
    blocks = files.select(F.col("path").alias("file"), number.alias("block"), "content")
    return blocks.select("file", "block", F.substring("content", (F.col("block") * width + 1).cast("int"), F.lit(width)).alias("data"))


def documents(blocks: DataFrame, separator: int = END_ID, dtype: str = "<u2", file: str = "file", block: str = "block", data: str = "data") -> DataFrame:
    """(file, document, start, n_tokens, closed) of every document in flat files.

    ``blocks``: any blocks of whole tokens, numbered in order within their file. document counts from 0
    within the file, start is the place of its first token, n_tokens leaves out the
    separator. Tokens after a file's last separator are a document that isn't closed.
    Empty documents have 0 tokens; empty and null blocks are none; files without tokens give no rows.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, sizes = [], []
            for body in batch.column(2).to_pylist():
                ids = np.frombuffer(body, dtype)
                ends.append(np.flatnonzero(ids == separator))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "size", "ends"])

    rows = blocks.select(F.col(file).alias("file"), F.col(block).cast("bigint").alias("block"), F.col(data).alias("data")).where("data IS NOT NULL AND length(data) > 0")
    kind = rows.schema["file"].dataType.simpleString()
    found = rows.mapInArrow(search, f"file {kind}, block bigint, size bigint, ends array<bigint>")
    # the prefix scan: tokens and separators before each block, and the last separator before it
    found = found.selectExpr(
        "*",
        "sum(size) OVER (PARTITION BY file ORDER BY block) - size AS at",
        "sum(cast(size(ends) AS bigint)) OVER (PARTITION BY file ORDER BY block) - size(ends) AS before",
        "lead(block) OVER (PARTITION BY file ORDER BY block) IS NULL AS is_last",
    )
    last = "max(CASE WHEN size(ends) > 0 THEN at + element_at(ends, -1) END) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    found = found.selectExpr("*", f"coalesce({last}, -1) AS carried")
    # each separator closes a document that starts after the one before it
    closed = found.selectExpr("file", "before", "at", "ends", "carried", "posexplode(ends) AS (i, end)").selectExpr(
        "file", "before + i AS document", "CASE WHEN i = 0 THEN carried + 1 ELSE at + ends[i - 1] + 1 END AS start", "at + end AS stop", "true AS closed"
    )
    tail = found.where("is_last").selectExpr("file", "before + size(ends) AS document", "CASE WHEN size(ends) > 0 THEN at + element_at(ends, -1) + 1 ELSE carried + 1 END AS start", "at + size AS stop", "false AS closed").where("start < stop")
    return closed.union(tail).selectExpr("file", "document", "start", "stop - start AS n_tokens", "closed")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ids_per_file: int = 4096) -> DataFrame:
    """id_col, file, document, start, n_tokens for each row of ``docs``, from a scan of the flat files they make.

    The scan knows only places; documents are named by their order in the file. Rows that
    repeat an id are told apart by order only, so among them the tokens may change places.
    """
    found = documents(flat_files(docs, id_col, text_col, ids_per_file))
    ids = docs.select(F.floor(F.col(id_col) / ids_per_file).cast("bigint").alias("f"), F.col(id_col).cast("bigint").alias("doc"))
    order = ids.selectExpr("f", "doc", "row_number() OVER (PARTITION BY f ORDER BY doc) - 1 AS n")
    return found.where("closed").join(order, F.col("file").eqNullSafe(F.col("f")) & (F.col("document") == F.col("n"))).select(F.col("doc").alias(id_col), "file", "document", "start", "n_tokens")
