"""Packed token-id matrices by best-fit-decreasing with a segment tree over free capacities."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.storage import small_enough, staged
from shelfcast.llm.tokens import ID_TYPE, text_slices, tokenizer

WIDTH = 1024
END_ID = 0
PAD_ID = 0
#: Token ids that are packed together: about 1,000 rows of a matrix. Bounds memory, not the data.
BLOCK = 1 << 20

_ROWS = (
    "part int, row long, tokens int, ids binary, cu_seqlens array<int>, position_ids binary, "
    "piece_ids array<long>, piece_starts array<long>, piece_doc_tokens array<long>"
)


class Capacities:
    """How many open rows have each free capacity, as a segment tree of their counts."""

    def __init__(self, width: int) -> None:
        self.size = 1 << width.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        node = self.size + capacity
        while node:
            self.counts[node] += by
            node >>= 1

    def smallest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open row has."""
        counts, node = self.counts, self.size + least
        if counts[node]:
            return least
        while node > 1:
            if not node & 1 and counts[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if counts[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Positions of ``lengths`` by row: longest first, each into the fullest row that has room."""
    free = Capacities(width)
    open_rows: list[list[int]] = [[] for _ in range(width + 1)]
    rows: list[list[int]] = []
    for at in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[at])
        capacity = free.smallest(need)
        if capacity is None:
            row, capacity = len(rows), width
            rows.append([])
        else:
            row = open_rows[capacity].pop()
            free.add(capacity, -1)
        rows[row].append(at)
        if capacity > need:
            open_rows[capacity - need].append(row)
            free.add(capacity - need, 1)
    return rows


def _block_rows(docs: list[tuple[int | None, bytes]], part: int, first_row: int) -> pa.RecordBatch:
    """The matrix rows of one block of (id, ids)."""
    pieces = [
        (doc, start, min(WIDTH, len(ids) // 2 - start))
        for doc, (_, ids) in enumerate(docs) for start in range(0, len(ids) // 2, WIDTH)
    ]
    out: list[dict] = []
    for n, row in enumerate(best_fit(np.array([p[2] for p in pieces]), WIDTH)):
        mine = [pieces[i] for i in row]
        lengths = [length for _, _, length in mine]
        filled = sum(lengths)
        # a row whose fill is a power of two keeps its length, others are filled up
        padded = filled if filled & (filled - 1) == 0 else WIDTH
        ids = b"".join(docs[doc][1][2 * start: 2 * (start + length)] for doc, start, length in mine)
        resets = [np.arange(length, dtype=ID_TYPE) for length in [*lengths, padded - filled]]
        out.append({
            "part": part, "row": first_row + n, "tokens": filled,
            "ids": ids + PAD_ID.to_bytes(2, "little") * (padded - filled),
            "cu_seqlens": np.cumsum([0, *lengths]).tolist(),
            "position_ids": np.concatenate(resets).tobytes(),
            "piece_ids": [docs[doc][0] for doc, _, _ in mine],
            "piece_starts": [start for _, start, _ in mine],
            "piece_doc_tokens": [len(docs[doc][1]) // 2 for doc, _, _ in mine],
        })
    schema = pa.schema([
        ("part", pa.int32()), ("row", pa.int64()), ("tokens", pa.int32()), ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("piece_ids", pa.list_(pa.int64())),
        ("piece_starts", pa.list_(pa.int64())), ("piece_doc_tokens", pa.list_(pa.int64())),
    ])
    return pa.RecordBatch.from_pylist(out, schema=schema)


def _pack(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokenizer(path), END_ID.to_bytes(2, "little")
        part, row, block, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, texts in text_slices(batch.column("text")):
                for doc, encoded in zip(ids[first: first + len(texts)], encoder.encode(texts), strict=True):
                    block.append((doc, encoded + end))
                    held += len(encoded) // 2 + 1
                    if held >= BLOCK:
                        out = _block_rows(block, part, row)
                        row, block, held = row + out.num_rows, [], 0
                        yield out
        if block:
            yield _block_rows(block, part, row)
        encoder.forget()

    return run


def write_matrices(
    docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the packed matrix below ``path`` and return it, one record per matrix row.

    ids holds a row's token ids, two bytes each and padded to ``WIDTH`` unless its fill is a power
    of two; cu_seqlens the cumulative lengths of its segments from 0; position_ids restarts at 0
    with each segment and with the padding; piece_ids, piece_starts and piece_doc_tokens name each
    segment's document, its first token there and the document's length.

    Each document is ended by ``END_ID``. One of more than ``WIDTH`` tokens is cut into full rows
    and a rest, so no token is lost. Packing happens inside the scan, in blocks of at least
    ``BLOCK`` tokens of one partition: nothing is shuffled, and a task holds one block and one
    document. Files are committed by Spark's writer, a lost task leaves none. Null and empty texts
    are the end id alone; ids may repeat or be null; other columns are not looked at; an empty
    table writes no row.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows.mapInArrow(_pack(vocabulary), _ROWS).write.option("compression", "zstd").parquet(path)
    return read_matrices(docs.sparkSession, path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(path)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], ID_TYPE).astype("<u4")
            cuts = r["cu_seqlens"]
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                row = (
                    r["piece_ids"][i], r["piece_starts"][i], b - a, zlib.crc32(ids[a:b]),
                    r["piece_doc_tokens"][i], r["sequence_id"], a,
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)


def pieces(matrices: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per segment, read from the matrix: its document, place there, place in the matrix
    and the crc32 of its ids as unsigned 32-bit numbers. sequence_id counts rows without gaps."""
    totals = matrices.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    ahead = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")
    first = small_enough(staged(totals.select("part", ahead.alias("first")), "matrix-offsets"), 32)
    numbered = matrices.join(first, "part").withColumn("sequence_id", F.col("first") + F.col("row"))
    return numbered.select(
        "ids", "cu_seqlens", "piece_ids", "piece_starts", "piece_doc_tokens", "sequence_id"
    ).mapInArrow(
        _unpack,
        "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    ).withColumnRenamed("id", id_col)
