"""Concatenate and cut: token streams into fixed windows by global prefix sums."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.storage import small_enough, staged
from shelfcast.llm.tokens import ID_TYPE, text_slices, tokenizer

WINDOW = 1024
END_ID = 0

_PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokenizer(path), END_ID.to_bytes(2, "little")
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                ids = [x + end for x in encoder.encode(texts)]
                sizes = np.array([len(x) // 2 for x in ids], dtype="i8")
                before = total + np.cumsum(sizes) - sizes
                total += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, len(texts)), pa.array(np.full(len(ids), part, "i4")),
                        pa.array(before), pa.array(sizes), pa.array(ids, pa.binary()),
                    ],
                    names=["id", "part", "before", "n_tokens", "ids"],
                )
        encoder.forget()

    return run


def _cut(with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, sizes = batch.column("begin").to_numpy(), batch.column("n_tokens").to_numpy()
            # a document's pieces: one for each window that it touches
            first, last = begin // WINDOW, (begin + sizes - 1) // WINDOW
            n = last - first + 1
            rows = np.repeat(np.arange(len(n)), n)
            window = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.maximum(window * WINDOW - begin[rows], 0)
            stop = np.minimum((window + 1) * WINDOW - begin[rows], sizes[rows])
            crcs, kept, ids, at = [], [], np.zeros(0, "<u4"), -1
            for row, a, b in zip(rows.tolist(), start.tolist(), stop.tolist(), strict=True):
                if row != at:
                    ids, at = np.frombuffer(batch.column("ids")[row].as_buffer(), ID_TYPE).astype("<u4"), row
                crcs.append(zlib.crc32(ids[a:b]))
                kept.append(ids[a:b].tobytes() if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows)), pa.array(start), pa.array(stop - start),
                    pa.array(crcs, pa.int64()), pa.array(sizes[rows]), pa.array(window),
                    pa.array(begin[rows] + start - window * WINDOW), pa.array(kept, pa.binary()),
                ],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Documents, each ended by ``END_ID``, form one stream that is cut every ``WINDOW`` ids, so only
    the last sequence can be short. A document that a cut meets has a piece on either side of it.

    Two passes: the first encodes every partition and writes ids with the running count inside the
    partition; the partitions' totals, one row each, are summed up to global offsets; the second
    pass cuts every document by its offset alone. The order of the stream is that of the first pass'
    committed files, so a retried task changes nothing. Nothing is shuffled but the totals, and a
    document is in no task with more than its own batch.

    ids are unsigned 32-bit numbers, null without ``with_ids``. Null and empty texts are the end id
    alone. Ids of rows may repeat or be null; rows are packed one by one. Other columns are not
    looked at. An empty table gives no piece.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    encoded = staged(
        rows.mapInArrow(_encode(vocabulary), "id long, part int, before long, n_tokens long, ids binary"),
        "pack-ids",
    )
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    offsets = small_enough(staged(totals.select("part", ahead.alias("ahead")), "pack-offsets"), 32)
    placed = encoded.join(offsets, "part").select("id", (F.col("ahead") + F.col("before")).alias("begin"), "n_tokens", "ids")
    return placed.mapInArrow(_cut(with_ids), _PIECES).withColumnRenamed("id", id_col)
