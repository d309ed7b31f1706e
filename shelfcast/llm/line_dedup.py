"""Repeated lines: hashes dealt by range, first occurrences streamed, keep bitmaps per document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.storage import BROADCAST_BYTES, staged

#: Least code points of a line's key; shorter lines always stay.
LEAST_POINTS = 10
#: A code point has at most four bytes.
_SURE_BYTES = 4 * LEAST_POINTS

_OCCURRENCE = "h1 long, h2 long, id long, text_hash long, copy int, n_lines int, lines array<int>"
_STREAMED = "kind int, h1 long, h2 long, id long, text_hash long, n_lines int, lines array<int>"
DROPPED, OPEN, LAST = 0, 1, 2


def _key(line: bytes) -> bytes:
    """White space at both ends stripped and A-Z lowered; both byte methods know ASCII alone."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document row and key of enough code points, with the lines that have it."""
    copy = 0
    for batch in batches:
        ids, hashes = batch.column("id").to_pylist(), batch.column("text_hash").to_pylist()
        rows: list[int] = []
        digests, lines, n_lines, copies = [], [], [], []
        for row, text in enumerate(batch.column("text")):
            copy += 1
            own: dict[bytes, list[int]] = {}
            parts = (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")
            for at, line in enumerate(parts):
                key = _key(line)
                if len(key) < LEAST_POINTS or (len(key) < _SURE_BYTES and len(key.decode()) < LEAST_POINTS):
                    continue
                own.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
            rows += [row] * len(own)
            digests += own.keys()
            lines += own.values()
            n_lines += [len(parts)] * len(own)
            copies += [copy] * len(own)
        halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([ids[r] for r in rows], pa.int64()),
                pa.array([hashes[r] for r in rows], pa.int64()), pa.array(copies, pa.int32()),
                pa.array(n_lines, pa.int32()), pa.array(lines, pa.list_(pa.int32())),
            ],
            names=["h1", "h2", "id", "text_hash", "copy", "n_lines", "lines"],
        )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by hash, id and text: what isn't in the first document of its hash.

    The first run of a partition may have begun in one before it, so its first document is only
    open. The last run goes on to the partitions behind: its first document is handed to them.
    """
    run: tuple[int, int, int | None] | None = None  # hash and first document of the run
    before: tuple = ()  # the row before, without its copy
    first_run = True

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.list_(pa.int32())]
        columns = list(zip(*found, strict=True)) if found else [()] * len(kinds)
        names = ["kind", "h1", "h2", "id", "text_hash", "n_lines", "lines"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        h1, h2, ids, texts = (batch.column(c).to_pylist() for c in ("h1", "h2", "id", "text_hash"))
        n_lines, lines = batch.column("n_lines"), batch.column("lines")
        found = []
        for at, now in enumerate(zip(h1, h2, ids, texts, strict=True)):
            if now == before:  # a row that repeats id and text
                continue
            before = now
            if run is None or run[:2] != now[:2]:
                first_run = run is None
                run = now[:3]
            elif now[2] != run[2]:
                found.append((DROPPED, *now, n_lines[at].as_py(), lines[at].as_py()))
                continue
            if first_run:
                found.append((OPEN, *now, n_lines[at].as_py(), lines[at].as_py()))
        yield rows(found)
    if run is not None:
        yield rows([(LAST, *run, None, None, None)])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bitmaps, dropped = [], []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone"), strict=True):
            keep = np.ones(n, dtype=bool)
            keep[gone.values.to_numpy()] = False
            bitmaps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
            dropped.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_hash"), batch.column("n_lines"),
             pa.array(dropped, pa.int64()), pa.array(bitmaps, pa.binary())],
            names=["id", "text_hash", "n_lines", "n_dropped", "keep"],
        )


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that loses lines: id, text_hash, n_lines, n_dropped, keep.

    A line goes if its key (ends stripped of ``[\\x20\\x09-\\x0D]``, A-Z lowered) has at least
    ``LEAST_POINTS`` code points and stands in a document of smaller id. keep holds a bit per line,
    lowest bit first, compressed with zlib; documents without a row lose nothing.

    Keys are hashed to 128 bits in one scan. Their occurrences, one row per document and key, are
    dealt by ranges of (hash, id, text, number of the row) and sorted in them, so a line that a third
    of all documents hold fills several ranges. Each range is streamed once. Only the first document
    of its first hash depends on other ranges: it is compared with the first documents of last
    hashes, one row per range. Texts are not shuffled.

    Null and empty texts are one empty line. Rows that repeat an id are one document, whose rows are
    told apart by a hash of their text; rows without id are together one document behind all others.
    Other columns are not looked at. An empty table gives none.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _text_hash(text).alias("text_hash"), text.alias("text"))
    found = staged(rows.mapInArrow(_occurrences, _OCCURRENCE), "line-occurrences")
    order = ["h1", "h2", F.asc_nulls_last("id"), "text_hash", "copy"]
    streamed = staged(
        found.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy").mapInArrow(_stream, _STREAMED),
        "line-stream",
    )
    firsts = streamed.where(F.col("kind") == LAST).groupBy("h1", "h2").agg(F.min("id").alias("first"))
    late = streamed.where(F.col("kind") == OPEN).join(firsts, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first")))
    columns = ["id", "text_hash", "n_lines", "lines"]
    gone = streamed.where(F.col("kind") == DROPPED).select(*columns).unionByName(late.select(*columns))
    by_document = gone.groupBy("id", "text_hash").agg(
        F.max("n_lines").alias("n_lines"), F.flatten(F.collect_set("lines")).alias("gone")
    )
    return staged(
        by_document.mapInArrow(_bitmaps, "id long, text_hash long, n_lines int, n_dropped long, keep binary"),
        "line-bitmaps",
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, kept = [], []
        for text, keep in zip(batch.column("text"), batch.column("keep"), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            if keep.is_valid:
                lines = data.split(b"\n")
                bits = np.frombuffer(zlib.decompress(keep.as_py()), dtype=np.uint8)
                keeps = np.unpackbits(bits, count=len(lines), bitorder="little").tolist()
                n_lines.append(len(lines))
                data = b"\n".join([x for x, k in zip(lines, keeps, strict=True) if k])
            else:
                n_lines.append(data.count(b"\n") + 1)
            kept.append(data)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n_lines, pa.int64()),
             pa.array(batch.column("n_dropped")), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["id", "n_lines", "n_dropped", "text"],
        )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, text (the lines that stay, joined by \\n).

    The bitmaps meet the texts in the one join that moves texts, unless they are small enough to go
    to the scan. See ``keep_bitmaps`` for what goes and for awkward rows.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col).withColumnsRenamed({"id": "__id", "text_hash": "__hash"}).drop("n_lines")
    size = bitmaps.agg(F.sum(F.octet_length("keep") + 40)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        bitmaps = F.broadcast(bitmaps)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _text_hash(text).alias("text_hash"), text.alias("text"))
    same = rows["id"].eqNullSafe(bitmaps["__id"]) & (rows["text_hash"] == bitmaps["__hash"])
    joined = rows.join(bitmaps, same, "left").select("id", "text", "keep", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"))
    kept = joined.mapInArrow(_apply, "id long, n_lines long, n_dropped long, text string")
    return kept.withColumnRenamed("id", id_col)
