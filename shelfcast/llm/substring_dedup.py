"""Repeated byte strings, found by run-length indexes over content-routed blocks of text.

One index of a whole corpus can't be built in a task, so text is routed by content. Each window of
``WIDTH`` bytes goes to the smallest hash among its ``GRAM``-byte strings, its anchor: equal windows
have equal anchors wherever they stand. The windows that one anchor occurrence owns lie side by
side, so a segment of text stands for all of them. Only segments whose anchor occurs twice leave
their document. They are gathered by anchor into blocks of bounded size; each block gets a
run-compressed Burrows-Wheeler index, and streamed matching statistics mark its repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import text as tx
from shelfcast.llm.run_length_index import repeated_windows
from shelfcast.llm.storage import BROADCAST_BYTES, staged

WIDTH = 400
GRAM = 100
#: Bytes of segments that one index holds, about.
BLOCK_BYTES = 1 << 20
#: Distinct segments of an anchor that may share a block; larger groups are halved first.
GROUP = 256
_PLACE_BITS = 24
_PART = 1 << 23
_REACH = WIDTH - GRAM + 1  # anchors that a window can have


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, by minima from both ends of fixed pieces."""
    n = len(values)
    pad = -n % width
    grid = np.concatenate((values, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes before in that row, bytes, offsets); very long rows come in pieces that
    overlap so that every window is whole in one of them."""
    for first, _, data, offsets in tx.slices(column):
        if len(data) <= _PART + WIDTH:
            yield first, 0, data, offsets
            continue
        for at in range(0, len(data) - WIDTH + 1, _PART):
            piece = data[at: at + _PART + WIDTH - 1]
            yield first, at, piece, np.array([0, len(piece)])


def _owners(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, windows, anchor's place, hash of the anchor,
    hash of the whole segment, row."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if len(data) < WIDTH or (sizes < WIDTH).all():
        return none, none, none, none, none, none
    places = np.arange(len(data) - GRAM + 1)
    prefix = tx.prefix_hash(data)
    hashes = tx.span_hash(prefix, places, places + GRAM)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = _smallest((hashes & ~low) | places.astype(np.uint64), _REACH)
    owner = (least & low).astype(np.int64)
    rows = np.flatnonzero(sizes >= WIDTH)
    n = sizes[rows] - WIDTH + 1
    windows = np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    own = owner[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate((at, [len(windows)])))
    start, place = windows[at], own[at]
    whole = tx.span_hash(prefix, start, start + count + (WIDTH - 1))
    return start, count, place, hashes[place].view("i8"), whole.view("i8"), np.searchsorted(offsets, start, side="right") - 1


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, before, data, offsets in _parts(batch.column("text")):
            start, count, place, anchor, digest, row = _owners(data, offsets)
            pick = pa.array(first + row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pick), batch.column("hash").take(pick),
                    pa.array(start - offsets[row] + before, pa.int64()), pa.array(count, pa.int32()),
                    pa.array(place - start, pa.int32()), pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()),
                ],
                names=["id", "hash", "start", "windows", "lead", "anchor", "digest"],
            )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each listed run of windows; a text's list is as long as the text at most."""
    names = ["anchor", "digest", "windows", "lead", "segment"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column("text")[i].as_py().encode()
            out = [
                (r["anchor"], r["digest"], r["windows"], r["lead"], data[r["start"]: r["start"] + r["windows"] + WIDTH - 1])
                for r in batch.column("runs")[i].as_py()
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names
            )


def _block(table: pa.Table) -> pa.Table:
    """Repeated windows of one block, as ranges relative to the anchor."""
    segments = [np.frombuffer(s.as_buffer(), np.uint8) for s in table.column("segment")]
    anchors, digests, first = (table.column(c).to_pylist() for c in ("anchor", "digest", "first"))
    out = []
    for i, flags in enumerate(repeated_windows(segments, WIDTH)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            out.append((anchors[i], digests[i], first[i] + a, first[i] + b - 1))
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor", "digest", "a", "b"])


_MARKS = "anchor long, digest long, a int, b int"


def _halved(rows: DataFrame, width: int) -> DataFrame:
    """Each row's part in either half of its node's range of window places.

    A node of ``width`` places starts at ``low``; places count from the anchor, so equal windows
    have equal places. A part stays only if the bytes that all windows of its half share occur in
    another row of the half too; without that none of its windows can be repeated.
    """
    half = width // 2
    parts = rows.withColumn("low", F.explode(F.array("low", F.col("low") + half)))
    first = F.greatest("first", "low")
    windows = F.least(F.col("first") + F.col("windows"), F.col("low") + half) - first
    parts = parts.withColumn("from", first).withColumn("n", windows).where("n > 0")
    segment = F.substring("segment", F.col("from") - F.col("first") + 1, F.col("n") + (WIDTH - 1))
    parts = parts.select(
        "anchor", "digest", "low", F.col("from").alias("first"), F.col("n").alias("windows"), segment.alias("segment")
    )
    shared = WIDTH - half + 1
    if shared <= 0:
        return parts
    core = F.xxhash64(F.substring("segment", F.col("low") + (half - 1) - F.col("first") + 1, F.lit(shared)))
    parts = parts.withColumn("core", core)
    twice = parts.groupBy("anchor", "low", "core").count().where("count > 1").drop("count")
    return parts.join(twice, ["anchor", "low", "core"], "left_semi").drop("core")


def _settled(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks of parts that several rows have in full, one row of each distinct part)."""
    content = F.md5("segment")
    parts = staged(parts.withColumn("content", content), "repeat-parts")
    same = ["anchor", "low", "first", "windows", "content"]
    groups = parts.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("keeper"))
    twice = groups.where("n > 1").drop("n", "keeper")
    marks = parts.join(twice, same, "left_semi").select(
        "anchor", "digest", F.col("first").cast("int").alias("a"), (F.col("first") + F.col("windows") - 1).cast("int").alias("b")
    )
    one = parts.join(groups.select(*same, F.col("keeper").alias("digest")), [*same, "digest"], "left_semi")
    return marks, one.drop("content")


def _marks(distinct: DataFrame) -> DataFrame:
    """Repeated windows among distinct segments: anchor, digest, and ranges [a, b] of places.

    Anchors with more than ``GROUP`` segments are halved by place until a part's group is small or
    its rows are equal; a group of any size ends there, as parts of one window are equal or
    different.
    """
    width = 1 << (_REACH - 1).bit_length()
    rows = distinct.select(
        "anchor", "digest", F.lit(1 - width).alias("low"), (-F.col("lead")).alias("first"), "windows", "segment"
    )
    marks: list[DataFrame] = []
    ready: list[DataFrame] = []
    while True:
        rows = staged(rows, "repeat-rows")
        large = staged(rows.groupBy("anchor", "low").count().where(F.col("count") > GROUP).drop("count"), "repeat-large")
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, ["anchor", "low"], "left_anti"))
        if width == 1:
            break  # one window each, and those left are all different
        found, rows = _settled(_halved(rows.join(large, ["anchor", "low"], "left_semi"), width))
        marks.append(found)
        width //= 2
    blocks = ready[0].select("anchor", "low", "digest", "first", "segment")
    for more in ready[1:]:
        blocks = blocks.union(more.select("anchor", "low", "digest", "first", "segment"))
    total = blocks.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    indexed = (
        blocks.withColumn("block", F.pmod(F.xxhash64("anchor", "low"), F.lit(n_blocks)))
        .groupBy("block").applyInArrow(_block, _MARKS)
    )
    for found in marks:
        indexed = indexed.union(found)
    return indexed


def _key(id_col: Column, text_col: Column) -> list[Column]:
    return [F.coalesce(id_col, F.lit(-1)).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("hash")]


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(id, hash, ranges) of rows (id, hash, text) with repeated windows: ranges lists the first
    and last start of side-by-side windows that occur at another place too."""
    runs = staged(
        texts.where(F.octet_length("text") >= WIDTH).mapInArrow(
            _anchors, "id long, hash long, start long, windows int, lead int, anchor long, digest long"
        ),
        "repeat-anchors",
    )
    # written, so that a hot anchor's rows can be split in the join
    shared = staged(runs.groupBy("anchor").count().where("count > 1").select("anchor"), "repeat-shared")
    live = staged(runs.join(shared, "anchor", "left_semi"), "repeat-live")
    groups = staged(
        live.groupBy("anchor", "digest", "windows", "lead").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "hash", "start")).alias("one")
        ),
        "repeat-groups",
    )
    # one text of each different segment, where an anchor has several
    mixed = staged(groups.groupBy("anchor").count().where("count > 1").select("anchor"), "repeat-mixed")
    ones = groups.join(mixed, "anchor", "left_semi").groupBy("one.id", "one.hash").agg(
        F.collect_list(F.struct("anchor", "digest", "windows", "lead", "one.start")).alias("runs")
    )
    ones = staged(ones, "repeat-ones")
    size = ones.agg(F.sum(F.size("runs") * 32 + 64)).first()[0] or 0
    wanted = F.broadcast(ones) if size <= BROADCAST_BYTES else ones
    # rows that repeat id and text give the same segments
    distinct = staged(
        texts.join(wanted, ["id", "hash"]).select("text", "runs")
        .mapInArrow(_segments, "anchor long, digest long, windows int, lead int, segment binary"),
        "repeat-segments", "zstd",
    ).dropDuplicates(["anchor", "digest", "windows", "lead"])
    marks = _marks(distinct)

    whole = groups.where("n > 1").select(
        "anchor", "digest", (-F.col("lead")).alias("a"), (F.col("windows") - F.col("lead") - 1).alias("b")
    )
    # few ranges a segment: its windows that occur again, side by side
    found = marks.union(whole).groupBy("anchor", "digest").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    # written, so that the places of a hot segment can be split in the join
    found = staged(found, "repeat-found")
    at = F.col("start") + F.col("lead")
    places = live.select("id", "hash", "anchor", "digest", at.alias("at")).join(found, ["anchor", "digest"])
    spans = F.transform("found", lambda r: F.struct((F.col("at") + r["a"]).alias("a"), (F.col("at") + r["b"]).alias("b")))
    return places.groupBy("id", "hash").agg(F.flatten(F.collect_set(spans)).alias("ranges"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lists = batch.column("text"), batch.column("ranges")
        out = []
        for i in range(batch.num_rows):
            data = (texts[i].as_py() or "").encode()
            spans: list[list[int]] = []
            for a, b in sorted((r["a"], r["b"] + WIDTH) for r in lists[i].as_py() or []):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            kept = hashlib.sha256()
            at = 0
            for a, b in spans:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            removed = sum(b - a for a, b in spans)
            out.append((len(data), removed, len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    spans lists the maximal runs of bytes, in the UTF-8 text, that are covered by a string of
    ``WIDTH`` bytes which starts at another place as well, in any document; places may overlap.
    kept_sha256 is of the bytes outside them.

    A null text is empty; texts below ``WIDTH`` bytes have no span. Ids may be null or repeat: a
    repeated row is a second place, and rows of one id with different texts are told apart by the
    text. Other columns are not looked at. An empty table gives no row.
    """
    id_, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(*_key(id_, text), id_.alias("own"), text.alias("text"))
    ranges = repeated_ranges(texts.select("id", "hash", "text"))
    rows = texts.join(ranges, ["id", "hash"], "left").select(F.col("own").alias("id"), "text", "ranges")
    return rows.mapInArrow(
        _remove,
        "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start: long, end: long>>",
    ).withColumnRenamed("id", id_col)
