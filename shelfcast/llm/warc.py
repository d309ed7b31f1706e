"""WARC archives: a deterministic sharded writer with a manifest, and a reader."""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.storage import small_enough, staged

#: Compressed bytes after which a file is closed and the next one begun.
ROLL_BYTES = 64 << 20
#: Payload bytes of a range that one task writes, about. Beyond ``RANGES`` times as many, ranges grow.
RANGE_BYTES = 32 << 20
RANGES = 1 << 18
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 1000
#: Part of every record, so that the same rows always give the same bytes.
DATE = "2024-01-01T00:00:00Z"
_SPACE_ID = uuid.uuid5(uuid.NAMESPACE_URL, "warc-records")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "part int, file int, temporary string, final string, records long, bytes long, crc32 long"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'{page}:{digest}')}>"


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _target(url: str | None) -> str:
    """A header holds one line; what would end it is percent-encoded."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    headers = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}",
        f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Target-URI: {_target(url)}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page is not None:
        headers.append(f"WARC-Page-Key: {page}")
    if refers_to is not None:
        headers += [
            f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"WARC-Refers-To-Page-Key: {refers_to}", f"WARC-Refers-To-Date: {DATE}",
        ]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Files of one range, each under a temporary name of this attempt."""

    def __init__(self, folder: str, part: int, attempt: str) -> None:
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.part, self.attempt, self.done = part, attempt, []
        self.out = None

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.number = len(self.done)
            self.name = f"_temporary-{self.attempt}/{self.part:06d}-{self.number:05d}.warc.gz"
            self.store.create_dir(f"{self.base}/_temporary-{self.attempt}", recursive=True)
            self.out = self.store.open_output_stream(f"{self.base}/{self.name}", compression=None)
            self.records = self.size = self.crc = 0
        self.out.write(member)
        self.records, self.size, self.crc = self.records + 1, self.size + len(member), zlib.crc32(member, self.crc)
        if self.size >= ROLL_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            final = f"{self.part:06d}-{self.number:05d}.warc.gz"
            self.done.append((self.part, self.number, self.name, final, self.records, self.size, self.crc))
            self.out = None


def _write(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by range and page: a page's rows without text, which come first, tell which payload
    of it is a revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        roller, decided, of, done = None, {}, None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("part", "page", "digest", "decision", "refers_to", "url", "html")]
            for part, page, digest, decision, refers_to, url, html in zip(*columns, strict=True):
                part, page = part.as_py(), page.as_py()
                if page != of:
                    of, decided = page, {}
                if decision.as_py():
                    decided[digest.as_py()] = refers_to.as_py()
                    continue
                if roller is None or roller.part != part:
                    if roller is not None:
                        roller.close()
                        done += roller.done
                    roller = _Roller(folder, part, attempt)
                to = decided.get(digest.as_py())
                payload = (html.as_py() or "").encode()
                member = gzip.compress(record(page, url.as_py(), payload, digest.as_py(), to), 6, mtime=0)
                roller.add(member)
        if roller is not None:
            roller.close()
            done += roller.done
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*done, strict=True)) if done else [[]] * len(kinds)
        names = ["part", "file", "temporary", "final", "records", "bytes", "crc32"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _commit(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Move each file of the manifest to its final name; a second attempt finds it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, final, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "final", "bytes")), strict=True):
                there = store.get_file_info(f"{base}/{final}")
                if there.type != fs.FileType.File or there.size != size:
                    store.move(f"{base}/{name}", f"{base}/{final}")
            yield batch

    return run


def _uri(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme."""
    if "://" in path or path.startswith("file:"):
        return path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path
    return f"file://{path}"


def _key(page: Column, digest: Column, url: Column) -> Column:
    """Sorts by page and digest; rows without a page come first, by digest and url."""
    number = F.lpad(F.hex(page.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    place = F.concat(F.lit("1"), number, F.substring(digest, 1, 8))
    return F.coalesce(place, F.concat(F.lit("0"), F.substring(digest, 1, 8), F.lpad(F.hex(F.xxhash64(url)), 16, "0")))


def _borders(narrow: DataFrame) -> np.ndarray:
    """First key of each range: exact prefix sums of the keys' bytes, cut at multiples of the range size.

    Keys are sorted by ranges of Spark's own, whose totals, a row per partition, give the offsets. What
    comes to the driver besides is one key of 25 characters per range, ``RANGES`` and one at most.
    """
    keys = narrow.groupBy("key").agg(F.sum(F.col("size") + 512).alias("w"))
    ordered = staged(keys.repartitionByRange("key").withColumn("place", F.spark_partition_id()), "warc-keys")
    totals = ordered.groupBy("place").agg(F.sum("w").alias("w")).orderBy("place").collect()
    total = sum(r["w"] for r in totals)
    width = max(RANGE_BYTES, -(-total // RANGES))
    before = dict(zip((r["place"] for r in totals), np.cumsum([0, *(r["w"] for r in totals)]).tolist(), strict=False))
    if not before:
        return np.zeros(0, "S25")
    offsets = ordered.sparkSession.createDataFrame(list(before.items()), "place int, before long")
    within = F.sum("w").over(Window.partitionBy("place").orderBy("key")) - F.col("w")
    cut = ordered.withColumn("within", within).join(small_enough(staged(offsets, "warc-offsets"), 16), "place")
    firsts = cut.groupBy(F.floor((F.col("before") + F.col("within")) / width).alias("range")).agg(F.min("key").alias("key"))
    return np.array(sorted(r["key"] for r in firsts.collect()), "S25")


def write_archive(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files below ``path``; gives the manifest.

    Of records with equal payloads of ``REVISIT_BYTES`` or more the one with the largest page_id is
    a response, the others revisit it. Rows sorted by page_id and digest are cut into ranges of about
    ``RANGE_BYTES``, whatever the ids, one task each, and files roll by compressed size; all of that follows the rows alone, so the same rows give the same files whatever the number of
    tasks. A task writes under names of its own attempt; the manifest, a Parquet table below
    ``path``/_manifest, lists the files of committed attempts only, and they alone are moved to
    their final names. Readers go by the manifest.

    A null html is an empty payload, a null url an empty target. A row without page_id is written
    as a response; such rows are cut by digest and url. Rows that repeat a page_id and its payload are all written alike; different payloads
    of a page_id are decided each by itself. Other columns are not looked at. An empty table writes a manifest without files.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    payload = F.col("html").cast("binary")
    key = _key(F.col("page"), F.sha1(payload), F.col("url"))
    narrow = staged(rows.select("page", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"), key.alias("key")), "warc-pages")
    equal = narrow.where((F.col("size") >= REVISIT_BYTES) & F.col("page").isNotNull())
    first = equal.groupBy("digest", "size").agg(F.max("page").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = staged(
        equal.join(first, ["digest", "size"]).where("page <> refers_to").select("page", "digest", "refers_to").distinct(),
        "warc-revisits",
    )

    borders = _borders(narrow)
    known = spark.sparkContext.broadcast(borders)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(known.value, key.to_numpy().astype("S25"), side="right") - 1, 0))

    decisions = revisits.select("page", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to", F.lit(True).alias("decision"))
    full = rows.select("page", "url", "html", F.sha1(payload).alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("decision"))
    # a decision's page is never null, so its key is that of its page's records
    together = full.union(decisions).withColumn("part", range_of(_key(F.col("page"), F.col("digest"), F.col("url"))))
    ordered = together.repartitionById(max(len(borders), 1), F.col("part")).sortWithinPartitions(
        "part", "page", F.desc("decision"), "digest", "url"
    )
    folder = _uri(spark, path)
    written = staged(
        ordered.select("part", "page", "digest", "decision", "refers_to", "url", "html").mapInArrow(_write(folder), _MANIFEST),
        "warc-manifest",
    )
    moved = written.repartition(max(1, written.count() // 64)).mapInArrow(_commit(folder), _MANIFEST)
    moved.write.parquet(f"{path}/_manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest")


def _members(data: bytes) -> Iterator[bytes]:
    """The records of a file of gzip members."""
    at = 0
    while at < len(data):
        unpack = zlib.decompressobj(31)
        out = unpack.decompress(data[at: at + (1 << 20)])
        pieces, end = [out], at + (1 << 20)
        while not unpack.eof:
            if end >= len(data):
                raise ValueError("a record is cut off")
            pieces.append(unpack.decompress(data[end: end + (1 << 20)]))
            end += 1 << 20
        at = min(end, len(data)) - len(unpack.unused_data)
        yield b"".join(pieces)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for content in batch.column("content"):
            out, held = [], 0
            for data in _members(content.as_buffer().to_pybytes()):
                fields, block = parse(data)
                if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"]:
                    raise ValueError(f"block digest of {fields['WARC-Record-ID']} doesn't fit")
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind = fields["WARC-Type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload digest of {fields['WARC-Record-ID']} doesn't fit")
                key, to = fields.get("WARC-Page-Key"), fields.get("WARC-Refers-To-Page-Key")
                out.append((
                    int(key) if key else None, length, digest, kind, int(to) if to else None,
                    fields.get("WARC-Target-URI", ""), payload if kind == "response" else None,
                ))
                held += len(payload)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, one row each: page_id, payload_bytes, payload_digest,
    record_type, refers_to, target_uri, payload (null for a revisit).

    Every digest is checked. Files are those of the manifest; one that isn't listed is not read.
    """
    listed = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest").select(F.col("final").alias("name"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    # names are few and short beside the files
    kept = named.join(small_enough(listed, 64), "name", "left_semi").select("content")
    return kept.mapInArrow(
        _read,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "target_uri string, payload binary",
    )
