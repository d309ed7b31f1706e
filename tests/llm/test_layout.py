"""WARC archives, resharding and the corpus pipeline."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import random
import zlib
from collections import defaultdict
from pathlib import Path

from helpers import awkward_rows, clashing, components, rows_of, table, words

import corpus_pipeline
from shelfcast.llm import resharding, warc

PAGES = "page_id long, url string, html string"


def page_rows():
    big = words(300, 1)
    return [
        (3, "http://a/3", big), (9, "http://a/9", big), (4, "http://a/4", big), (1, None, "short"), (2, "x\r\ny z", "short"),
        (5, "http://a/5", None), (6, "http://a/6", ""), (7, "http://a/é", "é\r\n\r\nWARC/1.1\r\n" * 200), (8, "u", "x" * 300_000),
        (None, "http://a/n", big), (10, "r", words(200, 2)), (10, "r", words(200, 2)),
    ]


def test_archive_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    manifest = warc.write_archive(clashing(table(spark, page_rows(), PAGES)), path)
    found = warc.read_archive(spark, path).collect()
    texts = defaultdict(list)
    for page, _, html in page_rows():
        texts[page].append((html or "").encode())
    assert len(found) == len(page_rows()) == sum(r.records for r in manifest.collect())
    latest = {}
    for page, bodies in texts.items():
        for b in bodies:
            if page is not None and len(b) >= warc.REVISIT_BYTES:
                latest[b] = max(page, latest.get(b, page))
    for r in found:
        body = next(b for b in texts[r.page_id] if hashlib.sha1(b).hexdigest() == r.payload_digest)
        assert r.payload_bytes == len(body)
        to = None if r.page_id is None or latest.get(body, r.page_id) == r.page_id else latest[body]
        assert (r.record_type, r.refers_to) == ("response" if to is None else "revisit", to)
        assert r.payload == (body if to is None else None)


def test_payloads_of_a_page_are_decided_one_by_one(spark, tmp_path):
    one, two, three = (f"<html>{words(300, 80 + i)}</html>" for i in range(3))
    rows = [(1, "u", one), (1, "u", two), (1, "u", "short"), (2, "v", two), (3, "w", three), (3, "w", one), (4, "x", three), (None, "y", two)]
    path = str(tmp_path / "w")
    warc.write_archive(table(spark, rows, PAGES), path)
    digest = lambda t: hashlib.sha1(t.encode()).hexdigest()
    to = {(1, one): 3, (1, two): 2, (3, three): 4}
    expected = [(p, digest(t), to.get((p, t)), None if (p, t) in to else t.encode()) for p, _, t in rows]
    found = warc.read_archive(spark, path).collect()
    assert sorted([(r.page_id, r.payload_digest, r.refers_to, r.payload and bytes(r.payload)) for r in found], key=repr) == sorted(expected, key=repr)


def test_archives_of_the_same_rows_are_the_same_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_BYTES", 2000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 4000)
    rows = page_rows() + [(100 + i, f"http://b/{i}", words(40, i)) for i in range(60)]
    files = []
    for n in (1, 5):
        path = tmp_path / f"w{n}"
        manifest = warc.write_archive(table(spark, rows, PAGES).repartition(n), str(path))
        listed = {r.final for r in manifest.collect()}
        there = {p.name: p.read_bytes() for p in path.glob("*.warc.gz")}
        assert set(there) == listed and len(there) > 5
        assert all(gzip.decompress(b).startswith(b"WARC/1.1\r\n") for b in there.values())
        assert {r.final: r.crc32 for r in manifest.collect()} == {k: zlib.crc32(v) for k, v in there.items()}
        files.append(there)
    assert files[0] == files[1]


def test_ranges_follow_the_bytes_whatever_the_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 20_000)
    body = [words(60, i) for i in range(300)]
    for name, ids in {
        "outlier": [*range(299), 1 << 62], "ends": [-(1 << 63), (1 << 63) - 1, *range(-5, 293)], "none": [None] * 300,
        "one": [7] * 300,
    }.items():
        path = str(tmp_path / name)
        manifest = warc.write_archive(table(spark, [(p, "u", t) for p, t in zip(ids, body, strict=True)], PAGES), path).collect()
        total = sum(len(t) + 512 for t in body)
        assert total // 20_000 <= len({r.part for r in manifest}) <= total // 20_000 + 2, name
        assert max(r.records for r in manifest) < 50 and sum(r.records for r in manifest) == 300, name
        found = warc.read_archive(spark, path).collect()
        assert sorted((r.page_id or 0, bytes(r.payload)) for r in found) == sorted((p or 0, t.encode()) for p, t in zip(ids, body, strict=True))


def test_the_number_of_ranges_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 1000)
    monkeypatch.setattr(warc, "RANGES", 4)
    rows = [(i, "u", words(60, i)) for i in range(100)]
    manifest = warc.write_archive(table(spark, rows, PAGES), str(tmp_path / "w")).collect()
    assert len({r.part for r in manifest}) in (4, 5) and sum(r.records for r in manifest) == 100


def test_files_that_no_manifest_lists_are_not_read(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_archive(table(spark, page_rows(), PAGES), str(path))
    (path / "999999-00000.warc.gz").write_bytes(b"left over")
    assert warc.read_archive(spark, str(path)).count() == len(page_rows())


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "w")
    Path(path).mkdir()
    assert warc.write_archive(table(spark, [], PAGES), path).count() == 0
    assert warc.read_archive(spark, path).count() == 0


def test_flow_costs_no_more_than_any_other():
    draw = random.Random(8)
    for _ in range(30):
        supply = [draw.randrange(4) for _ in range(3)]
        room = [draw.randrange(4) for _ in range(2)] + [sum(supply)]
        cost = [[draw.randrange(5) for _ in range(3)] for _ in range(3)]
        flows = resharding.min_cost_flow(supply, room, cost)
        assert [sum(r) for r in flows] == supply
        assert all(sum(flows[i][j] for i in range(3)) <= room[j] for j in range(3))
        units = [i for i, n in enumerate(supply) for _ in range(n)]
        best = min(
            sum(cost[i][j] for i, j in zip(units, to, strict=True))
            for to in itertools.product(range(3), repeat=len(units))
            if all(to.count(j) <= room[j] for j in range(3))
        )
        assert sum(flows[i][j] * cost[i][j] for i in range(3) for j in range(3)) == best


def test_reshard_places_every_row_once(spark, tmp_path):
    rows = awkward_rows() + [(200 + i, words(40 + i, i)) for i in range(200)]
    found, transfers = resharding.reshard(clashing(table(spark, rows)), str(tmp_path / "s"), 3, 4)
    found = found.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32, r.size) for r in found) == sorted(
        (d is None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in rows
    )
    slots, sizes, shards = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        shards[r.text_crc32, r.size].add(r.shard)
        assert r.moved == (r.shard != r.old_shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    assert sum(r.bytes for r in transfers.collect()) == sum(sizes.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.9 * max(len((t or "").encode()) for _, t in rows)


def test_reshard_cuts_a_large_block_by_text_first(spark, tmp_path):
    """One text above the limit, and groups of others in its block, which have to stay whole."""
    key = lambda texts, seed, n: [
        r[0] for r in table(spark, [(t,) for t in texts], "t string").selectExpr(f"pmod(xxhash64(t, {seed}), {n})").collect()
    ]
    texts = [f"text {i}" for i in range(40_000)]
    places = list(zip(key(texts, 17, 3), key(texts, 29, resharding.BLOCKS), strict=True))
    mates = [t for t, p in zip(texts, places, strict=True) if p == places[0]]
    assert len(mates) > 8
    rows = [(i, mates[0]) for i in range(3000)] + [(10_000 + 100 * k + i, t) for k, t in enumerate(mates[1:]) for i in range(40)]
    rows += [(90_000 + i, texts[i]) for i in range(2000)]
    found, _ = resharding.reshard(table(spark, rows), str(tmp_path / "s"), 3, 4)
    text_of, shards = dict(rows), defaultdict(set)
    for r in found.collect():
        shards[text_of[r.doc_id]].add(r.shard)
    assert len(shards[mates[0]]) > 1
    assert all(len(s) == 1 for t, s in shards.items() if t != mates[0])


def test_resharded_files_hold_every_row(spark, tmp_path, monkeypatch):
    rows = awkward_rows() + [(200 + i, words(40 + i, i)) for i in range(60)]
    expected = sorted((d is None, d or 0, t or "") for d, t in rows)

    def check(path):
        found, _ = resharding.reshard(table(spark, rows), path, 3, 4)
        files = spark.read.parquet(path)
        assert sorted((r.id is None, r.id or 0, r.text) for r in files.collect()) == expected
        placed = sorted((r.id or 0, r["size"], r.shard, r.old_shard) for r in files.collect())
        assert placed == sorted((r.doc_id or 0, r["size"], r.shard, r.old_shard) for r in found.collect())

    check(str(tmp_path / "s"))
    # one block changes its shard; shard 2 is left as it is
    monkeypatch.setattr(
        resharding, "plan_transfers",
        lambda blocks, old, new: {b: 1 if b == min(blocks) else b[0] for b in blocks},
    )
    check(str(tmp_path / "t"))


def test_reshard_nothing(spark, tmp_path):
    found, transfers = resharding.reshard(table(spark, []), str(tmp_path / "s"), 3, 4)
    assert found.count() == 0 and transfers.count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages_on_planted_rows(spark, tmp_path):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in awkward_rows()]
    item = words(40, 70)
    rows += [(300, words(20, 71) + " " + item, "en", "s", 1), (301, words(25, 72), None, None, None)]
    rows += [(400 + i, words(30, 800 + i) + (" blorgon snarvik blorgon" if i % 3 == 0 else ""), "en", "s", 1) for i in range(90)]
    folder = tmp_path / "t"
    table(spark, rows, COLUMNS).write.parquet(str(folder / "documents.parquet"))
    table(spark, [(1, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    marks = [(400 + i, 1, int(i % 3 == 0)) for i in range(90)]
    table(spark, marks, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))

    docs = spark.read.parquet(str(folder / "documents.parquet"))
    columns = docs.columns
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
        assert docs.columns == columns, name
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
    bad = {400 + i for i in range(90) if i % 3 == 0}
    assert set(ids[0]) == {r[0] for r in rows} - bad
    assert sorted(x for x in ids[1] if x is not None) == sorted({r[0] for r in rows} - bad - {1, 2, 5, 6, None})
    left = [(r[0], r[1]) for r in rows if r[0] in set(ids[1])]
    heads = components(left)
    assert set(ids[2]) - {None} == {d for d in heads if heads[d] == d}
    assert set(ids[2]) - set(ids[3]) == {300}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(folder)).collect()
    assert {p.doc_id for p in pieces} == set(ids[3])
    assert {(p.sequence_id, p.offset) for p in pieces if p.offset == 0} == {(s, 0) for s in {p.sequence_id for p in pieces}}


def test_pipeline_of_no_rows(spark, tmp_path):
    folder = tmp_path / "t"
    table(spark, [], COLUMNS).write.parquet(str(folder / "documents.parquet"))
    table(spark, [], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    table(spark, [], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    assert rows_of(corpus_pipeline.run(spark, str(folder))) == []
