"""Exact, near and substring deduplication against SQL and brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from comparing import differences
from helpers import awkward_rows, clashing, components, repeated_cover, rows_of, shingles, table, words

from shelfcast.llm import exact_dedup, near_dedup, oracle, queries, substring_dedup
from shelfcast.llm.components import components as spark_components
from shelfcast.llm.run_length_index import repeated_windows


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert differences(queries.queries()[name](spark, sf_dir), con, oracle.statements()[name]) == []


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_duplicates_of_awkward_rows(spark, digest_all):
    rows = awkward_rows()
    found = exact_dedup.exact_duplicates(clashing(table(spark, rows)), digest_all=digest_all).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[bare(t)].append((d, len(t or "")))
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): (k, v) for k, v in groups.items()}
    assert len(found) == len(rows)
    kept = defaultdict(int)
    for r in found:
        if r.text_sha256 is None:
            assert not digest_all and r.kept and r.group_size == 1 and r.keep_id == r.doc_id
            continue
        key, members = by_sha[r.text_sha256]
        longest = max(n for _, n in members)
        best = min((d for d, n in members if n == longest and d is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(members))
        kept[key] += r.kept
        assert not r.kept or r.doc_id == best
    assert set(kept.values()) == {1}


def test_exact_duplicates_of_nothing(spark):
    empty = exact_dedup.exact_duplicates(table(spark, []), digest_all=True)
    assert empty.count() == 0 and empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_near_duplicates_of_awkward_rows(spark):
    rows = awkward_rows()
    expected = components(rows)
    found = near_dedup.near_duplicates(clashing(table(spark, rows))).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(set)
    for d, t in rows:
        sizes[d].add(len(shingles(t)))
    for r in found:
        assert r.n_shingles in sizes[r.doc_id]
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    assert near_dedup.near_duplicates(table(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_chains_of_near_copies_in_large_nodes(spark, monkeypatch):
    """A chain of copies, each near to the one before only, and texts that share half of it."""
    monkeypatch.setattr(near_dedup, "NODE", 8)
    monkeypatch.setattr(near_dedup, "LEVELS", 2)
    draw = random.Random(4)
    text, rows = words(80, 11).split(), []
    for i in range(60):
        text = list(text)
        text[draw.randrange(80)] = f"edit{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, words(80, 11) + " " + words(60, 200 + i)) for i in range(30)]
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert found == components(rows)


def test_boilerplate_pairs_in_large_nodes(spark, monkeypatch):
    """Pairs at 0.77 among pages at 0.69 that share most of their text, without help of pivots."""
    monkeypatch.setattr(near_dedup, "NODE", 16)
    monkeypatch.setattr(near_dedup, "PIVOTS", 0)
    monkeypatch.setattr(near_dedup, "LEVELS", 5)
    common, rows = words(304, 51), []
    for i in range(200):
        shared = words(20, 1000 + i)
        rows += [(2 * i + j, f"{common} {shared} {words(48, 5000 + 2 * i + j)}") for j in range(2)]
    assert components(rows) == {d: d - d % 2 for d, _ in rows}
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert sum(found[2 * i + 1] != 2 * i for i in range(200)) <= 2


def test_every_large_node_gets_a_child():
    import pyarrow as pa

    nodes = np.random.default_rng(9).integers(-(2**63), 2**63 - 1, 3000)
    tokens = [np.arange(near_dedup.TOKENS, dtype="<u4").tobytes()] * len(nodes)
    used = near_dedup.TOKENS // 2
    batch = pa.RecordBatch.from_arrays(
        [pa.array(nodes), pa.array(np.arange(len(nodes))), pa.array(tokens, pa.binary()), pa.array([(1 << used) - 1] * len(nodes))],
        names=["node", "rep", "tokens", "used"],
    )
    children = next(near_dedup._children(iter([batch])))
    assert set(children.column("rep").to_pylist()) == set(range(len(nodes)))
    assert all(u >> used for u in children.column("used").to_pylist())


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    found = {r.vertex: r.label for r in spark_components(table(spark, links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def check_repeats(spark, rows):
    found = rows_of(substring_dedup.repeated_strings(clashing(table(spark, rows))))
    expected = []
    for (d, t), spans in zip(rows, repeated_cover([t for _, t in rows]), strict=True):
        data, at, kept = (t or "").encode(), 0, b""
        for a, b in spans:
            kept, at = kept + data[at:a], b
        kept += data[at:]
        expected.append((d, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans))
    shown = [(*r[:5], [tuple(s) for s in r[5]]) for r in found]
    assert sorted(shown, key=repr) == sorted(expected, key=repr)


def test_repeated_strings_of_awkward_rows(spark):
    check_repeats(spark, awkward_rows())


def test_repeated_strings_with_halved_groups(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", 2)
    passage = words(70, 21)
    rows = [(i, words(10 + i, 300 + i) + passage + words(12, 400 + i)) for i in range(14)]
    check_repeats(spark, rows + [(50, "ab" * 900), (51, "abc" * 500)])


def test_repeated_strings_of_nothing(spark):
    assert substring_dedup.repeated_strings(table(spark, [])).count() == 0


def test_long_texts_come_in_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_PART", 1500)
    import pyarrow as pa

    text = words(900, 31)
    whole = [(0, at, bytes(d)) for _, at, d, _ in substring_dedup._parts(pa.array([text]))]
    assert len(whole) > 2
    for i in range(len(text) - substring_dedup.WIDTH + 1):
        assert any(at <= i and i + substring_dedup.WIDTH <= at + len(d) for _, at, d in whole)


def test_index_marks_exactly_the_repeated_windows():
    draw = np.random.default_rng(3)
    base = draw.integers(97, 100, 600).astype(np.uint8)
    pieces = [base[a: a + n].copy() for a, n in ((0, 300), (50, 300), (200, 400), (10, 250))]
    pieces[1][100] = 120
    pieces.append(np.tile(np.frombuffer(b"ab", np.uint8), 100))
    width = 60
    from collections import Counter

    counts = Counter(bytes(p[i: i + width]) for p in pieces for i in range(len(p) - width + 1))
    for piece, flags in zip(pieces, repeated_windows(pieces, width), strict=True):
        assert flags.tolist() == [counts[bytes(piece[i: i + width])] > 1 for i in range(len(piece) - width + 1)]


def test_index_marks_repeats_whose_next_segments_are_equal_too():
    from collections import Counter

    draw = np.random.default_rng(4)
    pieces = []
    for _ in range(10):
        tail, head = (draw.integers(97, 123, n).astype(np.uint8) for n in (577, 560))
        for _ in range(3):
            pieces.append(np.concatenate((draw.integers(97, 123, 100).astype(np.uint8), tail)))
            pieces.append(np.concatenate((head, draw.integers(97, 123, 120).astype(np.uint8))))
    width = substring_dedup.WIDTH
    counts = Counter(bytes(p[i: i + width]) for p in pieces for i in range(len(p) - width + 1))
    for piece, flags in zip(pieces, repeated_windows(pieces, width), strict=True):
        assert flags.tolist() == [counts[bytes(piece[i: i + width])] > 1 for i in range(len(piece) - width + 1)]


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_long_words_of_one_polynomial_are_told_apart(spark):
    import pyarrow as pa

    from shelfcast.llm import text as tx

    pairs = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (64, 512, 1024, 2048, 4096)]
    data = pa.array([" ".join(p) for p in pairs])
    for _, _, piece, offsets in tx.slices(data):
        hashes, _ = tx.word_hashes(piece, offsets)
        assert len(np.unique(hashes)) == 2 * len(pairs)
    rows = [(i, words(6, 1) + " " + w + " " + words(6, 2)) for i, w in enumerate(w for p in pairs for w in p)]
    rows += [(100, rows[4][1].upper())]
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert found == {**{i: i for i in range(10)}, 100: 4} == components(rows)


def test_tokens_of_long_texts_use_all_their_bits():

    from shelfcast.llm import text as tx

    sets = np.sort(tx.mix(np.arange(1, 4001 * 50, dtype=np.uint64)))[: 4000 * 50]
    values = tx.mix(sets)
    tokens = near_dedup._minima(values, np.arange(0, 4000 * 50 + 1, 4000))
    assert (tokens >> np.uint32(16)).max() > 60_000 and len(np.unique(tokens >> np.uint32(20))) > 1500
