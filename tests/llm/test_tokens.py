"""Packing in both ways: every id once, right places, exact round trips."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import awkward_rows, clashing, table
from tokenizers import Tokenizer

from shelfcast.llm import packing, token_matrices
from shelfcast.llm.queries import vocabulary
from shelfcast.llm.tokens import PieceTokenizer


@pytest.fixture(scope="module")
def plain():
    out = Tokenizer.from_file(vocabulary())
    out.encode_special_tokens = True
    return out


TEXTS = [
    "", "a   b  \n\n c\t d  e  ", "  ", "<|endoftext|> x", "it's  we'll\x1c\x1d x \x85 y", "　 a", "\r\n\r\nfoo\x0b\x0c",
    "x \n y", "日本語 テ スト", "😀 😀😀", "naïve café Ünï don't can’t abc日本 ½ x² a1b2,c.d", " , .word word. (word) word'word",
]


def test_cached_ids_equal_the_tokenizers(plain, monkeypatch):
    monkeypatch.setattr("shelfcast.llm.tokens.CACHE", 5)
    ours = PieceTokenizer(vocabulary())
    texts = TEXTS + [t or "" for _, t in awkward_rows()]
    for _ in range(2):
        got = [np.frombuffer(ours.encode([t])[0], "<u2").tolist() for t in texts]
        assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def check_pieces(rows, pieces, plain):
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(plain.encode(t or "", add_special_tokens=False).ids + [0])
    by_doc, by_row = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_row[p.sequence_id].append((p.offset, p.length))
    for d, texts in ids.items():
        parts = []
        for own in texts:
            starts = {0: len(own)}
            for p in by_doc[d]:
                if p.doc_tokens == len(own):
                    starts[p.start] = p.length
            assert sum(starts.values()) >= 1
            for p in by_doc[d]:
                part = own[p.start: p.start + p.length]
                if p.doc_tokens == len(own) and zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32:
                    parts.append(p)
        assert sum(p.length for p in by_doc[d]) == sum(map(len, texts))
        assert {id(p) for p in by_doc[d]} == {id(p) for p in parts}
    for places in by_row.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    assert sorted(by_row) == list(range(len(by_row)))


def test_concatenate_and_cut(spark, plain):
    rows = awkward_rows()
    pieces = packing.pack(clashing(table(spark, rows)).repartition(3), vocabulary()).collect()
    check_pieces(rows, pieces, plain)
    last = max(p.sequence_id for p in pieces)
    for s in range(last):
        assert sum(p.length for p in pieces if p.sequence_id == s) == 1024
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length


def test_best_fit_matrices(spark, plain, tmp_path, monkeypatch):
    rows = awkward_rows()
    written = token_matrices.write_matrices(clashing(table(spark, rows)), vocabulary(), str(tmp_path / "m"))
    check_pieces(rows, token_matrices.pieces(written).collect(), plain)
    for r in written.collect():
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert r.tokens == r.cu_seqlens[-1] and len(ids) == len(places)
        assert len(ids) == 1024 or (len(ids) == r.tokens and r.tokens & (r.tokens - 1) == 0)
        for a, b in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert places[a:b].tolist() == list(range(b - a))


def test_best_fit_takes_the_fullest_row_with_room():
    assert token_matrices.best_fit(np.array([6, 5, 4, 3, 2]), 10) == [[0, 2], [1, 3, 4]]
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 33, 400)
    free: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free[free.index(min(fit))] -= n
        else:
            free.append(32 - n)
    rows = token_matrices.best_fit(lengths, 32)
    assert sorted(i for r in rows for i in r) == list(range(400))
    assert sorted(32 - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def test_nothing_to_pack(spark, tmp_path):
    assert packing.pack(table(spark, []), vocabulary()).count() == 0
    written = token_matrices.write_matrices(table(spark, []), vocabulary(), str(tmp_path / "m"))
    assert written.count() == 0 and token_matrices.pieces(written).count() == 0
